"""Phase calendar: a time axis cut into named, half-open phases.

The phase of a row is a chain of ``F.when`` on the raw timestamp, so it
stays inside whole-stage codegen. Filters on one phase should use
:meth:`PhaseCalendar.between`, which emits a raw range on the timestamp
column: a range predicate reaches the Parquet scan as ``PushedFilters``
while a predicate on the derived phase string does not.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The reference's phase labels, in display order.
PRE = "Pre-Crisis"
CRISIS = "Crisis"
RECOVERY = "Recovery"
PHASE_NAMES = (PRE, CRISIS, RECOVERY)


@dataclass(frozen=True)
class Phase:
    name: str
    start: dt.datetime | None  # inclusive; None = open to the past
    end: dt.datetime | None  # exclusive; None = open to the future
    months: int  # calendar months covered, divisor for monthly means


def _ts(value) -> dt.datetime | None:
    if value is None or isinstance(value, dt.datetime):
        return value
    if isinstance(value, dt.date):
        return dt.datetime(value.year, value.month, value.day)
    return dt.datetime.fromisoformat(str(value))


def _ntz(value: dt.datetime) -> Column:
    """TIMESTAMP_NTZ literal from its text: independent of the Python
    process and session time zones (a ``lit(datetime)`` is a zoned
    timestamp converted through both)."""
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


class PhaseCalendar:
    """Ordered, contiguous, half-open phases.

    A NULL timestamp falls to the last phase, as in the reference
    (``NaT < x`` is False in pandas, ``ELSE`` in SQL); pass
    ``null_phase=None`` to keep it NULL instead."""

    def __init__(self, phases, null_phase: str | None = "last"):
        self.phases = tuple(
            p if isinstance(p, Phase) else Phase(p[0], _ts(p[1]), _ts(p[2]), int(p[3]))
            for p in phases)
        if not self.phases:
            raise ValueError("a calendar needs at least one phase")
        for a, b in zip(self.phases, self.phases[1:]):
            if a.end is None or a.end != b.start:
                raise ValueError(f"phases {a.name!r} and {b.name!r} are not contiguous")
        self.null_phase = self.phases[-1].name if null_phase == "last" else null_phase

    # -- lookups ---------------------------------------------------------
    @property
    def names(self) -> tuple[str, ...]:
        return tuple(p.name for p in self.phases)

    def phase(self, name: str) -> Phase:
        for p in self.phases:
            if p.name == name:
                return p
        raise KeyError(name)

    def months(self, name: str) -> int:
        return self.phase(name).months

    def ordinal(self, name: str) -> int:
        return self.names.index(name) + 1

    # -- column expressions ---------------------------------------------
    def phase_col(self, ts: Column | str) -> Column:
        ts = F.col(ts) if isinstance(ts, str) else ts
        expr = None
        for p in self.phases[:-1]:
            cond = ts < _ntz(p.end)
            expr = F.when(cond, F.lit(p.name)) if expr is None else expr.when(cond, F.lit(p.name))
        last = F.lit(self.phases[-1].name)
        if self.null_phase != self.phases[-1].name:
            last = F.when(ts.isNotNull(), last).otherwise(F.lit(self.null_phase))
        return last if expr is None else expr.otherwise(last)

    def ordinal_col(self, phase: Column | str) -> Column:
        phase = F.col(phase) if isinstance(phase, str) else phase
        expr = None
        for i, name in enumerate(self.names, start=1):
            expr = (F.when(phase == name, F.lit(i)) if expr is None
                    else expr.when(phase == name, F.lit(i)))
        return expr

    def between(self, ts: Column | str, name: str) -> Column:
        """Raw half-open range for one phase (pushdown friendly)."""
        ts = F.col(ts) if isinstance(ts, str) else ts
        p = self.phase(name)
        conds = []
        if p.start is not None and p is not self.phases[0]:
            conds.append(ts >= _ntz(p.start))
        if p.end is not None and p is not self.phases[-1]:
            conds.append(ts < _ntz(p.end))
        if p is self.phases[-1] and self.null_phase == p.name:
            lower = conds[0] if conds else F.lit(True)
            return lower | ts.isNull()
        if not conds:
            return ts.isNotNull() | F.lit(self.null_phase == p.name)
        out = conds[0]
        for c in conds[1:]:
            out = out & c
        return out

    # -- SQL text (for oracles and spark.sql users) ----------------------
    def sql_case(self, ts: str) -> str:
        parts = ["CASE"]
        if self.null_phase != self.phases[-1].name:
            null_label = "NULL" if self.null_phase is None else f"'{self.null_phase}'"
            parts.append(f"WHEN {ts} IS NULL THEN {null_label}")
        for p in self.phases[:-1]:
            parts.append(f"WHEN {ts} < TIMESTAMP '{p.end:%Y-%m-%d %H:%M:%S}' THEN '{p.name}'")
        parts.append(f"ELSE '{self.phases[-1].name}' END")
        return " ".join(parts)

    def sql_between(self, ts: str, name: str) -> str:
        p = self.phase(name)
        conds = []
        if p is not self.phases[0]:
            conds.append(f"{ts} >= TIMESTAMP '{p.start:%Y-%m-%d %H:%M:%S}'")
        if p is not self.phases[-1]:
            conds.append(f"{ts} < TIMESTAMP '{p.end:%Y-%m-%d %H:%M:%S}'")
        cond = " AND ".join(conds) if conds else "TRUE"
        if self.null_phase == p.name:
            cond = f"({cond} OR {ts} IS NULL)"
        return f"({cond})"


def with_phase(df: DataFrame, ts: str, calendar: PhaseCalendar,
               name: str = "phase", ordinal: str | None = None) -> DataFrame:
    out = df.withColumn(name, calendar.phase_col(ts))
    if ordinal:
        out = out.withColumn(ordinal, calendar.ordinal_col(name))
    return out


# The reference's calendar (Jan-May 2025 / Jun-Jul / Aug-Sep).
REFERENCE_CALENDAR = PhaseCalendar([
    (PRE, None, "2025-06-01", 5),
    (CRISIS, "2025-06-01", "2025-08-01", 2),
    (RECOVERY, "2025-08-01", None, 2),
])

# Calendar bound to the driver's order dates (1995-01 .. 2001-08).
DRIVER_CALENDAR = PhaseCalendar([
    (PRE, None, "2001-01-01", 72),
    (CRISIS, "2001-01-01", "2001-03-01", 2),
    (RECOVERY, "2001-03-01", None, 5),
])
