"""Activity bitmaps: one row per key with a bit per calendar month.

Whether a key was active in a span of months is a mask on its bits, so one
table answers distinct counts, churn and set differences between any two
phases or months, and tables of different input files are merged by OR (and
least, greatest, sum) without reading events again. The table has one shuffle
on the key, pre-combined in each task."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phaselens.functions.calendar import PhaseCalendar
from phaselens.functions.metrics import pct

WORD = 64


@dataclass(frozen=True)
class MonthSpan:
    """The months that bits stand for: bit 0 is ``first`` (and all earlier
    months), bit ``months - 1`` the last (and all later ones); one further bit
    marks events without a time."""

    first: dt.date
    months: int

    @classmethod
    def of(cls, calendar: PhaseCalendar) -> "MonthSpan":
        """From the first month that a calendar's phases count, as many months
        as fill the words that those need."""
        opening = calendar.phases[0]
        number = opening.end.year * 12 + opening.end.month - 1 - opening.months
        words = sum(p.months for p in calendar.phases) // WORD + 1
        return cls(dt.date(number // 12, number % 12 + 1, 1), words * WORD - 1)

    @property
    def undated(self) -> int:
        return self.months

    @property
    def words(self) -> list[str]:
        return [f"active_{i}" for i in range(self.months // WORD + 1)]

    def number(self, day: dt.date) -> int:
        return (day.year - self.first.year) * 12 + day.month - self.first.month

    def bit_sql(self, ts: str) -> str:
        month = f"(year(`{ts}`) - {self.first.year}) * 12 + month(`{ts}`) - {self.first.month}"
        return f"if(`{ts}` is null, {self.undated}, least(greatest({month}, 0), {self.months - 1}))"

    def mask(self, months) -> list[int]:
        """Words with the bits of the given months set, as signed LONGs."""
        bits = reduce(lambda a, m: a | 1 << m, months, 0)
        words = [bits >> WORD * i & (1 << WORD) - 1 for i in range(len(self.words))]
        return [w - (1 << WORD) if w >> (WORD - 1) else w for w in words]

    def phase_mask(self, calendar: PhaseCalendar, name: str) -> list[int]:
        """The months of a phase, whose bounds must be months' first days."""
        p = calendar.phase(name)
        bounds = []
        for at, open_end in ((p.start, p is calendar.phases[0]), (p.end, p is calendar.phases[-1])):
            if open_end:
                bounds.append(0 if not bounds else self.months)
            elif (at.day, at.hour, at.minute, at.second, at.microsecond) != (1, 0, 0, 0, 0):
                raise ValueError(f"phase {name!r} does not begin and end with a month")
            else:
                bounds.append(self.number(at))
        undated = [self.undated] if calendar.null_phase == name else []
        return self.mask([*range(*bounds), *undated])


def activity_bitmaps(df: DataFrame, key: str, ts: str, span: MonthSpan, extras: dict[str, Column] | None = None) -> DataFrame:
    """Per key: the words of its bits, ``first_ts``, ``last_ts``, ``events``,
    and further aggregates. A null key is a key like others."""
    dated = df.withColumn("_pl_bit", F.expr(span.bit_sql(ts)))
    words = [F.bit_or(F.expr(f"if(_pl_bit div {WORD} = {i}, shiftleft(1L, int(_pl_bit % {WORD})), 0L)")).alias(w)
             for i, w in enumerate(span.words)]
    return dated.groupBy(key).agg(*words, F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count(F.lit(1)).alias("events"),
                                  *[c.alias(n) for n, c in (extras or {}).items()])


def merge_bitmaps(tables: list[DataFrame], key: str, span: MonthSpan) -> DataFrame:
    """The table of all events from the tables of parts of them."""
    rows = reduce(lambda a, b: a.unionByName(b), [t.select(key, *span.words, "first_ts", "last_ts", "events") for t in tables])
    return rows.groupBy(key).agg(*[F.bit_or(w).alias(w) for w in span.words], F.min("first_ts").alias("first_ts"),
                                 F.max("last_ts").alias("last_ts"), F.sum("events").alias("events"))


def active_in(span: MonthSpan, mask: list[int]) -> Column:
    """Whether a key has a bit of the mask."""
    hits = [F.col(w).bitwiseAND(F.lit(m).cast("long")) != 0 for w, m in zip(span.words, mask) if m]
    return reduce(lambda a, b: a | b, hits) if hits else F.lit(False)


def months_active(span: MonthSpan, mask: list[int]) -> Column:
    """In how many months of the mask a key is active."""
    return reduce(lambda a, b: a + b, [F.bit_count(F.col(w).bitwiseAND(F.lit(m).cast("long"))) for w, m in zip(span.words, mask)])


def churn_from_bitmaps(bitmaps: DataFrame, span: MonthSpan, base: list[int], later: list[int],
                       names=("total", "churned", "retained", "churn_rate_pct"), where: Column | None = None) -> DataFrame:
    """One row: keys active in ``base`` (and ``where``), those of them not
    active in ``later``, those active, and the share that is not, in %."""
    total, churned, retained, rate = names
    member = active_in(span, base) if where is None else active_in(span, base) & where
    still = active_in(span, later)
    return (bitmaps.agg(F.count_if(member).cast("long").alias(total), F.count_if(member & ~still).cast("long").alias(churned),
                        F.count_if(member & still).cast("long").alias(retained))
            .withColumn(rate, pct(F.col(churned), F.col(total))))


def month_flow(bitmaps: DataFrame, span: MonthSpan) -> DataFrame:
    """Per month with activity: active keys, those active in the month before
    too (``retained``), active for the first time (``new``) or again after a
    pause (``returned``), and keys of the month before that are not active any
    more (``churned``; null in the first month)."""
    def has(m: Column) -> Column:
        bit = F.lit(0)
        for i, w in enumerate(span.words):
            bit = F.when(F.floor(m / WORD) == i, F.getbit(F.col(w), (m % WORD).cast("int"))).otherwise(bit)
        return bit == 1

    own = bitmaps.select(F.filter(F.sequence(F.lit(0), F.lit(span.months - 1)), has).alias("_m"))
    each = own.select(F.explode(F.transform("_m", lambda m: F.struct(
        m.alias("m"), F.array_contains("_m", m - 1).alias("before"), (m == F.array_min("_m")).alias("new")))).alias("x")).select("x.*")
    per = each.groupBy("m").agg(F.count(F.lit(1)).alias("active"), F.count_if("before").alias("retained"), F.count_if("new").alias("new"))
    # one row a month
    last = F.when(F.lag("m").over(Window.orderBy("m")) == F.col("m") - 1, F.lag("active").over(Window.orderBy("m"))).when(
        F.col("m") > 0, F.lit(0))
    number = F.col("m") + F.lit(span.first.year * 12 + span.first.month - 1)
    return per.select(F.format_string("%04d-%02d", F.floor(number / 12).cast("int"), (number % 12 + 1).cast("int")).alias("month"),
                      "active", "retained", "new", (F.col("active") - F.col("retained") - F.col("new")).alias("returned"),
                      (last - F.col("retained")).alias("churned"))
