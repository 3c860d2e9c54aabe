"""Phase comparison in one pass (conditional aggregation, no self-join)."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def phase_pivot(df: DataFrame, keys: list[str], phase_col: str,
                measures: dict[str, tuple[str, Callable[[Column], Column]]]) -> DataFrame:
    """One row per key with one column per (phase, measure).

    ``measures`` maps an output name to ``(phase, fn)``; ``fn`` receives the
    boolean "row is in that phase" and returns an aggregate, e.g.
    ``("Crisis", F.count_if)``. Replaces "split by phase, aggregate each,
    join the aggregates" with a single shuffle on ``keys``."""
    aggs = [fn(F.col(phase_col) == F.lit(phase)).alias(name) for name, (phase, fn) in measures.items()]
    return df.groupBy(*keys).agg(*aggs)


def count_in(cond: Column) -> Column:
    return F.count_if(cond).cast("long")
