"""Joins whose heavy keys are known before the join.

A mergeable summary of frequent items (a bounded number of counters a task,
merged in one small aggregate) names the keys that hold more than a share of
the rows. Rows of these keys are dealt to ``salts`` tasks and the matching rows
of the other side are copied as often; rows of all other keys are joined as
they are, and rows without a key never reach the join. So the largest task
does not depend on a run-time split of skewed partitions. The list of heavy
keys decides only where rows meet, never which rows do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Items that a task's summary tracks: bounds its size and that of the merge.
TRACKED = 4096


def heavy_keys(df: DataFrame, key: str, share: float) -> Column:
    """A scalar array of the keys that hold ``share`` of the rows with a key,
    or more, as far as the summary can tell (its counts are off by about
    1 / ``TRACKED`` of the rows). At most 1 / share keys."""
    most = max(1, min(1000, int(1 / share)))
    own = df.where(F.col(key).isNotNull())
    found = own.agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(`{key}`, {most}, {TRACKED})").alias("top"))
    heavy = F.filter("top", lambda x: x["count"] >= F.col("n") * F.lit(share))
    return found.select(F.transform(heavy, lambda x: x["item"]).alias("keys")).scalar()


def salted_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", *, share: float = 0.01, salts: int = 32) -> DataFrame:
    """``left.join(right, key, how)`` for ``inner`` and ``left`` joins, where
    ``left`` may have heavy keys. Columns and rows are the same."""
    if how not in ("inner", "left"):
        raise ValueError(f"salted_join can't do a {how!r} join")
    keyed = left.where(F.col(key).isNotNull())
    heavy = heavy_keys(left, key, share)
    is_heavy = F.coalesce(F.array_contains("_pl_heavy", F.col(key)), F.lit(False))
    dealt = F.when(is_heavy, (F.monotonically_increasing_id() % salts).cast("int")).otherwise(F.lit(0))
    rows = keyed.withColumn("_pl_heavy", heavy).withColumn("_pl_salt", dealt).drop("_pl_heavy")
    copies = F.when(is_heavy, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    others = (right.where(F.col(key).isNotNull()).withColumn("_pl_heavy", heavy).withColumn("_pl_salt", F.explode(copies)).drop("_pl_heavy"))
    joined = rows.join(others, [key, "_pl_salt"], how).drop("_pl_salt")
    if how == "inner":
        return joined
    return joined.unionByName(left.where(F.col(key).isNull()), allowMissingColumns=True)
