"""Churn of a key set between two activity sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phaselens.functions.metrics import pct


def flag_active(base: DataFrame, active: DataFrame, key: str, flag: str = "is_active") -> DataFrame:
    """``base`` plus a boolean: is the key among ``active``'s keys?

    A left join against the distinct active keys (not ``isin`` of a
    collected list), so both sides stay distributed."""
    act = active.select(key).distinct().withColumn(flag, F.lit(True))
    return base.join(act, key, "left").withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))


def churn_summary(base: DataFrame, active: DataFrame, key: str,
                  names=("total", "churned", "retained", "churn_rate_pct")) -> DataFrame:
    """One row: base size, churned (absent from ``active``), retained, rate %."""
    return churn_counts(flag_active(base, active, key, "_pl_act"), key, F.col("_pl_act"), names)


def churn_counts(flagged: DataFrame, key: str, active: Column,
                 names=("total", "churned", "retained", "churn_rate_pct")) -> DataFrame:
    """:func:`churn_summary` of keys whose activity is a boolean already."""
    total, churned, retained, rate = names
    return flagged.agg(
        F.count(F.col(key)).alias(total),
        F.count_if(~active).cast("long").alias(churned),
        F.count_if(active).cast("long").alias(retained),
    ).withColumn(rate, pct(F.col(churned), F.col(total)))


def key_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distinct keys of ``a`` not in ``b`` (set difference, EXCEPT DISTINCT)."""
    return a.select(key).distinct().join(b.select(key), key, "left_anti")
