"""Recency / frequency / monetary scoring and segmentation."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phaselens.functions.metrics import EXACT
from phaselens.operators.binning import assign_bins, bin_label, edge_probs, edge_spec, rank_bin_ends, rank_bins
from phaselens.operators.rank import keep_columns
from phaselens.operators.select import group_of, order_digits, quantiles

# Segment ladder on the summed score (3..9), best first.
SEGMENTS = (
    ("Champions", 8),
    ("Loyal", 6),
    ("At Risk", 5),
    ("Needs Attention", 4),
    ("Lost", None),
)
SEGMENT_ORDER = tuple(name for name, _ in SEGMENTS)
RECOVERABLE = ("Champions", "Loyal", "At Risk")

_DAY_US = 86_400_000_000


def elapsed_days(start_col: str, end_sql: str) -> Column:
    """Whole days from column ``start_col`` to SQL expression ``end_sql``,
    floored like Python's ``timedelta.days`` (14 hours -> 0, -14 hours -> -1).

    ``timestampdiff`` on TIMESTAMP_NTZ is time-zone free, unlike a cast to
    TIMESTAMP, which would shift across daylight-saving changes."""
    diff = F.expr(f"timestampdiff(MICROSECOND, `{start_col}`, {end_sql})")
    return F.floor(diff / F.lit(_DAY_US)).cast("long")


def rfm_base(df: DataFrame, key: str, ts: str, amount: str, reference_date: dt.datetime,
             order_id: str | None = None) -> DataFrame:
    """Per key: recency (days from the last event to the reference date),
    frequency (events), monetary (exact sum, 2 decimals)."""
    ref = f"TIMESTAMP_NTZ'{reference_date:%Y-%m-%d %H:%M:%S.%f}'"
    freq = F.count(F.col(order_id)) if order_id else F.count(F.lit(1))
    # NULL keys drop out, as in a pandas groupby
    return (df.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.max(ts).alias("_pl_last"),
        freq.cast("long").alias("frequency"),
        F.round(F.sum(F.col(amount).cast(EXACT)), 2).alias("_pl_money"))
        .select(key, elapsed_days("_pl_last", ref).alias("recency"), "frequency",
                F.col("_pl_money").cast("double").alias("monetary")))


def rfm_scores(base: DataFrame, key: str, q: int = 3) -> DataFrame:
    """r/f/m scores 1..q and their sum. Recency: fewer days is better
    (reversed labels); frequency: qcut of the first-occurrence rank, ties
    in key order; monetary: qcut of the value.

    The edges of recency and monetary (whole cents) and the ends of the
    frequency bins are selected in the same passes; no row is moved but where
    a text key breaks the ties of the frequency."""
    up = list(range(1, q + 1))
    base = keep_columns(base)  # the passes below share one aggregation
    probs = {c: edge_probs(q) for c in ("recency", "monetary")}
    order = [("frequency", True)]
    digits = order_digits(base, order, key)
    also = {"frequency": rank_bin_ends(digits, q)} if digits else {}
    found = quantiles(base, probs, {"monetary": 2}, also)
    edges = found.select(F.struct(*[edge_spec(F.col(c), q).alias(c) for c in probs], *[F.col(c) for c in also])).scalar()
    scored = base if digits else rank_bins(base, order, key, q, up, "f_score")
    scored = scored.withColumn("_pl_edges", edges)
    if digits:
        scored = scored.withColumn("f_score", bin_label(group_of(digits, F.col("_pl_edges.frequency"), q), up))
    scored = assign_bins(scored, "recency", F.col("_pl_edges.recency"), up[::-1], "r_score")
    scored = assign_bins(scored, "monetary", F.col("_pl_edges.monetary"), up, "m_score")
    return scored.select(key, "recency", "frequency", "monetary", "r_score", "f_score", "m_score",
                         (F.col("r_score") + F.col("f_score") + F.col("m_score")).cast("int").alias("rfm_score"))


def segment_col(score: Column | str) -> Column:
    s = F.col(score) if isinstance(score, str) else score
    expr = None
    for name, floor in SEGMENTS:
        if floor is None:
            expr = expr.otherwise(F.lit(name))
        else:
            expr = F.when(s >= floor, F.lit(name)) if expr is None else expr.when(s >= floor, F.lit(name))
    return expr
