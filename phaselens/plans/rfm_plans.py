"""RFM segmentation queries (r01-r07) on orders, and on the events table."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phaselens.functions.metrics import exact_mean, yn_flag
from phaselens.operators.profile import describe_exact
from phaselens.operators.rank import keep_columns
from phaselens.operators.rfm import RECOVERABLE, SEGMENT_ORDER, rfm_base, rfm_scores, segment_col
from phaselens.sources.bindings import Model


def r01_rfm_base(m: Model) -> DataFrame:
    kept = m.orders.where(~yn_flag("is_cancelled"))
    return rfm_base(kept, "customer_id", "order_timestamp", "total_amount",
                    m.params.rfm_reference_date, order_id="order_id")


def _describe(base: DataFrame) -> DataFrame:
    return describe_exact(keep_columns(base), ["recency", "frequency", "monetary"], scales={"monetary": 2})


def r02_rfm_describe(m: Model) -> DataFrame:
    return _describe(r01_rfm_base(m))


def r03_rfm_scores(m: Model) -> DataFrame:
    return rfm_scores(r01_rfm_base(m), "customer_id")


def score_distribution(scores: DataFrame) -> DataFrame:
    return scores.groupBy("rfm_score").agg(F.count(F.lit(1)).alias("customers")).orderBy("rfm_score")


def r04_score_distribution(m: Model) -> DataFrame:
    return score_distribution(r03_rfm_scores(m))


def segment_summary(scores: DataFrame) -> DataFrame:
    """Per segment, in the fixed display order; a segment with no customer
    still appears, with NULL figures (pandas ``reindex``)."""
    seg = scores.withColumn("segment", segment_col("rfm_score"))
    summary = seg.groupBy("segment").agg(
        F.count("customer_id").alias("customer_count"),
        exact_mean("recency", 1, in_scale=0).alias("avg_recency"),
        exact_mean("frequency", 2, in_scale=0).alias("avg_frequency"),
        exact_mean("monetary", 2).alias("avg_monetary"))
    # The display order is the fixed segment list, built from that list's
    # literals next to the data.
    order = summary.sparkSession.createDataFrame(
        [(name, i) for i, name in enumerate(SEGMENT_ORDER, start=1)], "segment string, display_order int")
    # (at most five rows on the right of the left join, broadcast)
    return (order.join(F.broadcast(summary), "segment", "left")
            .select("segment", "customer_count", "avg_recency", "avg_frequency", "avg_monetary",
                    "display_order")
            .orderBy("display_order"))


def r05_segments(m: Model) -> DataFrame:
    return segment_summary(r03_rfm_scores(m))


def recoverable(scores: DataFrame) -> DataFrame:
    seg = scores.withColumn("segment", segment_col("rfm_score"))
    return seg.agg(F.count_if(F.col("segment").isin(*RECOVERABLE)).cast("long").alias("recoverable_customers"),
                   F.count(F.lit(1)).alias("total_customers"))


def r06_recoverable(m: Model) -> DataFrame:
    return recoverable(r03_rfm_scores(m))


def r07_no_history(m: Model) -> DataFrame:
    """Dimension customers with no (non-cancelled) order: an anti join, not
    a hard-coded dimension size."""
    active = r01_rfm_base(m).select("customer_id")
    dim = m.customers.select("customer_id")
    return (dim.join(active, "customer_id", "left_anti")
            .agg(F.count(F.lit(1)).alias("customers_without_orders")))


# -- second binding: the events table (microsecond timestamps) -------------
EVENTS_REFERENCE_DATE = dt.datetime(2024, 2, 1)


def events_rfm_base(events: DataFrame, reference_date: dt.datetime = EVENTS_REFERENCE_DATE) -> DataFrame:
    return rfm_base(events.select(F.col("user_id").alias("customer_id"), "ts", "value"),
                    "customer_id", "ts", "value", reference_date)


def r01_rfm_base_events(events: DataFrame) -> DataFrame:
    """Per user: recency in whole elapsed days (floored: an event 14 hours
    before the reference date is 0 days old), events, summed value."""
    return events_rfm_base(events)


def r02_rfm_describe_events(events: DataFrame) -> DataFrame:
    return _describe(events_rfm_base(events))
