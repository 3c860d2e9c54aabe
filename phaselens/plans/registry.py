"""Named queries over the driver's tables: name -> callable(spark, sf_dir)."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from phaselens.operators.profile import head_sample
from phaselens.plans import activity_plans as a
from phaselens.plans import extra_plans as x
from phaselens.plans import notebook_variants as p
from phaselens.plans import rfm_plans as r
from phaselens.plans import sql_script
from phaselens.plans import sql_variants as s
from phaselens.session import ensure_checkpoint_dir
from phaselens.sources.bindings import Model
from phaselens.sources.readers import read_parquet_table, read_reference_csv
from phaselens.sources.sinks import write_reference_csv, write_result

_MODEL_QUERIES = [
    s.s01_monthly_orders, s.s02_phase_revenue, s.s03_city_phase_cancel, s.s04_restaurant_decline,
    s.s05_sla_by_phase, s.s06_loyal_churn, s.s07_high_value_by_city, s.s08_monthly_rating,
    s.s09_delay_vs_rating, s.s10_recovery_scorecard,
    p.p01_order_trend, p.p01_decline_metrics, p.p02_city_decline, p.p02_unmatched_orders,
    p.p03_restaurant_decline, p.p04_phase_cancel, p.p04_city_cancel_crisis, p.p05_sla,
    p.p06_monthly_rating, p.p06_sharpest_drop, p.p07_negative_keywords, p.p08_revenue,
    p.p08_revenue_loss, p.p09_loyalty_churn, p.p09_churn_split, p.p10_high_value_profile,
    p.p10_hv_city, p.p10_hv_channel, p.p10_hv_cuisine, p.p10_hv_churn,
    r.r01_rfm_base, r.r02_rfm_describe, r.r03_rfm_scores, r.r04_score_distribution,
    r.r05_segments, r.r06_recoverable, r.r07_no_history,
    x.x01_behavior_shift, x.x02_negative_reviews, x.x03_restaurant_churn, x.x03_churn_partner_type,
    x.x03_churn_cuisine, x.x03_churn_active,
    x.d01_shapes, x.d02_null_totals, x.d03_null_columns, x.d04_dtypes, x.d05_phase_counts,
    x.d06_month_counts, x.d07_date_range, x.d08_after_dropna,
    x.m01_active_customers, x.m02_city_absolute_loss, x.m03_city_share,
    a.a01_month_flow, a.a02_phase_patterns, a.a03_churn_matrix, a.j01_city_cancel_salted,
]
SQL_TEXTS = ("s01_monthly_orders", "s02_phase_revenue", "s03_city_phase_cancel", "s04_restaurant_decline",
             "s05_sla_by_phase", "s06_loyal_churn", "s07_high_value_by_city", "s08_monthly_rating",
             "s09_delay_vs_rating", "s10_recovery_scorecard")


_MODELS: dict[tuple[str, str], Model] = {}


def driver_model(spark: SparkSession, sf_dir: str) -> Model:
    """One lazily-built model per (session, data folder): views a query has
    already analysed are reused by the next query."""
    key = (spark.sparkContext.applicationId, sf_dir)
    for old in [k for k in _MODELS if k[0] != key[0]]:  # of sessions that have ended
        del _MODELS[old]
    if key not in _MODELS:
        _MODELS[key] = Model.from_driver(spark, sf_dir)
    return _MODELS[key]


def _on_model(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(driver_model(spark, sf_dir))
    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    return run


def _on_events(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(read_parquet_table(spark, sf_dir, "events"))
    run.__name__ = fn.__name__
    return run


def _on_script(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return sql_script.run(spark, driver_model(spark, sf_dir), name)
    run.__name__ = f"sql_{name}"
    return run


def d09_head_orders(m: Model) -> DataFrame:
    """The first ten orders by id (the head sample of the data overview)."""
    return head_sample(m.orders, ["order_id"], 10)


def k01_written_trend(m: Model) -> DataFrame:
    """The monthly order trend, written partitioned by phase and read again."""
    spark = m.orders.sparkSession
    path = os.path.join(ensure_checkpoint_dir(spark), "phaselens", f"trend-{uuid.uuid4().hex}")
    trend = s.s01_monthly_orders(m)
    write_result(trend, path, partition_by=["business_phase"])
    return spark.read.schema(trend.schema).parquet(path)


def _from_csv(m: Model, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables, written as the reference's CSV files and read again."""
    spark = m.orders.sparkSession
    folder = os.path.join(ensure_checkpoint_dir(spark), "phaselens", f"csv-{uuid.uuid4().hex}")
    write_reference_csv(tables, folder)
    return read_reference_csv(spark, folder, list(tables))


def c01_csv_phase_revenue(m: Model) -> DataFrame:
    """``s02_phase_revenue`` over orders that went through a CSV file."""
    orders = _from_csv(m, {"fact_orders": m.orders_full})["fact_orders"]
    return s.s02_phase_revenue(Model({"orders": orders}, m.calendar, m.params))


def c02_csv_negative_keywords(m: Model) -> DataFrame:
    """``p07_negative_keywords`` over orders and ratings that went through CSV
    files; the review texts hold line breaks, quotes and commas."""
    read = _from_csv(m, {"fact_orders": m.orders_full, "fact_ratings": m.ratings})
    return p.p07_negative_keywords(Model({"orders": read["fact_orders"], "ratings": read["fact_ratings"]}, m.calendar, m.params))


def c03_namespace_scorecard(m: Model) -> DataFrame:
    """The SQL text of ``s10_recovery_scorecard`` over a table written into a
    namespace, in a session of its own (no temp view, no change of the
    caller's current namespace)."""
    spark = m.orders.sparkSession
    name, before = f"phaselens_{uuid.uuid4().hex}", spark.catalog.currentDatabase()
    try:
        sql_script.create_tables(m, name, ("order_service",), os.path.join(ensure_checkpoint_dir(spark), "phaselens", name))
    finally:
        spark.sql(f"USE `{before}`")
    own = spark.newSession()
    own.sql(f"USE {name}")
    return own.sql(sql_script.script(m.calendar, m.params)["s10_recovery_scorecard"])


def model_queries() -> dict[str, Callable[[Model], DataFrame]]:
    """The named queries as functions of a bound :class:`Model` (any
    binding: the reference's own tables or the driver's)."""
    return {fn.__name__: fn for fn in _MODEL_QUERIES}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {fn.__name__: _on_model(fn) for fn in _MODEL_QUERIES}
    out |= {fn.__name__: _on_model(fn) for fn in (
        d09_head_orders, k01_written_trend, c01_csv_phase_revenue, c02_csv_negative_keywords, c03_namespace_scorecard)}
    out |= {f"sql_{name}": _on_script(name) for name in SQL_TEXTS}
    out["r01_rfm_base_events"] = _on_events(r.r01_rfm_base_events)
    out["r02_rfm_describe_events"] = _on_events(r.r02_rfm_describe_events)
    return out


FLAGSHIP = "s02_phase_revenue"
