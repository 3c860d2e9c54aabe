"""Cross-variant identities and invariants on the driver binding."""

from pyspark.sql import functions as F

import __spark_entry__ as E
from phaselens.functions.calendar import CRISIS, PRE
from phaselens.plans.registry import driver_model

SF = "/root/testdata/sf0.001"


def _q(spark, name):
    return E.queries()[name](spark, SF)


def test_sql_and_notebook_trends_agree(spark):
    a = {(r.order_month, r.business_phase, r.total_orders) for r in _q(spark, "s01_monthly_orders").collect()}
    b = {(r.month, r.phase, r.total_orders) for r in _q(spark, "p01_order_trend").collect()}
    assert a == b


def test_revenue_variants_agree(spark):
    a = {r.business_phase: (r.total_orders, r.total_revenue, r.avg_order_value)
         for r in _q(spark, "s02_phase_revenue").collect()}
    b = {r.phase: (r.total_orders, r.total_revenue, r.avg_order_value) for r in _q(spark, "p08_revenue").collect()}
    assert a == b


def test_churn_variants_agree(spark):
    s = _q(spark, "s06_loyal_churn").first()
    p = _q(spark, "p09_loyalty_churn").first()
    assert (s.total_loyal_customers, s.churned_loyal_customers) == (p.repeat_customers, p.churned_customers)
    assert s.churned_loyal_customers + s.retained_loyal_customers == s.total_loyal_customers
    split = _q(spark, "p09_churn_split").first()
    assert split.churned_rating_above + split.churned_not_above == split.churned


def test_restaurant_pair_differs_only_by_zero_crisis_rows(spark):
    m = driver_model(spark, SF)
    cal = m.calendar
    lines = m.order_lines
    per = lines.groupBy("restaurant_id").agg(F.count_if(cal.between("order_timestamp", PRE)).alias("pre"),
                                             F.count_if(cal.between("order_timestamp", CRISIS)).alias("cri"))
    eligible = per.where(F.col("pre") >= m.params.restaurant_min_pre_orders)
    zero = {r.restaurant_id for r in eligible.where(F.col("cri") == 0).collect()}
    left = {r.restaurant_id for r in _q(spark, "s04_restaurant_decline").collect()}
    inner = {r.restaurant_id for r in _q(spark, "p03_restaurant_decline").collect()}
    assert not (inner & zero)
    n_eligible = eligible.count()
    assert n_eligible >= 1
    if n_eligible <= m.params.top_restaurants:  # no top-k cut: the sets are complete
        assert left - zero == inner and zero <= left


def test_phases_partition_the_orders(spark):
    counts = {r.phase: r.orders for r in _q(spark, "d05_phase_counts").collect()}
    assert sum(counts.values()) == driver_model(spark, SF).orders.count()
    assert set(counts) <= {"Pre-Crisis", "Crisis", "Recovery"}


def test_segments_and_scores_sum_to_customers(spark):
    n = _q(spark, "r01_rfm_base").count()
    assert sum(r.customer_count or 0 for r in _q(spark, "r05_segments").collect()) == n
    assert sum(r.customers for r in _q(spark, "r04_score_distribution").collect()) == n
    rec = _q(spark, "r06_recoverable").first()
    assert rec.total_customers == n and 0 <= rec.recoverable_customers <= n


def test_profile_totals_match_columns(spark):
    totals = {r.table_name: r.null_values for r in _q(spark, "d02_null_totals").collect()}
    per_col = _q(spark, "d03_null_columns").groupBy("table_name").agg(F.sum("null_count").alias("s")).collect()
    for r in per_col:
        assert totals[r.table_name] == r.s
    shapes = {r.table_name: r.rows for r in _q(spark, "d01_shapes").collect()}
    for r in _q(spark, "d04_dtypes").collect():
        assert 0 <= r.non_null <= shapes[r.table_name]
