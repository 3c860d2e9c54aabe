"""Plan shape: native expressions only, no pairwise joins, pushdown and
pruning reach the scan, and the distributed rank has no global sort."""

import pytest

import __spark_entry__ as E
from phaselens.plans import registry

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_no_python_udf_no_cartesian(spark, name):
    plan = _plan(E.queries()[name](spark, SF))
    for bad in ("PythonUDF", "BatchEvalPython", "ArrowEvalPython", "CartesianProduct"):
        assert bad not in plan, (name, bad)


def test_phase_filter_and_pruning_reach_the_scan(spark):
    plan = _plan(E.queries()["s06_loyal_churn"](spark, SF))
    assert "LessThan(o_orderdate" in plan  # pre-crisis range pushed into Parquet
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_orderdate:timestamp_ntz>" in plan or \
        "o_totalprice" not in plan.split("ReadSchema")[1].split("\n")[0]


@pytest.mark.parametrize("name", ["s07_high_value_by_city", "sql_s07_high_value_by_city", "p10_hv_city", "m03_city_share", "r02_rfm_describe",
                                  "r03_rfm_scores", "r05_segments", "r02_rfm_describe_events"])
def test_tiles_quantiles_and_bins_move_no_rows(spark, name):
    """No rank is computed and no row is dealt by ranges: the only windows
    run over bin counts."""
    df = E.queries()[name](spark, SF)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "_pl_bucket" not in plan and "row_number" not in plan and "_pl_cnt" in plan
    windows = [line for line in plan.splitlines() if " Window [" in line]
    # m03 has a running sum over its few cities besides
    assert windows and all("upto" in w or w.strip(" +-:*").startswith("Window [sum(customers#") for w in windows)


@pytest.mark.parametrize("name", ["p06_monthly_rating", "p06_sharpest_drop", "x02_negative_reviews"])
def test_review_times_are_parsed_by_one_form(spark, name):
    plan = E.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("regexp_") + plan.count("rlike") <= 20 and len(plan) < 40_000


@pytest.mark.parametrize("name", ["d02_null_totals", "d04_dtypes", "s09_delay_vs_rating", "s10_recovery_scorecard",
                                  "sql_s09_delay_vs_rating", "sql_s10_recovery_scorecard"])
def test_line_items_are_rolled_up_once(spark, name):
    plan = _plan(E.queries()[name](spark, SF))
    assert plan.count("partial_sum") and plan.count("hashpartitioning(l_orderkey") <= 1


def _single_partition_children(plan: str) -> list[str]:
    lines = plan.splitlines()
    return [lines[i + 1] for i, line in enumerate(lines)
            if "Exchange SinglePartition" in line and "ReusedExchange" not in line and i + 1 < len(lines)]


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_single_partition_only_over_bounded_data(spark, name):
    """As on a large cluster (no automatic broadcast): a single-partition
    exchange may only carry partial aggregates, the bin counts of a rank
    selection, the per-bucket table, the table of phases (m01), or (p06, a01)
    a month-level table."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = _plan(E.queries()[name](spark, SF))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    for child in _single_partition_children(plan):
        ok = ("partial_" in child or "_pl_bucket" in child
              or "_pl_v" in child or "_pl_cnt" in child or (name == "m01_active_customers" and "phase" in child)
              or (name == "a01_month_flow" and "retained#" in child)
              or (name == "p06_sharpest_drop" and ("Sort [month" in child or "output=[month#" in child)))
        assert ok, (name, child.strip()[:200])
