"""Joins on the order key over bucketed tables."""

import pytest

from phaselens.plans import sql_script, sql_variants
from phaselens.plans.registry import driver_model
from phaselens.sources.layout import lay_out, laid_out

QUERIES = {"s05": lambda m: sql_variants.s05_sla_by_phase(m), "s08": lambda m: sql_variants.s08_monthly_rating(m),
           "s09": lambda m: sql_variants.s09_delay_vs_rating(m), "s10": lambda m: sql_variants.s10_recovery_scorecard(m)}
TEXTS = ("s05_sla_by_phase", "s08_monthly_rating", "s09_delay_vs_rating", "s10_recovery_scorecard")


@pytest.fixture(scope="module")
def models(spark, ref_model):
    driver = driver_model(spark, "/root/testdata/sf0.001")
    out = {"reference": (ref_model, lay_out(ref_model, "phaselens_laid_ref", 4)), "driver": (driver, lay_out(driver, "phaselens_laid", 6))}
    yield out
    for name in ("phaselens_laid_ref", "phaselens_laid"):
        spark.sql(f"DROP NAMESPACE IF EXISTS {name} CASCADE")


def _rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("binding", ["reference", "driver"])
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_results_are_unchanged_and_joins_need_no_exchange(spark, models, binding, name):
    plain, laid = models[binding]
    assert _rows(QUERIES[name](laid)) == _rows(QUERIES[name](plain))
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = next(t for t in TEXTS if t.startswith(name))
        for df in (QUERIES[name](laid), sql_script.run(spark, laid, text)):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "Bucketed: true" in plan
            below = plan[plan.index("SortMergeJoin"):]
            assert "Exchange" not in below, below[:600]
        assert _rows(sql_script.run(spark, laid, text)) == _rows(QUERIES[name](plain))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_a_bucket_is_one_sorted_file(spark, models):
    plain, laid = models["driver"]
    files = laid.orders.inputFiles()
    assert 0 < len(files) <= 6
    for f in files:
        ids = [r["order_id"] for r in spark.read.parquet(f).select("order_id").collect()]
        assert ids == sorted(ids)
    assert laid_out(plain, "phaselens_laid").orders.count() == plain.orders.count()
