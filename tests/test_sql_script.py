"""The SQL-text front end returns exactly what the DataFrame queries do."""

import pytest

from phaselens.plans import sql_script, sql_variants
from phaselens.plans.registry import driver_model
from phaselens.functions.calendar import REFERENCE_CALENDAR

NAMES = sorted(sql_script.script(REFERENCE_CALENDAR))


def _same(a, b):
    assert a.columns == b.columns
    assert sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)


@pytest.mark.parametrize("name", NAMES)
def test_sql_text_equals_dataframe_on_reference_fixture(spark, ref_model, name):
    _same(sql_script.run(spark, ref_model, name), getattr(sql_variants, name)(ref_model))


@pytest.mark.parametrize("name", NAMES)
def test_sql_text_equals_dataframe_on_driver_tables(spark, name):
    m = driver_model(spark, "/root/testdata/sf0.001")
    _same(sql_script.run(spark, m, name), getattr(sql_variants, name)(m))


def test_namespace_holds_the_tables(spark, ref_model):
    for view in sql_script.script_tables(ref_model):
        spark.catalog.dropTempView(view)
    before = spark.catalog.currentDatabase()
    try:
        sql_script.create_tables(ref_model, "phaselens_demo")
        assert spark.catalog.currentDatabase() == "phaselens_demo"
        text = sql_script.script(ref_model.calendar, ref_model.params)["s06_loyal_churn"]
        assert spark.sql(text).collect() == sql_variants.s06_loyal_churn(ref_model).collect()
    finally:
        spark.sql(f"USE {before}")
        spark.sql("DROP NAMESPACE IF EXISTS phaselens_demo CASCADE")
