"""Salted joins against plain ones, and how evenly their rows are dealt."""

import pytest
from pyspark.sql import functions as F

from phaselens.operators.heavy import heavy_keys, salted_join
from phaselens.plans import activity_plans, sql_variants
from phaselens.plans.registry import driver_model


def _orders(spark, n=30000, kind="long"):
    """A third on one key, a third without one, the rest spread out."""
    return spark.range(n).select(
        F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 1, F.lit(None)).otherwise(F.col("id") % 4001).cast(kind).alias("k"),
        F.col("id").alias("o"))


def _dim(spark, kind="long"):
    rows = spark.range(0, 4001, 2).select(F.col("id").cast(kind).alias("k"), F.concat(F.lit("c"), F.col("id") % 9).alias("city"))
    return rows.unionByName(spark.range(1).select(F.lit(7).cast(kind).alias("k"), F.lit("hot").alias("city"))).unionByName(
        spark.range(1).select(F.lit(None).cast(kind).alias("k"), F.lit("nobody").alias("city")))


@pytest.mark.parametrize("kind", ["long", "string"])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_same_rows_as_a_plain_join(spark, how, kind):
    left, right = _orders(spark, 6000, kind), _dim(spark, kind)
    right = right.unionByName(right.where("city = 'c2'"))  # several rows a key
    got, want = salted_join(left, right, "k", how), left.join(right, "k", how)
    assert got.columns == want.columns and got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    assert salted_join(left.limit(0), right, "k", how).count() == 0
    with pytest.raises(ValueError):
        salted_join(left, right, "k", "full")


def test_heavy_keys_are_named(spark):
    rows = _orders(spark)
    assert rows.select(heavy_keys(rows, "k", 0.05).alias("h")).first()["h"] == [7]
    even = spark.range(5000).withColumnRenamed("id", "k")
    assert not even.select(heavy_keys(even, "k", 0.05).alias("h")).first()["h"]


@pytest.mark.parametrize("how", ["inner", "left"])
def test_no_task_is_three_times_the_median(spark, how):
    """A third of the rows on one key and a third on NULL, without run-time
    splitting."""
    settings = {"spark.sql.adaptive.skewJoin.enabled": "false", "spark.sql.adaptive.enabled": "false",
                "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8"}
    old = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        joined = salted_join(_orders(spark).repartition(4), _dim(spark), "k", how, salts=64)
        sizes = sorted(r["count"] for r in joined.where("k is not null").groupBy(F.spark_partition_id().alias("p")).count().collect())
        assert len(sizes) == 8 and sizes[-1] <= 3 * sizes[len(sizes) // 2], sizes
        plain = sorted(r["count"] for r in _orders(spark).join(_dim(spark), "k").groupBy(F.spark_partition_id().alias("p")).count().collect())
        assert plain[-1] > 3 * plain[len(plain) // 2]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("binding", ["reference", "driver"])
def test_queries_over_salted_joins(spark, ref_model, binding):
    """s03 and the line items of restaurants, joined by heavy keys."""
    m = ref_model if binding == "reference" else driver_model(spark, "/root/testdata/sf0.001")
    got = activity_plans.j01_city_cancel_salted(m)
    want = sql_variants.s03_city_phase_cancel(m)
    assert got.columns == want.columns and sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    lines = salted_join(m.order_lines, m.restaurants.select("restaurant_id", "cuisine_type"), "restaurant_id", "left", share=0.05)
    plain = m.order_lines.join(m.restaurants.select("restaurant_id", "cuisine_type"), "restaurant_id", "left")
    assert lines.groupBy("cuisine_type").count().exceptAll(plain.groupBy("cuisine_type").count()).count() == 0
    unmatched = salted_join(m.orders.select("customer_id", "order_id"), m.customers.select("customer_id", "city"), "customer_id", "left")
    assert unmatched.where("city is null").count() == m.orders.select("customer_id", "order_id").join(
        m.customers.select("customer_id", "city"), "customer_id", "left").where("city is null").count()
