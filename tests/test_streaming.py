"""The streaming trend equals the batch queries over the same orders."""

import os

from pyspark.sql import functions as F

import __spark_entry__ as E
from phaselens.functions.calendar import DRIVER_CALENDAR
from phaselens.streaming.phase_stream import driver_order_stream, phase_month_trend, read_trend, start_trend_query, write_trend

SF = "/root/testdata/sf0.001"


def test_stream_trend_equals_batch(spark, tmp_path):
    scratch = str(tmp_path)
    out = os.path.join(scratch, "trend")
    trend = phase_month_trend(driver_order_stream(spark, SF), DRIVER_CALENDAR)
    q = start_trend_query(trend, out, name="trend_test", checkpoint=os.path.join(scratch, "ckpt"))
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = read_trend(spark, out)
    batch = E.queries()["s01_monthly_orders"](spark, SF)
    a = {(r.order_month, r.business_phase): r.total_orders for r in got.collect()}
    b = {(r.order_month, r.business_phase): r.total_orders for r in batch.collect()}
    assert a == b
    rev = {r.business_phase: r.total_revenue for r in E.queries()["s02_phase_revenue"](spark, SF).collect()}
    per_phase = got.groupBy("business_phase").agg(F.sum("kept_revenue").alias("r")).collect()
    for r in per_phase:
        assert abs(r.r - rev[r.business_phase]) < 0.01  # per-month revenues are exact cents


def test_a_replayed_batch_changes_nothing_and_old_ones_go(spark, tmp_path):
    out = str(tmp_path / "trend")
    tables = [spark.createDataFrame([(f"2001-0{i}", i)], "order_month string, n long") for i in range(1, 5)]
    for i, t in enumerate(tables):
        write_trend(t, out, i)
    write_trend(tables[3], out, 3)  # replayed
    assert [tuple(r) for r in read_trend(spark, out).collect()] == [("2001-04", 4)]
    assert sorted(os.listdir(out)) == ["batch_id=2", "batch_id=3"]
