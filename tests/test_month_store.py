"""The month store against the full queries, file by file."""

import datetime as dt
import glob
import os
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from phaselens.functions.calendar import REFERENCE_CALENDAR
from phaselens.plans import sql_variants
from phaselens.sources.bindings import Model
from phaselens.streaming.month_store import MonthStore, order_files

ORDERS = "order_id string, customer_id string, order_timestamp timestamp_ntz, total_amount decimal(18,2), is_cancelled string"


def _orders(seed, months, n=60):
    rnd = random.Random(seed)
    return [(f"O{seed}-{i}", rnd.choice(["C1", "C2", "C3", "C9", None]),
             None if rnd.random() < 0.03 else dt.datetime(2025, rnd.choice(months), rnd.randint(1, 28), rnd.randint(0, 23)),
             rnd.choice([Decimal(rnd.randint(100, 90000)) / 100, None]), rnd.choice(["Y", "N", "N", "N", None])) for i in range(n)]


@pytest.fixture
def store(spark, tmp_path):
    data, folder = str(tmp_path / "orders"), str(tmp_path / "store")
    os.mkdir(data)
    customers = spark.createDataFrame([("C1", "Pune"), ("C2", None), ("C3", "Delhi")], "customer_id string, city string")

    def load(paths):
        return spark.read.schema(ORDERS).parquet(*paths).withColumn("file", F.col("_metadata.file_path"))

    return data, folder, MonthStore(spark, folder, REFERENCE_CALENDAR, customers, load), customers


def _write(spark, data, name, rows):
    tmp = os.path.join(data, f".{name}-tmp")
    spark.createDataFrame(rows, ORDERS).coalesce(1).write.mode("overwrite").parquet(tmp)
    os.replace(glob.glob(os.path.join(tmp, "part-*.parquet"))[0], os.path.join(data, f"{name}.parquet"))


def _check(spark, data, s, customers, rows):
    m = Model({"orders": spark.createDataFrame(rows, ORDERS), "customers": customers}, REFERENCE_CALENDAR)
    for got, want in ((s.monthly_orders(), sql_variants.s01_monthly_orders(m)), (s.phase_revenue(), sql_variants.s02_phase_revenue(m)),
                      (s.city_cancellations(), sql_variants.s03_city_phase_cancel(m))):
        assert got.columns == want.columns
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def _times(folder):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(os.path.join(folder, "parts", "*", "order_month=*", "*.parquet"))}


def test_updates_write_affected_months_only(spark, store):
    data, folder, s, customers = store
    one, two = _orders(1, [1, 2, 5, 6]), _orders(2, [6, 8])
    _write(spark, data, "one", one)
    _write(spark, data, "two", two)
    first = s.update(order_files(spark, data))
    assert set(first) >= {"2025-01", "2025-06", "2025-08"}
    _check(spark, data, s, customers, one + two)

    before = _times(folder)
    assert s.update(order_files(spark, data)) == [] and _times(folder) == before and s.versions() == [1]

    three = [r for r in _orders(3, [7]) if r[2]]  # one month of orders comes
    _write(spark, data, "three", three)
    assert s.update(order_files(spark, data)) == ["2025-07"]
    after = _times(folder)
    assert {f: t for f, t in after.items() if f in before} == before
    assert all("order_month=2025-07" in f for f in after if f not in before) and len(after) > len(before)
    _check(spark, data, s, customers, one + two + three)

    four = [r for r in _orders(4, [6]) if r[2]]  # more of a month that is there
    _write(spark, data, "four", four)
    assert s.update(order_files(spark, data)) == ["2025-06"]
    _check(spark, data, s, customers, one + two + three + four)


def test_changed_and_removed_files_are_counted_again(spark, store):
    data, folder, s, customers = store
    one, two = _orders(1, [1, 2]), [r for r in _orders(2, [2, 3]) if r[2]]
    _write(spark, data, "one", one)
    _write(spark, data, "two", two)
    s.update(order_files(spark, data))
    changed = [r for r in _orders(5, [3, 4], 80) if r[2]]
    _write(spark, data, "two", changed)
    assert s.update(order_files(spark, data)) == ["2025-02", "2025-03", "2025-04"]
    _check(spark, data, s, customers, one + changed)
    os.remove(os.path.join(data, "two.parquet"))
    s.update(order_files(spark, data))
    _check(spark, data, s, customers, one)
    assert not s.table().where("order_month in ('2025-03', '2025-04')").count()
    s.update(order_files(spark, data), again=True)
    _check(spark, data, s, customers, one)


def test_a_reader_keeps_its_version_and_a_dead_update_leaves_nothing(spark, store):
    data, folder, s, customers = store
    one, two = _orders(1, [1]), _orders(2, [1, 2])
    _write(spark, data, "one", one)
    s.update(order_files(spark, data))
    held = s.table()
    want = sorted(map(str, held.collect()))
    _write(spark, data, "two", two)
    publish, s._publish = s._publish, lambda *a: (_ for _ in ()).throw(RuntimeError("lost"))
    with pytest.raises(RuntimeError):
        s.update(order_files(spark, data))
    assert s.versions() == [1] and sorted(map(str, s.table().collect())) == want
    s._publish = publish
    s.update(order_files(spark, data))
    assert s.versions() == [1, 2] and sorted(map(str, held.collect())) == want
    _check(spark, data, s, customers, one + two)


def test_an_empty_store(spark, store):
    data, folder, s, customers = store
    assert s.table().count() == 0 and s.monthly_orders().count() == 0
    assert s.update(order_files(spark, data)) == []
