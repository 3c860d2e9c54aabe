"""Rank selection by radix counts against sorted values, exact moments, and
the two levels of range cutting."""

import math
import random
import struct
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from phaselens.operators import rank as rank_mod
from phaselens.operators.profile import describe_exact, exact_std
from phaselens.operators.rank import distributed_ntile, distributed_rank
from phaselens.operators.select import BINS, digits_of, order_digits, quantiles, select_ranks, cut_points

PROBS = {"a": 0.0, "b": 1 / 3, "c": 0.5, "d": 0.95, "e": 1.0}


def _values(seed=4, n=2500):
    rnd = random.Random(seed)
    wide = [rnd.uniform(-1, 1) * 10.0 ** rnd.randint(-300, 300) for _ in range(n)]
    odd = [rnd.choice([-0.0, 0.0, 5e-324, -5e-324, 1.7e308, -1.7e308, 7.25, None]) for _ in range(n)]
    hot = [7 if i % 3 == 0 else rnd.randint(-10 ** 12, 10 ** 12) for i in range(n)]
    money = [Decimal(rnd.randint(-10 ** 9, 10 ** 9)) / 100 for _ in range(n)]
    cents = [rnd.randint(0, 10 ** 7) / 100 for _ in range(n)]
    return [(i, wide[i], odd[i], hot[i], money[i], cents[i], 3) for i in range(n)]


def _interpolated(values, p):
    values = sorted(values)
    h = (len(values) - 1) * p
    lo, hi = values[math.floor(h)], values[math.ceil(h)]
    return float(lo) + (h - math.floor(h)) * (float(hi) - float(lo))


def test_quantiles_of_all_columns_in_one_pass(spark):
    rows = _values()
    names = ["k", "wide", "odd", "hot", "money", "cents", "same"]
    df = spark.createDataFrame(rows, "k long, wide double, odd double, hot long, money decimal(18,2), cents double, same int").repartition(5)
    got = quantiles(df, {c: PROBS for c in names}, {"cents": 2}).first()
    for j, c in enumerate(names):
        values = [r[j] for r in rows if r[j] is not None]
        for name, p in PROBS.items():
            assert got[c][name] == _interpolated(values, p), (c, name)


@pytest.mark.parametrize("n", [0, 1, 2])
def test_quantiles_of_few_rows(spark, n):
    df = spark.createDataFrame([(float(i), None) for i in range(n)], "v double, w double")
    got = quantiles(df, {"v": PROBS, "w": {"x": 0.5}}).first()
    assert got["v"]["c"] == (None if n == 0 else (n - 1) / 2) and got["w"]["x"] is None


def test_double_digits_keep_the_order(spark):
    values = sorted({r[1] for r in _values()} | {0.0, 5e-324, -5e-324, 1.0, -1.0, float("inf"), float("-inf")})
    df = spark.createDataFrame([(v,) for v in values], "v double").coalesce(1)
    d = digits_of(df, "v")
    df = df.withColumn("d", F.array(*d.columns))
    got = df.select("v", "d", F.expr(d.back(["d[0]", "d[1]"])).alias("back")).collect()
    assert all(struct.pack("d", r["v"]) == struct.pack("d", r["back"]) for r in got)
    keys = [tuple(r["d"]) for r in sorted(got, key=lambda r: r["v"])]
    assert keys == sorted(keys) and len(set(keys)) == len(keys)


@pytest.mark.parametrize("desc", [True, False])
def test_cut_points_find_every_rank(spark, desc):
    rows = [(i * 7 - 300, (i * 31) % 11 - 5) for i in range(120)]
    df = spark.createDataFrame(rows, "k long, v long").repartition(3)
    digits = order_digits(df, [("v", not desc)], "k")
    got = select_ranks(df, {"o": cut_points(digits, lambda n: [F.lit(r) for r in range(1, 121)])}).first()["o"]
    order = sorted((-1 - v if desc else v, k) for k, v in rows)
    assert [tuple(got[f"g{i}"]["digits"]) for i in range(1, 121)] == order


@pytest.mark.parametrize("n,k", [(1, 3), (19, 20), (20, 20), (45, 20), (400, 7)])
def test_tiles_without_ranks(spark, n, k):
    rnd = random.Random(n)
    rows = [(rnd.randint(-10 ** 14, 10 ** 14) * 500 + i, Decimal(rnd.choice([1, 1, 1, 250, -9])) / 100) for i in range(n)]
    df = spark.createDataFrame(rows, "k long, v decimal(28,2)")
    tiled = distributed_ntile(df, [("v", False)], "k", k, "t")
    ref = tiled.withColumn("t2", F.ntile(k).over(Window.orderBy(F.desc("v"), "k")))
    assert ref.where("t <> t2 or t is null").count() == 0 and ref.count() == n
    assert "_pl_bucket" not in tiled._jdf.queryExecution().optimizedPlan().toString()


def test_text_keys_are_ranked(spark):
    rows = [(f"C{i % 37:03d}-{i}", i % 4) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, v long")
    ref = distributed_ntile(df, [("v", True)], "k", 9, "t").withColumn("t2", F.ntile(9).over(Window.orderBy("v", "k")))
    assert ref.where("t <> t2").count() == 0


def test_ranges_are_cut_in_two_levels(spark, monkeypatch):
    monkeypatch.setattr(rank_mod, "ROWS_PER_BUCKET", 40)
    monkeypatch.setattr(rank_mod, "MAX_RANGES", 4)
    monkeypatch.setattr(rank_mod, "MIN_BUCKETS", 2)
    rows = [(i, 1 if i % 3 == 0 else (i * 7919) % 500) for i in range(2000)]
    df = spark.createDataFrame(rows, "k long, f long").repartition(3)
    bucketed, table = rank_mod.range_buckets(df, [("f", True)], "k")
    sizes = [r["_pl_cnt"] for r in table.collect()]
    assert sum(sizes) == 2000 and len(sizes) > 20 and max(sizes) < 200  # the hot value has 667 rows
    assert len({r["_pl_range"] for r in table.collect()}) <= 8  # 4 in expectation
    ref = distributed_rank(df, [("f", True)], "k", "r").withColumn("r2", F.row_number().over(Window.orderBy("f", "k")))
    assert ref.where("r <> r2").count() == 0 and ref.count() == 2000


@pytest.mark.parametrize("rows", [10 ** 5, 10 ** 8, 10 ** 11, 10 ** 15])
def test_what_one_task_receives_is_bounded(spark, rows):
    """Boundary keys that meet in one task, and ranges that are broadcast."""
    ranges = spark.range(1).select(rank_mod.first_level(F.lit(rows).cast("long"))).first()[0]
    assert ranges <= rank_mod.MAX_RANGES and ranges * rank_mod.SAMPLE_PER_BUCKET <= 131_072
    # bins of one interval in a radix round: its length is at most the rows' range of whole cents
    assert max(BINS, math.ceil(math.sqrt(10 ** 12))) == 10 ** 6


def test_moments_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(3)
    values = [round(float(v), 2) for v in rng.lognormal(8, 2, 5000)] + [None, 1e9, 0.01]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "k long, v double")
    whole = [round(v * 100) for v in values if v is not None]
    n, mean = len(whole), sum(whole) / len(whole)
    exact = math.sqrt(float((n * sum(x * x for x in whole) - sum(whole) ** 2)) / n / (n - 1)) / 100
    got = {df.repartition(p).agg(exact_std("v", 2, 9).alias("s")).first()["s"] for p in (1, 7, 200)}
    assert len(got) == 1 and abs(got.pop() - exact) < 1e-8 * exact and mean > 0
    table = {tuple(r) for r in describe_exact(df.repartition(1), ["v", "k"], scales={"v": 2}).collect()}
    assert table == {tuple(r) for r in describe_exact(df.repartition(7), ["v", "k"], scales={"v": 2}).collect()}


def test_moments_of_large_numbers(spark):
    """A spread far below the mean, where a sum of squares in doubles fails."""
    values = [10 ** 12 + i for i in range(1000)]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    want = round(float(np.std(np.arange(1000), ddof=1)), 6)
    assert df.agg(exact_std("v", 0, 6).alias("s")).first()["s"] == want
    assert df.limit(1).agg(exact_std("v", 0, 6).alias("s")).first()["s"] is None
