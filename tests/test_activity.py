"""Activity bitmaps against sets and against the queries they can answer."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from phaselens.functions.calendar import CRISIS, PRE, RECOVERY, PhaseCalendar
from phaselens.operators.activity import (MonthSpan, active_in, activity_bitmaps, churn_from_bitmaps, merge_bitmaps, month_flow,
                                          months_active)
from phaselens.plans import activity_plans, extra_plans, rfm_plans, sql_variants
from phaselens.plans.notebook_variants import p09_churn_split
from phaselens.plans.registry import driver_model

SPAN = MonthSpan(dt.date(2023, 3, 1), 90)


def _events(n=900, seed=2):
    rnd = random.Random(seed)
    rows = []
    for _ in range(n):
        t = dt.datetime(2023, 1, 1) + dt.timedelta(days=rnd.randrange(3200), hours=rnd.randrange(24))
        rows.append((rnd.choice([None, *[f"K{i}" for i in range(60)]]), None if rnd.random() < 0.05 else t, rnd.randrange(9)))
    return rows


def _month(t):
    return SPAN.undated if t is None else min(max(SPAN.number(t.date()), 0), SPAN.months - 1)


def _sets(rows):
    out = {}
    for k, t, _ in rows:
        out.setdefault(_month(t), set()).add(k)
    return out


def test_bits_equal_sets_for_random_month_pairs(spark):
    rows = _events()
    df = spark.createDataFrame(rows, "k string, t timestamp_ntz, x int").repartition(5)
    table = activity_bitmaps(df, "k", "t", SPAN, {"x": F.sum("x")}).cache()
    seen = _sets(rows)
    rnd = random.Random(7)
    for _ in range(20):
        a, b = rnd.randrange(SPAN.months + 1), rnd.randrange(SPAN.months + 1)
        base, later = seen.get(a, set()), seen.get(b, set())
        got = churn_from_bitmaps(table, SPAN, SPAN.mask([a]), SPAN.mask([b])).first()
        assert (got["total"], got["churned"], got["retained"]) == (len(base), len(base - later), len(base & later)), (a, b)
    every = {r["k"]: r for r in table.withColumn("m", months_active(SPAN, SPAN.mask(range(SPAN.months)))).collect()}
    for key in {k for k, _, _ in rows}:
        own = [(t, x) for k, t, x in rows if k == key]
        dated = [t for t, _ in own if t]
        assert every[key]["m"] == len({_month(t) for t in dated}) and every[key]["events"] == len(own)
        assert (every[key]["first_ts"], every[key]["last_ts"], every[key]["x"]) == (min(dated), max(dated), sum(x for _, x in own))


def test_parts_merge_to_the_whole(spark):
    rows = _events()
    schema = "k string, t timestamp_ntz, x int"
    parts = [activity_bitmaps(spark.createDataFrame(rows[i::3], schema), "k", "t", SPAN) for i in range(3)]
    whole = activity_bitmaps(spark.createDataFrame(rows, schema), "k", "t", SPAN)
    merged = merge_bitmaps(parts, "k", SPAN)
    assert sorted(map(tuple, merged.select(whole.columns).collect()), key=repr) == sorted(map(tuple, whole.collect()), key=repr)
    none = activity_bitmaps(spark.createDataFrame([], schema), "k", "t", SPAN)
    assert none.count() == 0 and churn_from_bitmaps(none, SPAN, SPAN.mask([0]), SPAN.mask([1])).first()["total"] == 0


def test_flow_of_months(spark):
    rows = [r for r in _events(500, 5) if r[1]]
    table = activity_bitmaps(spark.createDataFrame(rows, "k string, t timestamp_ntz, x int"), "k", "t", SPAN)
    seen, before = _sets(rows), set()
    want = {}
    for m in range(SPAN.months):
        now = seen.get(m, set())
        last = seen.get(m - 1, set())
        if now:
            year, month = divmod(SPAN.first.year * 12 + SPAN.first.month - 1 + m, 12)
            want[f"{year:04d}-{month + 1:02d}"] = (len(now), len(now & last), len(now - before), len((now & before) - last),
                                                   len(last - now) if m else None)
        before |= now
    got = {r["month"]: tuple(r)[1:] for r in month_flow(table, SPAN).collect()}
    assert got == want


def test_phase_masks():
    calendar = PhaseCalendar([("a", None, "2025-06-01", 5), ("b", "2025-06-01", "2025-08-01", 2), ("c", "2025-08-01", None, 2)])
    span = MonthSpan.of(calendar)
    assert span.first == dt.date(2025, 1, 1) and span.months == 63
    assert span.phase_mask(calendar, "a") == [0b11111] and span.phase_mask(calendar, "b") == [0b1100000]
    assert span.phase_mask(calendar, "c") == [-(1 << 7)]  # all later months, and orders without a time
    torn = PhaseCalendar([("a", None, "2025-06-15", 5), ("b", "2025-06-15", None, 2)])
    with pytest.raises(ValueError, match="begin and end with a month"):
        span.phase_mask(torn, "b")


@pytest.mark.parametrize("binding", ["reference", "driver"])
def test_one_table_answers_the_churn_queries(spark, ref_model, binding):
    """s06, p09, x03, r07 and m01 from bitmaps equal their own queries."""
    m = ref_model if binding == "reference" else driver_model(spark, "/root/testdata/sf0.001")
    cal, span = m.calendar, MonthSpan.of(m.calendar)
    mask = {p: span.phase_mask(cal, p) for p in cal.names}
    pre_orders = F.count(F.when(cal.between("order_timestamp", PRE), F.col("order_id")))
    every = activity_bitmaps(m.orders, "customer_id", "order_timestamp", span, {"pre_orders": pre_orders}).cache()
    known = every.where("customer_id is not null")

    loyal = F.col("pre_orders") >= m.params.loyal_min_pre_orders
    got = churn_from_bitmaps(known, span, mask[PRE], mask[CRISIS], where=loyal).first()
    want = sql_variants.s06_loyal_churn(m).first()
    assert (got["total"], got["churned"] + (1 if every.where(loyal & F.col("customer_id").isNull()).count() else 0), got["retained"]) == (
        want["total_loyal_customers"], want["churned_loyal_customers"], want["retained_loyal_customers"])

    for row in extra_plans.m01_active_customers(m).collect():
        assert known.where(active_in(span, mask[row["phase"]])).count() == row["active_customers"]

    restaurants = activity_plans.restaurant_bitmaps(m)
    got = churn_from_bitmaps(restaurants, span, mask[PRE], mask[RECOVERY]).first()
    want = extra_plans.x03_restaurant_churn(m).first()
    assert (got["total"], got["churned"], got["churn_rate_pct"]) == (want["pre_active_restaurants"], want["churned_restaurants"], want["churn_rate_pct"])
    both = sorted(r[0] for r in extra_plans.churned_restaurants(m).select("restaurant_id").collect())
    left = restaurants.where(active_in(span, mask[PRE]) & ~active_in(span, mask[RECOVERY])).join(m.restaurants.select("restaurant_id"), "restaurant_id")
    assert sorted(r["restaurant_id"] for r in left.collect()) == both

    kept = activity_bitmaps(m.orders.where(F.coalesce(F.col("is_cancelled") == "N", F.lit(True))), "customer_id", "order_timestamp", span)
    none = m.customers.select("customer_id").join(kept.select("customer_id"), "customer_id", "left_anti").count()
    assert none == rfm_plans.r07_no_history(m).first()["customers_without_orders"]
    matrix = {(r["entity"], r["base_phase"], r["later_phase"]): r for r in activity_plans.a03_churn_matrix(m).collect()}
    assert matrix["restaurant", PRE, RECOVERY]["churned"] == want["churned_restaurants"] and len(matrix) == 6
    assert p09_churn_split(m).first()["retained"] <= matrix["customer", PRE, CRISIS]["retained"]
