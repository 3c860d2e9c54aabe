"""Queries over activity bitmaps (a01-a03) and over a salted join (j01)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phaselens.functions.calendar import CRISIS, PRE, RECOVERY
from phaselens.functions.metrics import pct
from phaselens.operators.activity import MonthSpan, active_in, activity_bitmaps, month_flow
from phaselens.operators.heavy import salted_join
from phaselens.sources.bindings import Model


def customer_activity(m: Model) -> DataFrame:
    """A bitmap per customer over all orders; orders without one are left out."""
    return activity_bitmaps(m.orders.where(F.col("customer_id").isNotNull()), "customer_id", "order_timestamp", MonthSpan.of(m.calendar))


def restaurant_bitmaps(m: Model) -> DataFrame:
    return activity_bitmaps(m.order_lines.where(F.col("restaurant_id").isNotNull()), "restaurant_id", "order_timestamp", MonthSpan.of(m.calendar))


def a01_month_flow(m: Model) -> DataFrame:
    """Customers active, retained, new, returned and churned in each month."""
    return month_flow(customer_activity(m), MonthSpan.of(m.calendar)).orderBy("month")


def a02_phase_patterns(m: Model) -> DataFrame:
    """Customers by the phases that they ordered in."""
    span = MonthSpan.of(m.calendar)
    names = {"in_pre": PRE, "in_crisis": CRISIS, "in_recovery": RECOVERY}
    flags = customer_activity(m).select(*[active_in(span, span.phase_mask(m.calendar, p)).alias(n) for n, p in names.items()], "events")
    return (flags.groupBy(*names).agg(F.count(F.lit(1)).alias("customers"), F.sum("events").alias("orders"))
            .orderBy(*[F.desc(n) for n in names]))


def a03_churn_matrix(m: Model) -> DataFrame:
    """Churn between every two phases in order, of customers and restaurants:
    one pass over either table of bitmaps."""
    span, cal = MonthSpan.of(m.calendar), m.calendar
    steps = [(a, b) for i, a in enumerate(cal.names) for b in cal.names[i + 1:]]
    parts = []
    for entity, bitmaps in (("customer", customer_activity(m)), ("restaurant", restaurant_bitmaps(m))):
        aggs, rows = [], []
        for i, (a, b) in enumerate(steps):
            member, still = (active_in(span, span.phase_mask(cal, p)) for p in (a, b))
            aggs += [F.count_if(member).cast("long").alias(f"t{i}"), F.count_if(member & still).cast("long").alias(f"r{i}")]
            rows.append(f"'{entity}', '{a}', '{b}', t{i}, t{i} - r{i}, r{i}")
        parts.append(bitmaps.agg(*aggs).selectExpr(
            f"stack({len(rows)}, {', '.join(rows)}) as (entity, base_phase, later_phase, total, churned, retained)"))
    return (reduce(lambda x, y: x.unionByName(y), parts).withColumn("churn_rate_pct", pct(F.col("churned"), F.col("total")))
            .orderBy("entity", cal.ordinal_col("base_phase"), cal.ordinal_col("later_phase")))


def j01_city_cancel_salted(m: Model) -> DataFrame:
    """``s03_city_phase_cancel`` with the customers joined by
    :func:`salted_join`: for data where few customers hold most orders."""
    orders = m.orders.select("customer_id", "order_id", "is_cancelled", m.calendar.phase_col("order_timestamp").alias("business_phase"))
    joined = salted_join(orders, m.customers.select("customer_id", "city"), "customer_id")
    return (joined.groupBy("city", "business_phase")
            .agg(F.count("order_id").alias("total_orders"),
                 F.count_if(F.col("is_cancelled") == "Y").cast("long").alias("cancelled_orders"))
            .withColumn("cancellation_rate_pct", pct(F.col("cancelled_orders"), F.col("total_orders")))
            .orderBy(F.desc("cancellation_rate_pct"), "city", "business_phase"))
