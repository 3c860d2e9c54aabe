"""The ten business queries of the reference's SQL script (s01-s10).

Each function takes a bound :class:`~phaselens.sources.bindings.Model` and
returns a lazy DataFrame with the script's output columns. Where the SQL
and the notebook variants of a question differ by construction, both are
built (see ``notebook_variants``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phaselens.functions.calendar import CRISIS, PRE
from phaselens.functions.metrics import decline_pct, exact_mean, monthly_mean, pct, ratio, round_money, scaled_sum
from phaselens.operators.churn import churn_counts
from phaselens.operators.compare import count_in, phase_pivot
from phaselens.operators.rank import keep_columns
from phaselens.operators.topshare import top_share
from phaselens.sources.bindings import Model


def _phased(m: Model, df: DataFrame, ts: str = "order_timestamp", name: str = "business_phase") -> DataFrame:
    return df.withColumn(name, m.calendar.phase_col(ts))


def _breach(actual="actual_delivery_time_mins", expected="expected_delivery_time_mins"):
    return F.col(actual) > F.col(expected)


def s01_monthly_orders(m: Model) -> DataFrame:
    o = _phased(m, m.orders)
    return (o.groupBy(F.date_format("order_timestamp", "yyyy-MM").alias("order_month"), "business_phase")
            .agg(F.count("order_id").alias("total_orders"))
            .orderBy("order_month", "business_phase"))


def s02_phase_revenue(m: Model) -> DataFrame:
    o = _phased(m, m.orders.where(F.col("is_cancelled") == "N"))
    return (o.groupBy("business_phase")
            .agg(F.count("order_id").alias("total_orders"),
                 scaled_sum("total_amount").alias("_cents"),
                 F.count("total_amount").alias("_n"))
            .select("business_phase", "total_orders",
                    ratio(F.col("_cents"), F.lit(100)).alias("total_revenue"),
                    ratio(F.col("_cents"), F.lit(100 * 10_000_000)).alias("revenue_in_crores"),
                    ratio(F.col("_cents"), F.col("_n") * 100).alias("avg_order_value"))
            .orderBy(m.calendar.ordinal_col("business_phase")))


def s03_city_phase_cancel(m: Model) -> DataFrame:
    o = _phased(m, m.orders).join(m.customers.select("customer_id", "city"), "customer_id")
    return (o.groupBy("city", "business_phase")
            .agg(F.count("order_id").alias("total_orders"),
                 F.count_if(F.col("is_cancelled") == "Y").cast("long").alias("cancelled_orders"))
            .withColumn("cancellation_rate_pct", pct(F.col("cancelled_orders"), F.col("total_orders")))
            .orderBy(F.desc("cancellation_rate_pct"), "city", "business_phase"))


def s04_restaurant_decline(m: Model) -> DataFrame:
    """Monthly means, LEFT join: restaurants with no crisis order stay (100 %)."""
    cal, p = m.calendar, m.params
    lines = m.order_lines.where(cal.between("order_timestamp", PRE) | cal.between("order_timestamp", CRISIS))
    lines = lines.withColumn("phase", cal.phase_col("order_timestamp"))
    per = phase_pivot(lines, ["restaurant_id"], "phase", {
        "_pre": (PRE, count_in), "_cri": (CRISIS, count_in)}).where(F.col("_pre") > 0)
    mp, mc = cal.months(PRE), cal.months(CRISIS)
    per = per.where(F.col("_pre") >= p.restaurant_min_pre_orders)
    cols = ["restaurant_id", "restaurant_name"] + (["city"] if m.has_restaurant_city else []) + ["cuisine_type"]
    return (per.join(m.restaurants.select(*cols), "restaurant_id")
            .select(*cols,
                    monthly_mean(F.col("_pre"), mp).alias("pre_crisis_avg_monthly_orders"),
                    monthly_mean(F.col("_cri"), mc).alias("crisis_avg_monthly_orders"),
                    decline_pct(F.col("_pre"), F.col("_cri"), mp, mc).alias("decline_pct"))
            .orderBy(F.desc("decline_pct"), "restaurant_id").limit(p.top_restaurants))


def s05_sla_by_phase(m: Model) -> DataFrame:
    d = _phased(m, m.orders.select("order_id", "order_timestamp")).join(m.delivery, "order_id")
    delay = F.col("actual_delivery_time_mins") - F.col("expected_delivery_time_mins")
    return (d.groupBy("business_phase")
            .agg(exact_mean("actual_delivery_time_mins", in_scale=0).alias("avg_actual_delivery_mins"),
                 exact_mean("expected_delivery_time_mins", in_scale=0).alias("avg_expected_delivery_mins"),
                 exact_mean(delay, in_scale=0).alias("avg_delay_mins"),
                 pct(F.count_if(_breach()), F.count(F.lit(1))).alias("sla_breach_rate_pct"))
            .orderBy(m.calendar.ordinal_col("business_phase")))


def s06_loyal_churn(m: Model) -> DataFrame:
    """One conditional aggregation per customer. Orders without a customer
    form one group that is never found among the crisis customers."""
    pre, crisis = (m.calendar.between("order_timestamp", x) for x in (PRE, CRISIS))
    per = (m.orders.where(pre | crisis).groupBy("customer_id")
           .agg(F.count(F.when(pre, F.col("order_id"))).alias("_pre"), F.count_if(crisis).alias("_crisis"))
           .where(F.col("_pre") >= m.params.loyal_min_pre_orders))
    return churn_counts(per, "customer_id", (F.col("_crisis") > 0) & F.col("customer_id").isNotNull(),
                        ("total_loyal_customers", "churned_loyal_customers",
                         "retained_loyal_customers", "churn_rate_pct"))


def s07_high_value_by_city(m: Model) -> DataFrame:
    """NTILE(20) over pre-crisis spend (customers found in the dimension);
    tile 1 = top 5 %. Ties in spend are ordered by customer id."""
    cal = m.calendar
    kept = m.orders.where(cal.between("order_timestamp", PRE) & (F.col("is_cancelled") == "N"))
    spend = (kept.join(m.customers.select("customer_id", "city"), "customer_id")
             .groupBy("customer_id", "city").agg(F.sum("total_amount").alias("total_spend")))
    top = top_share(keep_columns(spend), "total_spend", 1 / m.params.ntile_groups, "customer_id", method="ntile")
    return (top.groupBy("city")
            .agg(F.count("customer_id").alias("high_value_customers"),
                 ratio(F.sum("total_spend"), F.count("total_spend")).alias("avg_spend_per_customer"),
                 round_money(F.min("total_spend")).alias("min_spend_threshold"))
            .orderBy(F.desc("high_value_customers"), "city"))


def s08_monthly_rating(m: Model) -> DataFrame:
    """Month and phase of the ORDER (the notebook uses the review month)."""
    r = _phased(m, m.orders.select("order_id", "order_timestamp")).join(
        m.ratings_scores.select("order_id", "rating", "sentiment_score"), "order_id")
    return (r.groupBy(F.date_format("order_timestamp", "yyyy-MM").alias("order_month"), "business_phase")
            .agg(F.count("order_id").alias("total_reviews"),
                 exact_mean("rating").alias("avg_rating"),
                 exact_mean("sentiment_score").alias("avg_sentiment_score"))
            .orderBy("order_month", "business_phase"))


def s09_delay_vs_rating(m: Model) -> DataFrame:
    j = m.service.where(F.col("has_delivery") & F.col("has_rating"))
    status = F.when(_breach(), "Delayed").otherwise("On Time")
    return (j.groupBy(status.alias("delivery_status"))
            .agg(F.count("order_id").alias("total_orders"),
                 exact_mean("rating").alias("avg_customer_rating"),
                 exact_mean("sentiment_score").alias("avg_sentiment_score"),
                 exact_mean("actual_delivery_time_mins", in_scale=0).alias("avg_delivery_mins"))
            .orderBy("delivery_status"))


def s10_recovery_scorecard(m: Model) -> DataFrame:
    """All orders, as by LEFT joins: several ratings for one order fan out
    and are all counted (the script's behaviour)."""
    j = _phased(m, m.service)
    return (j.groupBy("business_phase")
            .agg(F.count("order_id").alias("total_orders"),
                 exact_mean("rating").alias("avg_rating"),
                 exact_mean("sentiment_score").alias("avg_sentiment"),
                 exact_mean("actual_delivery_time_mins", in_scale=0).alias("avg_delivery_mins"),
                 pct(F.count_if(_breach()), F.count("order_id")).alias("sla_breach_pct"),
                 pct(F.count_if(F.col("is_cancelled") == "Y"), F.count("order_id")).alias("cancellation_rate_pct"))
            .orderBy(m.calendar.ordinal_col("business_phase")))
