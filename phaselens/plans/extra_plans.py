"""Extra insights (x01-x03), data overview (d01-d08) and the published
figures whose code the reference does not ship (m01-m03)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phaselens.functions.calendar import CRISIS, PRE, RECOVERY
from phaselens.functions.metrics import decline_pct, exact_mean, pct
from phaselens.operators.compare import count_in, phase_pivot
from phaselens.operators.profile import column_types, null_columns, null_totals, profile_shapes
from phaselens.plans.notebook_variants import (_city_orders, _kept_orders, _value_counts, clean_ratings,
                                               high_value, reviews_by_month)
from phaselens.sources.bindings import Model


# -- extra insights ----------------------------------------------------------
def x01_behavior_shift(m: Model) -> DataFrame:
    return (_kept_orders(m).groupBy(F.date_format("order_timestamp", "yyyy-MM").alias("month"), "phase")
            .agg(F.count("order_id").alias("total_orders"),
                 exact_mean("total_amount", in_scale=2).alias("avg_order_value"),
                 exact_mean("discount_amount", in_scale=2).alias("avg_discount"),
                 exact_mean("delivery_fee", in_scale=2).alias("avg_delivery_fee"))
            .orderBy("month", "phase"))


def x02_negative_reviews(m: Model) -> DataFrame:
    return (reviews_by_month(m).groupBy(F.date_format("review_ts", "yyyy-MM").alias("month"))
            .agg(exact_mean("sentiment_score", 3).alias("avg_sentiment"),
                 F.count_if(F.col("sentiment_score") < 0).cast("long").alias("negative_reviews"),
                 F.count("sentiment_score").alias("total_reviews"))
            .withColumn("negative_pct", pct(F.col("negative_reviews"), F.col("total_reviews")))
            .orderBy("month"))


def restaurant_activity(m: Model) -> DataFrame:
    """Per restaurant seen in orders: active before the crisis? in recovery?
    One shuffle on restaurant id replaces two distinct sets and a difference."""
    cal = m.calendar
    lines = m.order_lines.where(F.col("restaurant_id").isNotNull())
    return lines.groupBy("restaurant_id").agg(
        (F.count_if(cal.between("order_timestamp", PRE)) > 0).alias("pre_active"),
        (F.count_if(cal.between("order_timestamp", RECOVERY)) > 0).alias("recovery_active"))


def churned_restaurants(m: Model) -> DataFrame:
    act = restaurant_activity(m).where(F.col("pre_active") & ~F.col("recovery_active")).select("restaurant_id")
    return m.restaurants.join(act, "restaurant_id", "left_semi")


def x03_restaurant_churn(m: Model) -> DataFrame:
    a = restaurant_activity(m)
    churned = F.col("pre_active") & ~F.col("recovery_active")
    return (a.agg(F.count_if("pre_active").cast("long").alias("pre_active_restaurants"),
                  F.count_if("recovery_active").cast("long").alias("recovery_active_restaurants"),
                  F.count_if(churned).cast("long").alias("churned_restaurants"))
            .withColumn("churn_rate_pct", pct(F.col("churned_restaurants"), F.col("pre_active_restaurants"))))


def x03_churn_partner_type(m: Model) -> DataFrame:
    return _value_counts(churned_restaurants(m), "partner_type", None, "restaurants")


def x03_churn_cuisine(m: Model) -> DataFrame:
    return _value_counts(churned_restaurants(m), "cuisine_type", m.params.top_churn_cuisines, "restaurants")


def x03_churn_active(m: Model) -> DataFrame:
    return _value_counts(churned_restaurants(m), "is_active", None, "restaurants")


# -- data overview -------------------------------------------------------------
def d01_shapes(m: Model) -> DataFrame:
    return profile_shapes(m.profile_groups())


def d02_null_totals(m: Model) -> DataFrame:
    return null_totals(m.profile_groups())


def d03_null_columns(m: Model) -> DataFrame:
    return null_columns(m.profile_groups("fact_orders", "fact_ratings"))


def d04_dtypes(m: Model) -> DataFrame:
    return column_types(m.profile_groups())


def d05_phase_counts(m: Model) -> DataFrame:
    o = m.orders.withColumn("phase", m.calendar.phase_col("order_timestamp"))
    return o.groupBy("phase").agg(F.count(F.lit(1)).alias("orders")).orderBy(F.desc("orders"), "phase")


def d06_month_counts(m: Model) -> DataFrame:
    return (m.orders.where(F.col("order_timestamp").isNotNull())
            .groupBy(F.date_format("order_timestamp", "yyyy-MM").alias("month"))
            .agg(F.count("order_id").alias("orders")).orderBy("month"))


def d07_date_range(m: Model) -> DataFrame:
    return m.orders.agg(F.to_date(F.min("order_timestamp")).alias("first_date"),
                        F.to_date(F.max("order_timestamp")).alias("last_date"))


def d08_after_dropna(m: Model) -> DataFrame:
    nulls = m.orders_full.select(F.count_if(F.col("delivery_partner_id").isNull()).cast("long")).scalar()
    return (clean_ratings(m).agg(F.count(F.lit(1)).alias("ratings_after_dropna"))
            .withColumn("partner_id_nulls_retained", nulls))


# -- published figures without code -------------------------------------------
def m01_active_customers(m: Model) -> DataFrame:
    """Distinct ordering customers per phase, and the fall from the first phase."""
    cal = m.calendar
    per = (m.orders.withColumn("phase", cal.phase_col("order_timestamp"))
           .groupBy("phase").agg(F.count_distinct("customer_id").alias("active_customers")))
    # one row per phase: a window over all of them is trivial
    base = F.max(F.when(F.col("phase") == PRE, F.col("active_customers"))).over(Window.partitionBy())
    return (per.withColumn("_b", base)
            .select("phase", "active_customers",
                    decline_pct(F.col("_b"), F.col("active_customers")).alias("decline_vs_pre_pct"))
            .orderBy(cal.ordinal_col("phase")))


def m02_city_absolute_loss(m: Model) -> DataFrame:
    per = phase_pivot(_city_orders(m), ["city"], "phase", {
        "pre_crisis_orders": (PRE, count_in), "crisis_orders": (CRISIS, count_in)})
    return (per.withColumn("absolute_loss", F.col("pre_crisis_orders") - F.col("crisis_orders"))
            .orderBy(F.desc("absolute_loss"), "city"))


def m03_city_share(m: Model) -> DataFrame:
    """Share of all high-value customers held by the top cities."""
    hv = high_value(m).select("customer_id").join(m.customers.select("customer_id", "city"), "customer_id", "left")
    total = hv.select(F.count(F.lit(1))).scalar()
    k = m.params.share_top_cities
    top = _value_counts(hv, "city", k, "customers")
    # k rows: an ordered window over them is trivial.
    w = Window.orderBy(F.desc("customers"), "city").rowsBetween(Window.unboundedPreceding, 0)
    return (top.withColumn("_t", total)
            .withColumn("_cum", F.sum("customers").over(w))
            .select("city", "customers",
                    pct(F.col("customers"), F.col("_t")).alias("share_pct"),
                    pct(F.col("_cum"), F.col("_t")).alias("cumulative_share_pct")))

