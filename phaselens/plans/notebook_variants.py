"""The notebook (pandas) variants of the questions: p01-p10.

Differences to the SQL variants are kept on purpose: ratings go through
``dropna`` (any NULL column drops the row), phase totals are compared
without month normalisation for cities, the restaurant comparison uses an
inner join, the top 5 % uses a quantile threshold, and ratings are bucketed
by the month of the review rather than of the order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phaselens.functions.calendar import CRISIS, PRE
from phaselens.functions.metrics import EXACT, decline_pct, exact_mean, money_total, pct, ratio, round_double, yn_flag
from phaselens.functions.timeparse import parse_mixed_ts
from phaselens.operators.compare import count_in, phase_pivot
from phaselens.operators.keywords import keyword_frequency
from phaselens.operators.rank import keep_columns
from phaselens.operators.topshare import top_share
from phaselens.sources.bindings import Model


def _orders(m: Model) -> DataFrame:
    return m.orders.withColumn("phase", m.calendar.phase_col("order_timestamp"))


def clean_ratings(m: Model) -> DataFrame:
    """``ratings.dropna()``: drop a rating with any NULL column."""
    return m.ratings.na.drop(how="any")


def _not_cancelled(col: str = "is_cancelled"):
    return ~yn_flag(col)


def _month(ts: str):
    return F.date_format(ts, "yyyy-MM")


def p01_order_trend(m: Model) -> DataFrame:
    return (_orders(m).where(F.col("order_timestamp").isNotNull())
            .groupBy(_month("order_timestamp").alias("month"), "phase")
            .agg(F.count("order_id").alias("total_orders"))
            .orderBy("month", "phase"))


def p01_decline_metrics(m: Model) -> DataFrame:
    """Mean of the monthly counts per phase, and the decline between them."""
    monthly = p01_order_trend(m)
    per = monthly.agg(
        F.sum(F.when(F.col("phase") == PRE, F.col("total_orders"))).alias("_pt"),
        F.count_if(F.col("phase") == PRE).alias("_pm"),
        F.sum(F.when(F.col("phase") == CRISIS, F.col("total_orders"))).alias("_ct"),
        F.count_if(F.col("phase") == CRISIS).alias("_cm"))
    # pre/pm - ct/cm over pre/pm  ==  (pt*cm - ct*pm) / (pt*cm)
    return per.select(
        ratio(F.col("_pt"), F.col("_pm"), 0).alias("pre_crisis_monthly_avg"),
        ratio(F.col("_ct"), F.col("_cm"), 0).alias("crisis_monthly_avg"),
        ratio(F.col("_pt") * F.col("_cm") - F.col("_ct") * F.col("_pm"), F.col("_pt") * F.col("_cm"),
              2, scale=100).alias("decline_pct"))


def _city_orders(m: Model) -> DataFrame:
    """Orders with the customer's city; unmatched customers drop out (a
    pandas groupby drops the NULL city the left merge leaves)."""
    return _orders(m).join(m.customers.select("customer_id", "city"), "customer_id").where(
        F.col("city").isNotNull())


def p02_city_decline(m: Model) -> DataFrame:
    per = phase_pivot(_city_orders(m), ["city"], "phase", {
        "pre_crisis_orders": (PRE, count_in), "crisis_orders": (CRISIS, count_in)})
    per = per.where((F.col("pre_crisis_orders") > 0) & (F.col("crisis_orders") > 0))  # inner merge
    return (per.withColumn("decline_pct", decline_pct("pre_crisis_orders", "crisis_orders"))
            .orderBy(F.desc("decline_pct"), "city").limit(m.params.top_cities))


def p02_unmatched_orders(m: Model) -> DataFrame:
    o = m.orders.select("order_id", "customer_id")
    known = m.customers.select("customer_id").distinct().withColumn("_known", F.lit(True))
    return (o.join(known, "customer_id", "left")
            .agg(F.count_if(F.col("_known").isNull()).cast("long").alias("unmatched_orders"),
                 F.count(F.lit(1)).alias("total_orders"))
            .withColumn("unmatched_pct", pct(F.col("unmatched_orders"), F.col("total_orders"))))


def p03_restaurant_decline(m: Model) -> DataFrame:
    """Totals, INNER merge: restaurants without crisis orders are dropped."""
    cal, p = m.calendar, m.params
    lines = m.order_lines.where(cal.between("order_timestamp", PRE) | cal.between("order_timestamp", CRISIS))
    lines = lines.withColumn("phase", cal.phase_col("order_timestamp"))
    per = phase_pivot(lines, ["restaurant_id"], "phase", {
        "pre_crisis_orders": (PRE, count_in), "crisis_orders": (CRISIS, count_in)})
    per = per.where((F.col("pre_crisis_orders") >= p.restaurant_min_pre_orders) & (F.col("crisis_orders") > 0))
    cols = ["restaurant_id", "restaurant_name"] + (["city"] if m.has_restaurant_city else []) + ["cuisine_type"]
    return (per.join(m.restaurants.select(*cols), "restaurant_id", "left")
            .select(*cols, "pre_crisis_orders", "crisis_orders",
                    decline_pct("pre_crisis_orders", "crisis_orders").alias("decline_pct"))
            .orderBy(F.desc("decline_pct"), "restaurant_id").limit(p.top_restaurants))


def _cancel_agg(df: DataFrame, keys) -> DataFrame:
    return (df.groupBy(*keys)
            .agg(F.count("order_id").alias("total_orders"),
                 F.count_if(F.col("is_cancelled") == "Y").cast("long").alias("cancelled_orders"))
            .withColumn("cancellation_rate", pct(F.col("cancelled_orders"), F.col("total_orders"))))


def p04_phase_cancel(m: Model) -> DataFrame:
    return _cancel_agg(_orders(m), ["phase"]).orderBy(m.calendar.ordinal_col("phase"))


def p04_city_cancel_crisis(m: Model) -> DataFrame:
    crisis = _city_orders(m).where(m.calendar.between("order_timestamp", CRISIS))
    return (_cancel_agg(crisis, ["city"])
            .orderBy(F.desc("cancellation_rate"), "city").limit(m.params.top_cancel_cities))


def p05_sla(m: Model) -> DataFrame:
    """Delivery rows with their order's phase (deliveries of unknown orders
    have no phase and drop out)."""
    d = m.delivery.join(_orders(m).select("order_id", "phase"), "order_id")
    delay = F.col("actual_delivery_time_mins") - F.col("expected_delivery_time_mins")
    breach = F.col("actual_delivery_time_mins") > F.col("expected_delivery_time_mins")
    return (d.groupBy("phase")
            .agg(exact_mean("actual_delivery_time_mins", 1, in_scale=0).alias("avg_actual_time"),
                 exact_mean("expected_delivery_time_mins", 1, in_scale=0).alias("avg_expected_time"),
                 pct(F.count_if(breach), F.count(F.lit(1))).alias("breach_rate_pct"),
                 exact_mean(delay, 1, in_scale=0).alias("avg_delay_mins"))
            .orderBy(m.calendar.ordinal_col("phase")))


def reviews_by_month(m: Model) -> DataFrame:
    """Reviews with their parsed time; text that no known shape fits fails the
    job, as it does in pandas."""
    return clean_ratings(m).withColumn("review_ts", parse_mixed_ts("review_timestamp", on_error="raise"))


def _monthly_rating(m: Model) -> DataFrame:
    return (reviews_by_month(m).groupBy(_month("review_ts").alias("month"))
            .agg(exact_mean("rating").alias("avg_rating"),
                 F.count("rating").alias("total_reviews")))


def p06_monthly_rating(m: Model) -> DataFrame:
    return _monthly_rating(m).orderBy("month")


def p06_sharpest_drop(m: Model) -> DataFrame:
    """Month whose (rounded) mean rating fell most from the month before."""
    monthly = _monthly_rating(m)
    # One row per month: a single ordered window over a month-sized table.
    w = Window.orderBy("month")
    steps = (monthly.select("month", "avg_rating",
                            F.lag("month").over(w).alias("prev_month"),
                            F.lag("avg_rating").over(w).alias("prev_avg_rating"))
             .where(F.col("prev_month").isNotNull()))
    drop = (F.col("prev_avg_rating").cast("decimal(10,2)") - F.col("avg_rating").cast("decimal(10,2)")).cast("double")
    return (steps.select("prev_month", "month", "prev_avg_rating", "avg_rating", drop.alias("rating_drop"))
            .orderBy(F.desc("rating_drop"), "month").limit(1))


def p07_negative_keywords(m: Model) -> DataFrame:
    p = m.params
    in_phase = m.orders.where(m.calendar.between("order_timestamp", p.keyword_phase)).select("order_id")
    reviews = (clean_ratings(m).join(in_phase, "order_id", "left_semi")
               .where(F.col("rating") <= p.low_rating))
    return keyword_frequency(reviews, "review_text", p.keywords, p.top_keywords)


def _kept_orders(m: Model) -> DataFrame:
    return m.orders_full.where(_not_cancelled()).withColumn("phase", m.calendar.phase_col("order_timestamp"))


def p08_revenue(m: Model) -> DataFrame:
    return (_kept_orders(m).groupBy("phase")
            .agg(F.count("order_id").alias("total_orders"),
                 money_total("subtotal_amount").alias("total_subtotal"),
                 money_total("discount_amount").alias("total_discount"),
                 money_total("delivery_fee").alias("total_delivery"),
                 money_total("total_amount").alias("total_revenue"),
                 exact_mean("total_amount", in_scale=2).alias("avg_order_value"))
            .orderBy(m.calendar.ordinal_col("phase")))


def p08_revenue_loss(m: Model) -> DataFrame:
    """Monthly revenue pre vs crisis; the loss over the crisis months."""
    cal = m.calendar
    mp, mc = cal.months(PRE), cal.months(CRISIS)
    o = m.orders.where(_not_cancelled()).withColumn("phase", cal.phase_col("order_timestamp"))
    tot = o.agg(F.sum(F.when(F.col("phase") == PRE, F.col("total_amount"))).alias("_rp"),
                F.sum(F.when(F.col("phase") == CRISIS, F.col("total_amount"))).alias("_rc"))
    # loss per month = rp/mp - rc/mc = (rp*mc - rc*mp) / (mp*mc), exact in DECIMAL
    loss_num = F.col("_rp") * F.lit(mc) - F.col("_rc") * F.lit(mp)
    return tot.select(
        ratio(F.col("_rp"), F.lit(mp)).alias("pre_monthly_avg_revenue"),
        ratio(F.col("_rc"), F.lit(mc)).alias("crisis_monthly_avg_revenue"),
        ratio(loss_num, F.lit(mp * mc)).alias("monthly_revenue_loss"),
        ratio(loss_num * F.lit(mc), F.lit(mp * mc)).alias("total_crisis_loss"))


# pandas ``groupby`` drops NULL keys (a Spark group-by keeps a NULL group):
# every per-customer aggregate of the notebook variants filters them first.
def _rating_per_customer(m: Model, names: dict[str, str]) -> DataFrame:
    """Per customer and phase (``names``: phase -> column) the mean rating of
    the orders of that phase, with its exact sum ``_<name>_s`` and count
    ``_<name>_n``: one pass over the ratings for all phases."""
    cal = m.calendar
    inside = {p: cal.between("order_timestamp", p) for p in names}
    any_phase = reduce(lambda a, b: a | b, inside.values())
    flags = (m.orders.where(any_phase).groupBy("order_id")
             .agg(*[F.max(c).alias(f"_in_{n}") for (p, n), c in zip(names.items(), inside.values())]))
    rated = clean_ratings(m).where(F.col("customer_id").isNotNull()).join(flags, "order_id")
    aggs = []
    for n in names.values():
        r = F.when(F.col(f"_in_{n}"), F.col("rating"))
        aggs += [F.sum(r.cast(EXACT)).alias(f"_{n}_s"), F.count(r).alias(f"_{n}_n")]
    per = rated.groupBy("customer_id").agg(*aggs)
    return per.select("*", *[F.try_divide(F.col(f"_{n}_s").cast("double"), F.col(f"_{n}_n").cast("double")).alias(n)
                             for n in names.values()])


def _churned_repeat(m: Model) -> DataFrame:
    cal, p = m.calendar, m.params
    pre, crisis = cal.between("order_timestamp", PRE), cal.between("order_timestamp", CRISIS)
    repeat = (m.orders.where((pre | crisis) & F.col("customer_id").isNotNull()).groupBy("customer_id")
              .agg(F.count(F.when(pre, F.col("order_id"))).alias("pre_crisis_order_count"),
                   (F.count_if(crisis) > 0).alias("ordered_in_crisis"))
              .where(F.col("pre_crisis_order_count") >= p.loyal_min_pre_orders))
    return repeat.join(_rating_per_customer(m, {PRE: "avg_pre_crisis_rating"}), "customer_id", "left")


def _rated_above(m: Model):
    # avg > limit  <=>  sum > limit * n, exact in DECIMAL
    limit = F.lit(str(m.params.high_rating)).cast("decimal(10,6)")
    return F.col("_avg_pre_crisis_rating_s") > limit * F.col("_avg_pre_crisis_rating_n").cast("decimal(20,0)")


def p09_loyalty_churn(m: Model) -> DataFrame:
    f = _churned_repeat(m)
    churned = ~F.col("ordered_in_crisis")
    high = _rated_above(m)
    return f.agg(
        F.count(F.lit(1)).alias("repeat_customers"),
        F.count_if(churned).cast("long").alias("churned_customers"),
        F.count_if(churned & high).cast("long").alias("churned_high_rated"),
        exact_mean(F.when(churned, F.col("avg_pre_crisis_rating"))).alias("avg_rating_churned"))


def p09_churn_split(m: Model) -> DataFrame:
    f = _churned_repeat(m)
    churned = ~F.col("ordered_in_crisis")
    high = _rated_above(m)
    return f.agg(
        F.count_if(churned).cast("long").alias("churned"),
        F.count_if(~churned).cast("long").alias("retained"),
        F.count_if(churned & high).cast("long").alias("churned_rating_above"),
        F.count_if(churned & ~F.coalesce(high, F.lit(False))).cast("long").alias("churned_not_above"))


def high_value(m: Model) -> DataFrame:
    """Top ``share`` of pre-crisis spenders: spend >= the (1-share) quantile
    (ties at the threshold are all kept)."""
    cal, p = m.calendar, m.params
    pre, crisis = cal.between("order_timestamp", PRE), cal.between("order_timestamp", CRISIS)
    per = (m.orders.where(_not_cancelled() & (pre | crisis) & F.col("customer_id").isNotNull()).groupBy("customer_id")
           .agg(F.sum(F.when(pre, F.col("total_amount"))).alias("total_spend"),
                F.count(F.when(pre, F.col("order_id"))).alias("order_count"),
                F.count(F.when(crisis, F.col("order_id"))).alias("crisis_order_count"),
                F.count_if(pre).alias("_pre_rows")))
    hv = top_share(keep_columns(per).where(F.col("_pre_rows") > 0).drop("_pre_rows"), "total_spend", p.top_share, "customer_id",
                   method="quantile", threshold_col="spend_threshold")
    ratings = _rating_per_customer(m, {PRE: "pre_crisis_rating", CRISIS: "crisis_rating"})
    return (hv.withColumn("order_drop", F.col("order_count") - F.col("crisis_order_count"))
            .join(ratings.select("customer_id", "pre_crisis_rating", "crisis_rating"), "customer_id", "left")
            .withColumn("rating_drop", F.col("pre_crisis_rating") - F.col("crisis_rating")))


def p10_high_value_profile(m: Model) -> DataFrame:
    return high_value(m).select("customer_id", F.col("total_spend").cast("double").alias("total_spend"),
                                "order_count", "crisis_order_count", "order_drop",
                                "pre_crisis_rating", "crisis_rating", "rating_drop")


def _value_counts(df: DataFrame, col: str, k: int | None, count_name: str) -> DataFrame:
    out = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias(count_name))
    out = out.orderBy(F.desc(count_name), col)
    return out.limit(k) if k else out


def p10_hv_city(m: Model) -> DataFrame:
    hv = high_value(m).select("customer_id").join(m.customers.select("customer_id", "city"), "customer_id", "left")
    return _value_counts(hv, "city", m.params.top_values, "customers")


def p10_hv_channel(m: Model) -> DataFrame:
    hv = high_value(m).select("customer_id").join(
        m.customers.select("customer_id", "acquisition_channel"), "customer_id", "left")
    return _value_counts(hv, "acquisition_channel", None, "customers")


def p10_hv_cuisine(m: Model) -> DataFrame:
    hv = high_value(m).select("customer_id")
    pre = (m.order_lines.where(m.calendar.between("order_timestamp", PRE))
           .join(hv, "customer_id", "left_semi")
           .join(m.restaurants.select("restaurant_id", "cuisine_type"), "restaurant_id", "left"))
    return _value_counts(pre, "cuisine_type", m.params.top_values, "orders")


def p10_hv_churn(m: Model) -> DataFrame:
    hv = high_value(m)
    zero = F.col("crisis_order_count") == 0
    return hv.agg(
        round_double(F.max("spend_threshold")).alias("spend_threshold"),
        F.count(F.lit(1)).alias("high_value_customers"),
        F.count_if(zero).cast("long").alias("zero_crisis_customers"),
        pct(F.count_if(zero), F.count(F.lit(1))).alias("zero_crisis_pct"),
        exact_mean("pre_crisis_rating").alias("avg_pre_crisis_rating"))
