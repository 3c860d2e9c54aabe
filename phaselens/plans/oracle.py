"""Independent SQL (DuckDB dialect) for every registered driver query.

The SQL reads the raw driver tables; the binding views are prepended as
CTEs from ``DRIVER_BINDING_SQL``. Rounding is written as exact integer
arithmetic (``hu``) so it matches the half-up DECIMAL rounding of the
Spark side bit for bit; DuckDB's own ``ROUND(double)`` and ``AVG``
(which returns DOUBLE) round the binary value and would disagree on ties.
"""

from __future__ import annotations

from phaselens.operators.rfm import SEGMENT_ORDER
from phaselens.plans.rfm_plans import EVENTS_REFERENCE_DATE
from phaselens.sources.bindings import DRIVER_BINDING_SQL, DRIVER_PARAMS

# The driver's phases in the oracle's own words: two cuts, 72 and 2 months
# before and during the crisis; an order without a time is in the last phase.
PRE, CRISIS, RECOVERY = "Pre-Crisis", "Crisis", "Recovery"
CUTS = ("2001-01-01 00:00:00", "2001-03-01 00:00:00")
MP, MC = 72, 2
START = "1995-01-01"  # the first of the 72 months
P = DRIVER_PARAMS


def hu(num: str, den: str, d: int = 2, scale: int = 1, num_scale: int = 0) -> str:
    """round_half_up(num * scale / den, d) as DOUBLE, exact; ``num`` carries
    ``num_scale`` decimals, ``den`` is an integer."""
    a = f"(CAST(({num}) * {10 ** num_scale} AS HUGEINT) * {scale})"
    b = f"(CAST(({den}) AS HUGEINT) * {10 ** num_scale})"
    p = 10 ** d
    return f"(CAST(SIGN({a}) * ((2 * ABS({a}) * {p} + {b}) // (2 * NULLIF({b}, 0))) AS DOUBLE) / {p})"


def mean(col: str, d: int = 2, in_scale: int = 12) -> str:
    """Mean of the raw values (12 decimals), rounded half-up once."""
    return hu(f"SUM(CAST({col} AS DECIMAL(38,{in_scale})))", f"COUNT({col})", d, num_scale=in_scale)


def rd(x: str, d: int = 2) -> str:
    """Half-up rounding of a double through DECIMAL(38,10) (as round_double)."""
    return f"CAST(ROUND(CAST({x} AS DECIMAL(38,10)), {d}) AS DOUBLE)"


def ph(ts: str = "order_timestamp") -> str:
    return (f"CASE WHEN {ts} < TIMESTAMP '{CUTS[0]}' THEN '{PRE}' WHEN {ts} < TIMESTAMP '{CUTS[1]}' THEN '{CRISIS}' "
            f"ELSE '{RECOVERY}' END")


def inph(name: str, ts: str = "order_timestamp") -> str:
    return {PRE: f"({ts} < TIMESTAMP '{CUTS[0]}')",
            CRISIS: f"({ts} >= TIMESTAMP '{CUTS[0]}' AND {ts} < TIMESTAMP '{CUTS[1]}')",
            RECOVERY: f"({ts} >= TIMESTAMP '{CUTS[1]}' OR {ts} IS NULL)"}[name]


def cnt(cond: str) -> str:
    return f"CAST(COUNT(*) FILTER (WHERE {cond}) AS BIGINT)"


def month(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m')"


def _with(body: str, ctes: dict[str, str] | None = None) -> str:
    sentiment = hu("SUM(CASE WHEN l_returnflag = 'A' THEN 1 WHEN l_returnflag = 'R' THEN -1 ELSE 0 END)",
                   "COUNT(*)", 2)
    parts = [f"{name} AS ({sql.format(sentiment=sentiment) if '{sentiment}' in sql else sql})"
             for name, sql in DRIVER_BINDING_SQL.items()]
    parts += [f"{name} AS ({sql})" for name, sql in (ctes or {}).items()]
    return "WITH " + ",\n".join(parts) + "\n" + body


NOT_CANCELLED = "NOT COALESCE(is_cancelled = 'Y', FALSE)"
RATING_COLS = ("order_id", "customer_id", "restaurant_id", "rating", "review_text", "review_timestamp",
               "sentiment_score")
CLEAN_RATINGS = "SELECT * FROM ratings_v WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in RATING_COLS)
REVIEW_TS = ("COALESCE(try_strptime(review_timestamp, '%Y-%m-%d %H:%M:%S'), "
             "try_strptime(review_timestamp, '%d-%m-%Y'))")
BREACH = "d.actual_delivery_time_mins > d.expected_delivery_time_mins"
Q_TOP = repr(round(1 - P.top_share, 12))
THIRD, TWO_THIRDS = repr(1 / 3), repr(2 / 3)


def _high_value_ctes() -> dict[str, str]:
    return {
        "kept": f"SELECT * FROM orders_v WHERE {NOT_CANCELLED}",
        "ps": f"""SELECT customer_id, SUM(total_amount) AS total_spend, COUNT(order_id) AS order_count
                  FROM kept WHERE {inph(PRE)} GROUP BY customer_id""",
        "th": f"SELECT quantile_cont(CAST(total_spend AS DOUBLE), {Q_TOP}) AS t FROM ps",
        "cr": f"SELECT customer_id, COUNT(order_id) AS n FROM kept WHERE {inph(CRISIS)} GROUP BY customer_id",
        "cr_r": CLEAN_RATINGS,
        "prr": f"""SELECT customer_id, AVG(rating) AS pre_crisis_rating FROM cr_r
                   WHERE order_id IN (SELECT order_id FROM orders_v WHERE {inph(PRE)}) GROUP BY customer_id""",
        "crr": f"""SELECT customer_id, AVG(rating) AS crisis_rating FROM cr_r
                   WHERE order_id IN (SELECT order_id FROM orders_v WHERE {inph(CRISIS)}) GROUP BY customer_id""",
        "hv": """SELECT ps.customer_id, ps.total_spend, ps.order_count, th.t AS spend_threshold,
                        CAST(COALESCE(cr.n, 0) AS BIGINT) AS crisis_order_count,
                        prr.pre_crisis_rating, crr.crisis_rating
                 FROM ps CROSS JOIN th LEFT JOIN cr ON ps.customer_id = cr.customer_id
                      LEFT JOIN prr ON ps.customer_id = prr.customer_id
                      LEFT JOIN crr ON ps.customer_id = crr.customer_id
                 WHERE CAST(ps.total_spend AS DOUBLE) >= th.t""",
    }


def _repeat_ctes() -> dict[str, str]:
    return {
        "rep": f"""SELECT customer_id FROM orders_v WHERE {inph(PRE)} GROUP BY customer_id
                   HAVING COUNT(order_id) >= {P.loyal_min_pre_orders}""",
        "ca": f"SELECT DISTINCT customer_id FROM orders_v WHERE {inph(CRISIS)}",
        "cr_r": CLEAN_RATINGS,
        "pr": f"""SELECT customer_id, SUM(rating) AS s, COUNT(rating) AS n, AVG(rating) AS a FROM cr_r
                  WHERE order_id IN (SELECT order_id FROM orders_v WHERE {inph(PRE)}) GROUP BY customer_id""",
        "f": """SELECT rep.customer_id, ca.customer_id IS NOT NULL AS act, pr.s, pr.n, pr.a
                FROM rep LEFT JOIN ca ON rep.customer_id = ca.customer_id
                     LEFT JOIN pr ON rep.customer_id = pr.customer_id""",
    }


def _rfm_base_sql(src: str, key: str, ts: str, amount: str, ref: str, freq: str) -> str:
    return f"""SELECT {key} AS customer_id,
        CAST(FLOOR((epoch_us(TIMESTAMP '{ref}') - epoch_us(MAX({ts}))) / 86400000000) AS BIGINT) AS recency,
        CAST({freq} AS BIGINT) AS frequency,
        CAST(ROUND(SUM(CAST({amount} AS DECIMAL(38,12))), 2) AS DOUBLE) AS monetary
        FROM {src} GROUP BY {key}"""


ORDERS_RFM = _rfm_base_sql(f"orders_v WHERE {NOT_CANCELLED}", "customer_id", "order_timestamp",
                           "total_amount", f"{P.rfm_reference_date:%Y-%m-%d %H:%M:%S}", "COUNT(order_id)")
EVENTS_RFM = _rfm_base_sql("events", "user_id", "ts", "value", f"{EVENTS_REFERENCE_DATE:%Y-%m-%d %H:%M:%S}",
                           "COUNT(*)")


def _scores_ctes(base_sql: str) -> dict[str, str]:
    return {
        "b": base_sql,
        "qq": f"""SELECT quantile_cont(CAST(recency AS DOUBLE), {THIRD}) AS r1,
                         quantile_cont(CAST(recency AS DOUBLE), {TWO_THIRDS}) AS r2,
                         quantile_cont(monetary, {THIRD}) AS m1, quantile_cont(monetary, {TWO_THIRDS}) AS m2,
                         COUNT(*) AS n FROM b""",
        "rk": "SELECT b.*, ROW_NUMBER() OVER (ORDER BY frequency, customer_id) AS fr FROM b",
        "sc": """SELECT customer_id, recency, frequency, monetary,
                   CAST(CASE WHEN recency <= r1 THEN 3 WHEN recency <= r2 THEN 2 ELSE 1 END AS INTEGER) AS r_score,
                   CAST(CASE WHEN fr = 1 OR 3 * (fr - 1) < (n - 1) THEN 1
                             WHEN 3 * (fr - 1) < 2 * (n - 1) THEN 2 ELSE 3 END AS INTEGER) AS f_score,
                   CAST(CASE WHEN monetary <= m1 THEN 1 WHEN monetary <= m2 THEN 2 ELSE 3 END AS INTEGER) AS m_score
                 FROM rk CROSS JOIN qq""",
        "s": "SELECT *, CAST(r_score + f_score + m_score AS INTEGER) AS rfm_score FROM sc",
        "seg": """SELECT *, CASE WHEN rfm_score >= 8 THEN 'Champions' WHEN rfm_score >= 6 THEN 'Loyal'
                   WHEN rfm_score >= 5 THEN 'At Risk' WHEN rfm_score >= 4 THEN 'Needs Attention'
                   ELSE 'Lost' END AS segment FROM s""",
    }


SEGMENT_ORDER_VALUES = ", ".join(f"('{n}', {i})" for i, n in enumerate(SEGMENT_ORDER, start=1))
SEGMENTS_SQL = f"""SELECT o.segment, x.customer_count, x.avg_recency, x.avg_frequency, x.avg_monetary,
        CAST(o.display_order AS INTEGER) AS display_order
    FROM (VALUES {SEGMENT_ORDER_VALUES}) o(segment, display_order)
    LEFT JOIN (SELECT segment, COUNT(customer_id) AS customer_count, {mean('recency', 1)} AS avg_recency,
                      {mean('frequency', 2)} AS avg_frequency, {mean('monetary', 2)} AS avg_monetary
               FROM seg GROUP BY segment) x ON o.segment = x.segment"""

# Profile tables: logical name -> (binding view, [(column, spark type)]).
PROFILE = {
    "fact_orders": ("orders_full_v", [("order_id", "bigint"), ("customer_id", "bigint"),
                                      ("restaurant_id", "bigint"), ("delivery_partner_id", "bigint"),
                                      ("order_timestamp", "timestamp_ntz"),
                                      ("subtotal_amount", "decimal(18,2)"), ("discount_amount", "decimal(18,2)"),
                                      ("delivery_fee", "decimal(18,2)"), ("total_amount", "decimal(18,2)"),
                                      ("is_cod", "string"), ("is_cancelled", "string")]),
    "fact_order_items": ("order_items_v", [("order_id", "bigint"), ("item_id", "string"),
                                           ("menu_item_id", "bigint"), ("restaurant_id", "bigint"),
                                           ("quantity", "int"), ("unit_price", "decimal(18,2)"),
                                           ("item_discount", "decimal(18,2)"), ("line_total", "decimal(18,2)")]),
    "fact_ratings": ("ratings_v", [("order_id", "bigint"), ("customer_id", "bigint"), ("restaurant_id", "bigint"),
                                   ("rating", "double"), ("review_text", "string"),
                                   ("review_timestamp", "string"), ("sentiment_score", "double")]),
    "fact_delivery": ("delivery_v", [("order_id", "bigint"), ("actual_delivery_time_mins", "int"),
                                     ("expected_delivery_time_mins", "int"), ("distance_km", "double")]),
    "dim_customer": ("customers_v", [("customer_id", "bigint"), ("city", "string"),
                                     ("acquisition_channel", "string")]),
    "dim_restaurant": ("restaurants_v", [("restaurant_id", "bigint"), ("restaurant_name", "string"),
                                         ("cuisine_type", "string"), ("partner_type", "string"),
                                         ("is_active", "string")]),
    "dim_delivery_partner": ("partners_v", [("delivery_partner_id", "bigint"), ("partner_name", "string"),
                                            ("city", "string"), ("avg_rating", "double")]),
    "dim_menu_item": ("menu_v", [("menu_item_id", "bigint"), ("restaurant_id", "bigint"), ("item_name", "string"),
                                 ("category", "string"), ("is_veg", "string"), ("price", "decimal(18,2)")]),
}


def _union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def _describe() -> str:
    stats = [("count", lambda c: f"CAST(COUNT({c}) AS DOUBLE)"),
             ("mean", lambda c: mean(c, 2)),
             ("std", lambda c: rd(f"STDDEV_SAMP({c})")),
             ("min", lambda c: rd(f"CAST(MIN({c}) AS DOUBLE)")),
             ("25%", lambda c: rd(f"quantile_cont(CAST({c} AS DOUBLE), 0.25)")),
             ("50%", lambda c: rd(f"quantile_cont(CAST({c} AS DOUBLE), 0.5)")),
             ("75%", lambda c: rd(f"quantile_cont(CAST({c} AS DOUBLE), 0.75)")),
             ("max", lambda c: rd(f"CAST(MAX({c}) AS DOUBLE)"))]
    return _union([f"""SELECT '{label}' AS statistic, {f('recency')} AS recency, {f('frequency')} AS frequency,
                       {f('monetary')} AS monetary FROM b""" for label, f in stats])


def _profile_sql() -> dict[str, str]:
    shapes = _union([f"SELECT '{t}' AS table_name, COUNT(*) AS rows, CAST({len(cols)} AS INTEGER) AS columns FROM {v}"
                     for t, (v, cols) in PROFILE.items()])
    totals = _union([
        f"SELECT '{t}' AS table_name, CAST(" + " + ".join(f"COUNT(*) FILTER (WHERE {c} IS NULL)" for c, _ in cols)
        + f" AS BIGINT) AS null_values FROM {v}" for t, (v, cols) in PROFILE.items()])
    per_col = _union([
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, {cnt(f'{c} IS NULL')} AS null_count FROM {v}"
        for t, (v, cols) in PROFILE.items() if t in ("fact_orders", "fact_ratings") for c, _ in cols])
    dtypes = _union([
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, '{ty}' AS data_type, COUNT({c}) AS non_null FROM {v}"
        for t, (v, cols) in PROFILE.items() for c, ty in cols])
    return {"d01_shapes": _with(shapes), "d02_null_totals": _with(totals),
            "d03_null_columns": _with(per_col), "d04_dtypes": _with(dtypes)}


def _activity_sql() -> dict[str, str]:
    """Distinct keys per month and phase, and joins of them with each other."""
    seen = "SELECT DISTINCT customer_id AS k, date_trunc('month', order_timestamp) AS m FROM orders_v WHERE customer_id IS NOT NULL AND order_timestamp IS NOT NULL"

    def phases(table, key, entity):
        flags = ", ".join(f"COALESCE(BOOL_OR({inph(x)}), FALSE) AS p{i}" for i, x in enumerate((PRE, CRISIS, RECOVERY)))
        return f"SELECT '{entity}' AS entity, {key} AS k, {flags}, COUNT(*) AS events FROM {table} WHERE {key} IS NOT NULL GROUP BY {key}"

    steps = [(0, 1), (0, 2), (1, 2)]
    names = (PRE, CRISIS, RECOVERY)
    matrix = " UNION ALL ".join(f"""SELECT entity, '{names[a]}' AS base_phase, '{names[b]}' AS later_phase, {cnt(f'p{a}')} AS total,
        {cnt(f'p{a} AND NOT p{b}')} AS churned, {cnt(f'p{a} AND p{b}')} AS retained,
        {hu(f'COUNT(*) FILTER (WHERE p{a} AND NOT p{b})', f'COUNT(*) FILTER (WHERE p{a})', 2, 100)} AS churn_rate_pct
        FROM per GROUP BY entity""" for a, b in steps)
    return {
        "a01_month_flow": _with(f"""SELECT strftime(f.m, '%Y-%m') AS month, active, retained, new, active - retained - new AS returned,
            CASE WHEN f.m > DATE '{START}' THEN COALESCE((SELECT COUNT(*) FROM seen p WHERE p.m = f.m - INTERVAL 1 MONTH), 0) - retained END AS churned
            FROM flow f""", {
            "seen": seen, "firsts": "SELECT k, MIN(m) AS m FROM seen GROUP BY k",
            "flow": f"""SELECT s.m, COUNT(*) AS active, {cnt('p.k IS NOT NULL')} AS retained, {cnt('s.m = f.m')} AS new
                        FROM seen s JOIN firsts f ON f.k = s.k LEFT JOIN seen p ON p.k = s.k AND p.m = s.m - INTERVAL 1 MONTH GROUP BY s.m"""}),
        "a02_phase_patterns": _with("""SELECT p0 AS in_pre, p1 AS in_crisis, p2 AS in_recovery, COUNT(*) AS customers,
            CAST(SUM(events) AS BIGINT) AS orders FROM per GROUP BY 1, 2, 3""", {"per": phases("orders_v", "customer_id", "customer")}),
        "a03_churn_matrix": _with(matrix, {"per": phases("orders_v", "customer_id", "customer") + " UNION ALL "
                                           + phases("order_lines_v", "restaurant_id", "restaurant")}),
    }


def oracle_sql() -> dict[str, str]:
    hv_c = _high_value_ctes()
    rep_c = _repeat_ctes()
    city_pivot = {"per": f"""SELECT c.city, {cnt(inph(PRE, 'o.order_timestamp'))} AS pre_crisis_orders,
                                   {cnt(inph(CRISIS, 'o.order_timestamp'))} AS crisis_orders
                             FROM orders_v o JOIN customers_v c ON o.customer_id = c.customer_id
                             WHERE c.city IS NOT NULL GROUP BY c.city"""}
    rest_pivot = {"per": f"""SELECT restaurant_id, {cnt(inph(PRE))} AS pre, {cnt(inph(CRISIS))} AS cri
                             FROM order_lines_v GROUP BY restaurant_id"""}
    reviews = {"cr_r": CLEAN_RATINGS, "rv": f"SELECT *, {REVIEW_TS} AS review_ts FROM cr_r",
               "rvm": "SELECT * FROM rv"}
    monthly_rating = f"""SELECT {month('review_ts')} AS month, {mean('rating')} AS avg_rating,
                           COUNT(rating) AS total_reviews FROM rvm GROUP BY 1"""
    activity = {"act": f"""SELECT restaurant_id, COUNT(*) FILTER (WHERE {inph(PRE)}) > 0 AS pre_active,
                                  COUNT(*) FILTER (WHERE {inph(RECOVERY)}) > 0 AS recovery_active
                           FROM order_lines_v WHERE restaurant_id IS NOT NULL GROUP BY restaurant_id""",
                "churned": """SELECT * FROM restaurants_v WHERE restaurant_id IN
                              (SELECT restaurant_id FROM act WHERE pre_active AND NOT recovery_active)"""}

    def vc(src: str, col: str, name: str, k: int | None) -> str:
        lim = f" ORDER BY {name} DESC, {col} LIMIT {k}" if k else ""
        return f"SELECT {col}, COUNT(*) AS {name} FROM {src} WHERE {col} IS NOT NULL GROUP BY {col}{lim}"

    q = {
        "s01_monthly_orders": _with(f"""SELECT {month('order_timestamp')} AS order_month, {ph()} AS business_phase,
            COUNT(order_id) AS total_orders FROM orders_v GROUP BY 1, 2"""),
        "s02_phase_revenue": _with(f"""SELECT {ph()} AS business_phase, COUNT(order_id) AS total_orders,
            CAST(ROUND(SUM(total_amount), 2) AS DOUBLE) AS total_revenue,
            {hu('SUM(total_amount)', '10000000', 2, num_scale=2)} AS revenue_in_crores,
            {hu('SUM(total_amount)', 'COUNT(total_amount)', 2, num_scale=2)} AS avg_order_value
            FROM orders_v WHERE is_cancelled = 'N' GROUP BY 1"""),
        "s03_city_phase_cancel": _with(f"""SELECT c.city, {ph('o.order_timestamp')} AS business_phase,
            COUNT(o.order_id) AS total_orders, {cnt("o.is_cancelled = 'Y'")} AS cancelled_orders,
            {hu("COUNT(*) FILTER (WHERE o.is_cancelled = 'Y')", 'COUNT(o.order_id)', 2, 100)} AS cancellation_rate_pct
            FROM orders_v o JOIN customers_v c ON o.customer_id = c.customer_id GROUP BY 1, 2"""),
        "s04_restaurant_decline": _with(f"""SELECT p.restaurant_id, r.restaurant_name, r.cuisine_type,
            {hu('pre', MP, 1)} AS pre_crisis_avg_monthly_orders, {hu('cri', MC, 1)} AS crisis_avg_monthly_orders,
            {hu(f'pre * {MC} - cri * {MP}', f'pre * {MC}', 2, 100)} AS decline_pct
            FROM per p JOIN restaurants_v r ON p.restaurant_id = r.restaurant_id
            WHERE pre >= {P.restaurant_min_pre_orders}
            ORDER BY decline_pct DESC, p.restaurant_id LIMIT {P.top_restaurants}""", rest_pivot),
        "s05_sla_by_phase": _with(f"""SELECT {ph('o.order_timestamp')} AS business_phase,
            {mean('d.actual_delivery_time_mins')} AS avg_actual_delivery_mins,
            {mean('d.expected_delivery_time_mins')} AS avg_expected_delivery_mins,
            {mean('(d.actual_delivery_time_mins - d.expected_delivery_time_mins)')} AS avg_delay_mins,
            {hu(f'COUNT(*) FILTER (WHERE {BREACH})', 'COUNT(*)', 2, 100)} AS sla_breach_rate_pct
            FROM orders_v o JOIN delivery_v d ON o.order_id = d.order_id GROUP BY 1"""),
        "s06_loyal_churn": _with(f"""SELECT COUNT(l.customer_id) AS total_loyal_customers,
            {cnt('ca.customer_id IS NULL')} AS churned_loyal_customers,
            {cnt('ca.customer_id IS NOT NULL')} AS retained_loyal_customers,
            {hu('COUNT(*) FILTER (WHERE ca.customer_id IS NULL)', 'COUNT(l.customer_id)', 2, 100)} AS churn_rate_pct
            FROM loyal l LEFT JOIN ca ON l.customer_id = ca.customer_id""", {
            "loyal": f"""SELECT customer_id FROM orders_v WHERE {inph(PRE)} GROUP BY customer_id
                         HAVING COUNT(order_id) >= {P.loyal_min_pre_orders}""",
            "ca": f"SELECT DISTINCT customer_id FROM orders_v WHERE {inph(CRISIS)}"}),
        "s07_high_value_by_city": _with(f"""SELECT city, COUNT(customer_id) AS high_value_customers,
            {hu('SUM(total_spend)', 'COUNT(total_spend)', 2, num_scale=2)} AS avg_spend_per_customer,
            CAST(ROUND(MIN(total_spend), 2) AS DOUBLE) AS min_spend_threshold
            FROM rc WHERE spending_group = 1 GROUP BY city""", {
            "cs": f"""SELECT o.customer_id, c.city, SUM(o.total_amount) AS total_spend
                      FROM orders_v o JOIN customers_v c ON o.customer_id = c.customer_id
                      WHERE {inph(PRE, 'o.order_timestamp')} AND o.is_cancelled = 'N' GROUP BY 1, 2""",
            "rc": f"""SELECT *, NTILE({P.ntile_groups}) OVER (ORDER BY total_spend DESC, customer_id)
                      AS spending_group FROM cs"""}),
        "s08_monthly_rating": _with(f"""SELECT {month('o.order_timestamp')} AS order_month,
            {ph('o.order_timestamp')} AS business_phase, COUNT(r.order_id) AS total_reviews,
            {mean('r.rating')} AS avg_rating, {mean('r.sentiment_score')} AS avg_sentiment_score
            FROM orders_v o JOIN ratings_v r ON o.order_id = r.order_id GROUP BY 1, 2"""),
        "s09_delay_vs_rating": _with(f"""SELECT CASE WHEN {BREACH} THEN 'Delayed' ELSE 'On Time' END AS delivery_status,
            COUNT(o.order_id) AS total_orders, {mean('r.rating')} AS avg_customer_rating,
            {mean('r.sentiment_score')} AS avg_sentiment_score,
            {mean('d.actual_delivery_time_mins')} AS avg_delivery_mins
            FROM orders_v o JOIN delivery_v d ON o.order_id = d.order_id
                 JOIN ratings_v r ON o.order_id = r.order_id GROUP BY 1"""),
        "s10_recovery_scorecard": _with(f"""SELECT {ph('o.order_timestamp')} AS business_phase,
            COUNT(o.order_id) AS total_orders, {mean('r.rating')} AS avg_rating,
            {mean('r.sentiment_score')} AS avg_sentiment, {mean('d.actual_delivery_time_mins')} AS avg_delivery_mins,
            {hu(f'COUNT(*) FILTER (WHERE {BREACH})', 'COUNT(o.order_id)', 2, 100)} AS sla_breach_pct,
            {hu("COUNT(*) FILTER (WHERE o.is_cancelled = 'Y')", 'COUNT(o.order_id)', 2, 100)} AS cancellation_rate_pct
            FROM orders_v o LEFT JOIN ratings_v r ON o.order_id = r.order_id
                 LEFT JOIN delivery_v d ON o.order_id = d.order_id GROUP BY 1"""),

        "p01_order_trend": _with(f"""SELECT {month('order_timestamp')} AS month, {ph()} AS phase,
            COUNT(order_id) AS total_orders FROM orders_v WHERE order_timestamp IS NOT NULL GROUP BY 1, 2"""),
        "p01_decline_metrics": _with(f"""SELECT {hu('pt', 'pm', 0)} AS pre_crisis_monthly_avg,
            {hu('ct', 'cm', 0)} AS crisis_monthly_avg, {hu('pt * cm - ct * pm', 'pt * cm', 2, 100)} AS decline_pct
            FROM agg""", {
            "mo": f"""SELECT {month('order_timestamp')} AS month, {ph()} AS phase, COUNT(order_id) AS total_orders
                      FROM orders_v WHERE order_timestamp IS NOT NULL GROUP BY 1, 2""",
            "agg": f"""SELECT SUM(total_orders) FILTER (WHERE phase = '{PRE}') AS pt,
                              COUNT(*) FILTER (WHERE phase = '{PRE}') AS pm,
                              SUM(total_orders) FILTER (WHERE phase = '{CRISIS}') AS ct,
                              COUNT(*) FILTER (WHERE phase = '{CRISIS}') AS cm FROM mo"""}),
        "p02_city_decline": _with(f"""SELECT city, pre_crisis_orders, crisis_orders,
            {hu('pre_crisis_orders - crisis_orders', 'pre_crisis_orders', 2, 100)} AS decline_pct
            FROM per WHERE pre_crisis_orders > 0 AND crisis_orders > 0
            ORDER BY decline_pct DESC, city LIMIT {P.top_cities}""", city_pivot),
        "p02_unmatched_orders": _with(f"""SELECT {cnt('c.customer_id IS NULL')} AS unmatched_orders,
            COUNT(*) AS total_orders, {hu('COUNT(*) FILTER (WHERE c.customer_id IS NULL)', 'COUNT(*)', 2, 100)} AS unmatched_pct
            FROM orders_v o LEFT JOIN (SELECT DISTINCT customer_id FROM customers_v) c
                 ON o.customer_id = c.customer_id"""),
        "p03_restaurant_decline": _with(f"""SELECT p.restaurant_id, r.restaurant_name, r.cuisine_type,
            pre AS pre_crisis_orders, cri AS crisis_orders, {hu('pre - cri', 'pre', 2, 100)} AS decline_pct
            FROM per p LEFT JOIN restaurants_v r ON p.restaurant_id = r.restaurant_id
            WHERE pre >= {P.restaurant_min_pre_orders} AND cri > 0
            ORDER BY decline_pct DESC, p.restaurant_id LIMIT {P.top_restaurants}""", rest_pivot),
        "p04_phase_cancel": _with(f"""SELECT {ph()} AS phase, COUNT(order_id) AS total_orders,
            {cnt("is_cancelled = 'Y'")} AS cancelled_orders,
            {hu("COUNT(*) FILTER (WHERE is_cancelled = 'Y')", 'COUNT(order_id)', 2, 100)} AS cancellation_rate
            FROM orders_v GROUP BY 1"""),
        "p04_city_cancel_crisis": _with(f"""SELECT c.city, COUNT(o.order_id) AS total_orders,
            {cnt("o.is_cancelled = 'Y'")} AS cancelled_orders,
            {hu("COUNT(*) FILTER (WHERE o.is_cancelled = 'Y')", 'COUNT(o.order_id)', 2, 100)} AS cancellation_rate
            FROM orders_v o JOIN customers_v c ON o.customer_id = c.customer_id
            WHERE c.city IS NOT NULL AND {inph(CRISIS, 'o.order_timestamp')}
            GROUP BY c.city ORDER BY cancellation_rate DESC, c.city LIMIT {P.top_cancel_cities}"""),
        "p05_sla": _with(f"""SELECT {ph('o.order_timestamp')} AS phase,
            {mean('d.actual_delivery_time_mins', 1)} AS avg_actual_time,
            {mean('d.expected_delivery_time_mins', 1)} AS avg_expected_time,
            {hu(f'COUNT(*) FILTER (WHERE {BREACH})', 'COUNT(*)', 2, 100)} AS breach_rate_pct,
            {mean('(d.actual_delivery_time_mins - d.expected_delivery_time_mins)', 1)} AS avg_delay_mins
            FROM delivery_v d JOIN orders_v o ON d.order_id = o.order_id GROUP BY 1"""),
        "p06_monthly_rating": _with(monthly_rating, reviews),
        "p06_sharpest_drop": _with("""SELECT prev_month, month, prev_avg_rating, avg_rating,
            CAST(CAST(prev_avg_rating AS DECIMAL(10,2)) - CAST(avg_rating AS DECIMAL(10,2)) AS DOUBLE) AS rating_drop
            FROM st WHERE prev_month IS NOT NULL ORDER BY rating_drop DESC, month LIMIT 1""", {
            **reviews, "mr": monthly_rating,
            "st": """SELECT month, avg_rating, LAG(month) OVER (ORDER BY month) AS prev_month,
                            LAG(avg_rating) OVER (ORDER BY month) AS prev_avg_rating FROM mr"""}),
        "p07_negative_keywords": _with(f"""SELECT word AS keyword, COUNT(*) AS frequency FROM w
            WHERE word IN ({', '.join(f"'{x}'" for x in sorted(set(P.keywords)))})
              AND regexp_full_match(word, '[a-z]+')
            GROUP BY word ORDER BY frequency DESC, keyword LIMIT {P.top_keywords}""", {
            "cr_r": CLEAN_RATINGS,
            "rv": f"""SELECT * FROM cr_r WHERE order_id IN (SELECT order_id FROM orders_v WHERE {inph(P.keyword_phase)})
                      AND rating <= {P.low_rating}""",
            "w": r"""SELECT unnest(regexp_split_to_array(regexp_replace(lower(review_text), '[^\p{L}\p{N}_]+', ' ', 'g'),
                     ' ')) AS word FROM rv"""}),
        "p08_revenue": _with(f"""SELECT {ph()} AS phase, COUNT(order_id) AS total_orders,
            CAST(ROUND(SUM(subtotal_amount), 2) AS DOUBLE) AS total_subtotal,
            CAST(ROUND(SUM(discount_amount), 2) AS DOUBLE) AS total_discount,
            CAST(ROUND(SUM(delivery_fee), 2) AS DOUBLE) AS total_delivery,
            CAST(ROUND(SUM(total_amount), 2) AS DOUBLE) AS total_revenue,
            {hu('SUM(total_amount)', 'COUNT(total_amount)', 2, num_scale=2)} AS avg_order_value
            FROM orders_full_v WHERE {NOT_CANCELLED} GROUP BY 1"""),
        "p08_revenue_loss": _with(f"""SELECT {hu('rp', MP, 2, num_scale=2)} AS pre_monthly_avg_revenue,
            {hu('rc', MC, 2, num_scale=2)} AS crisis_monthly_avg_revenue,
            {hu(f'rp * {MC} - rc * {MP}', MP * MC, 2, num_scale=2)} AS monthly_revenue_loss,
            {hu(f'(rp * {MC} - rc * {MP}) * {MC}', MP * MC, 2, num_scale=2)} AS total_crisis_loss FROM t""", {
            "t": f"""SELECT SUM(total_amount) FILTER (WHERE {inph(PRE)}) AS rp,
                            SUM(total_amount) FILTER (WHERE {inph(CRISIS)}) AS rc
                     FROM orders_v WHERE {NOT_CANCELLED}"""}),
        "p09_loyalty_churn": _with(f"""SELECT COUNT(*) AS repeat_customers,
            {cnt('NOT act')} AS churned_customers, {cnt(f'NOT act AND s > {P.high_rating} * n')} AS churned_high_rated,
            {mean('CASE WHEN NOT act THEN a END')} AS avg_rating_churned FROM f""", rep_c),
        "p09_churn_split": _with(f"""SELECT {cnt('NOT act')} AS churned, {cnt('act')} AS retained,
            {cnt(f'NOT act AND s > {P.high_rating} * n')} AS churned_rating_above,
            {cnt(f'NOT act AND NOT COALESCE(s > {P.high_rating} * n, FALSE)')} AS churned_not_above FROM f""", rep_c),
        "p10_high_value_profile": _with("""SELECT customer_id, CAST(total_spend AS DOUBLE) AS total_spend, order_count,
            crisis_order_count, order_count - crisis_order_count AS order_drop, pre_crisis_rating, crisis_rating,
            pre_crisis_rating - crisis_rating AS rating_drop FROM hv""", hv_c),
        "p10_hv_city": _with(vc("hvc", "city", "customers", P.top_values), {
            **hv_c, "hvc": "SELECT hv.customer_id, c.city FROM hv LEFT JOIN customers_v c ON hv.customer_id = c.customer_id"}),
        "p10_hv_channel": _with(vc("hvc", "acquisition_channel", "customers", None), {
            **hv_c, "hvc": """SELECT hv.customer_id, c.acquisition_channel FROM hv
                              LEFT JOIN customers_v c ON hv.customer_id = c.customer_id"""}),
        "p10_hv_cuisine": _with(vc("hvo", "cuisine_type", "orders", P.top_values), {
            **hv_c, "hvo": f"""SELECT l.*, r.cuisine_type FROM order_lines_v l
                               LEFT JOIN restaurants_v r ON l.restaurant_id = r.restaurant_id
                               WHERE {inph(PRE, 'l.order_timestamp')}
                                 AND l.customer_id IN (SELECT customer_id FROM hv)"""}),
        "p10_hv_churn": _with(f"""SELECT {rd('MAX(spend_threshold)')} AS spend_threshold,
            COUNT(*) AS high_value_customers, {cnt('crisis_order_count = 0')} AS zero_crisis_customers,
            {hu('COUNT(*) FILTER (WHERE crisis_order_count = 0)', 'COUNT(*)', 2, 100)} AS zero_crisis_pct,
            {mean('pre_crisis_rating')} AS avg_pre_crisis_rating FROM hv""", hv_c),

        "r01_rfm_base": _with(ORDERS_RFM),
        "r02_rfm_describe": _with(_describe(), {"b": ORDERS_RFM}),
        "r03_rfm_scores": _with("""SELECT customer_id, recency, frequency, monetary, r_score, f_score, m_score,
            rfm_score FROM s""", _scores_ctes(ORDERS_RFM)),
        "r04_score_distribution": _with("SELECT rfm_score, COUNT(*) AS customers FROM s GROUP BY rfm_score",
                                        _scores_ctes(ORDERS_RFM)),
        "r05_segments": _with(SEGMENTS_SQL, _scores_ctes(ORDERS_RFM)),
        "r06_recoverable": _with("""SELECT CAST(COUNT(*) FILTER (WHERE segment IN ('Champions', 'Loyal', 'At Risk'))
            AS BIGINT) AS recoverable_customers, COUNT(*) AS total_customers FROM seg""", _scores_ctes(ORDERS_RFM)),
        "r07_no_history": _with("""SELECT COUNT(*) AS customers_without_orders FROM customers_v c
            WHERE c.customer_id NOT IN (SELECT customer_id FROM b)""", {"b": ORDERS_RFM}),
        "r01_rfm_base_events": _with(EVENTS_RFM),
        "r02_rfm_describe_events": _with(_describe(), {"b": EVENTS_RFM}),

        "x01_behavior_shift": _with(f"""SELECT {month('order_timestamp')} AS month, {ph()} AS phase,
            COUNT(order_id) AS total_orders, {mean('total_amount')} AS avg_order_value,
            {mean('discount_amount')} AS avg_discount, {mean('delivery_fee')} AS avg_delivery_fee
            FROM orders_full_v WHERE {NOT_CANCELLED} GROUP BY 1, 2"""),
        "x02_negative_reviews": _with(f"""SELECT {month('review_ts')} AS month,
            {mean('sentiment_score', 3)} AS avg_sentiment, {cnt('sentiment_score < 0')} AS negative_reviews,
            COUNT(sentiment_score) AS total_reviews,
            {hu('COUNT(*) FILTER (WHERE sentiment_score < 0)', 'COUNT(sentiment_score)', 2, 100)} AS negative_pct
            FROM rvm GROUP BY 1""", reviews),
        "x03_restaurant_churn": _with(f"""SELECT {cnt('pre_active')} AS pre_active_restaurants,
            {cnt('recovery_active')} AS recovery_active_restaurants,
            {cnt('pre_active AND NOT recovery_active')} AS churned_restaurants,
            {hu('COUNT(*) FILTER (WHERE pre_active AND NOT recovery_active)', 'COUNT(*) FILTER (WHERE pre_active)', 2, 100)}
              AS churn_rate_pct FROM act""", activity),
        "x03_churn_partner_type": _with(vc("churned", "partner_type", "restaurants", None), activity),
        "x03_churn_cuisine": _with(vc("churned", "cuisine_type", "restaurants", P.top_churn_cuisines), activity),
        "x03_churn_active": _with(vc("churned", "is_active", "restaurants", None), activity),

        "d05_phase_counts": _with(f"SELECT {ph()} AS phase, COUNT(*) AS orders FROM orders_v GROUP BY 1"),
        "d06_month_counts": _with(f"""SELECT {month('order_timestamp')} AS month, COUNT(order_id) AS orders
            FROM orders_v WHERE order_timestamp IS NOT NULL GROUP BY 1"""),
        "d07_date_range": _with("""SELECT CAST(MIN(order_timestamp) AS DATE) AS first_date,
            CAST(MAX(order_timestamp) AS DATE) AS last_date FROM orders_v"""),
        "d08_after_dropna": _with("""SELECT (SELECT COUNT(*) FROM cr_r) AS ratings_after_dropna,
            (SELECT CAST(COUNT(*) FILTER (WHERE delivery_partner_id IS NULL) AS BIGINT) FROM orders_full_v)
            AS partner_id_nulls_retained""", {"cr_r": CLEAN_RATINGS}),

        "m01_active_customers": _with(f"""SELECT phase, active_customers,
            {hu('b - active_customers', 'b', 2, 100)} AS decline_vs_pre_pct
            FROM ac CROSS JOIN (SELECT active_customers AS b FROM ac WHERE phase = '{PRE}') base""", {
            "ac": f"SELECT {ph()} AS phase, COUNT(DISTINCT customer_id) AS active_customers FROM orders_v GROUP BY 1"}),
        "m02_city_absolute_loss": _with("""SELECT city, pre_crisis_orders, crisis_orders,
            pre_crisis_orders - crisis_orders AS absolute_loss FROM per""", city_pivot),
        "m03_city_share": _with(f"""SELECT city, customers, {hu('customers', 't', 2, 100)} AS share_pct,
            {hu('SUM(customers) OVER (ORDER BY customers DESC, city ROWS UNBOUNDED PRECEDING)', 't', 2, 100)}
              AS cumulative_share_pct
            FROM top CROSS JOIN (SELECT COUNT(*) AS t FROM hvc) tot""", {
            **hv_c, "hvc": "SELECT hv.customer_id, c.city FROM hv LEFT JOIN customers_v c ON hv.customer_id = c.customer_id",
            "top": vc("hvc", "city", "customers", P.share_top_cities)}),
    }
    q.update(_profile_sql())
    q.update(_activity_sql())
    q["d09_head_orders"] = _with("SELECT * FROM orders_v ORDER BY order_id LIMIT 10")
    q["k01_written_trend"] = q["s01_monthly_orders"]
    q["j01_city_cancel_salted"] = q["s03_city_phase_cancel"]
    q["c01_csv_phase_revenue"] = q["s02_phase_revenue"]
    q["c02_csv_negative_keywords"] = q["p07_negative_keywords"]
    q["c03_namespace_scorecard"] = q["s10_recovery_scorecard"]
    q.update({f"sql_{name}": q[name] for name in list(q) if name.startswith("s")})
    return q
