"""Direct tests of the composed operators."""

import datetime as dt

from phaselens.functions.calendar import CRISIS, PRE, REFERENCE_CALENDAR
from phaselens.operators.binning import quantile_bins
from phaselens.operators.churn import churn_summary, key_difference
from phaselens.operators.compare import count_in, phase_pivot
from phaselens.operators.keywords import keyword_frequency
from phaselens.operators.profile import head_sample, profile
from phaselens.operators.topshare import top_share


def test_phase_pivot_is_one_conditional_aggregation(spark):
    rows = [("A", dt.datetime(2025, 1, 1)), ("A", dt.datetime(2025, 6, 2)), ("A", dt.datetime(2025, 2, 1)),
            ("B", dt.datetime(2025, 7, 1)), ("C", dt.datetime(2025, 9, 1))]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz").withColumn(
        "phase", REFERENCE_CALENDAR.phase_col("ts"))
    out = phase_pivot(df, ["k"], "phase", {"pre": (PRE, count_in), "cri": (CRISIS, count_in)})
    got = {r.k: (r.pre, r.cri) for r in out.collect()}
    assert got == {"A": (2, 1), "B": (0, 1), "C": (0, 0)}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan  # no self-join of per-phase aggregates


def test_churn_summary_and_key_difference(spark):
    base = spark.createDataFrame([(i,) for i in range(10)], "k int")
    active = spark.createDataFrame([(i,) for i in (1, 2, 2, 3, 42)], "k int")
    row = churn_summary(base, active, "k").first()
    assert (row.total, row.churned, row.retained, row.churn_rate_pct) == (10, 7, 3, 70.0)
    assert sorted(r.k for r in key_difference(base, active, "k").collect()) == [0, 4, 5, 6, 7, 8, 9]


def test_top_share_methods(spark):
    # 40 customers; the top two tie: the quantile keeps both ties, NTILE(20) takes exactly two rows
    rows = [(f"C{i:02d}", float(1000 if i < 2 else i)) for i in range(40)]
    df = spark.createDataFrame(rows, "customer_id string, spend double")
    q = top_share(df, "spend", 0.05, "customer_id", method="quantile", threshold_col="thr")
    assert sorted(r.customer_id for r in q.collect()) == ["C00", "C01"]
    n = top_share(df, "spend", 0.05, "customer_id", method="ntile")
    assert sorted(r.customer_id for r in n.collect()) == ["C00", "C01"]
    # 41 rows: NTILE(20) gives the first tile 3 rows, split by the key among ties
    df41 = spark.createDataFrame(rows + [("C99", 1000.0)], "customer_id string, spend double")
    assert sorted(r.customer_id for r in top_share(df41, "spend", 0.05, "customer_id", method="ntile")
                  .collect()) == ["C00", "C01", "C99"]


def test_profile_single_scan(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, 5.0, None), (None, None, "z")], "a int, b double, c string")
    got = {r.column_name: (r.data_type, r.null_count, r.non_null, r.rows) for r in profile(df).collect()}
    assert got == {"a": ("int", 1, 2, 3), "b": ("double", 2, 1, 3), "c": ("string", 1, 2, 3)}


def test_keyword_frequency_counts_every_occurrence_and_breaks_ties(spark):
    df = spark.createDataFrame([("late2 café bad_x cold, stale-late 5late it's",), ("Cold cold LATE",),
                                (None,), ("nothing here",)], "t string")
    got = [(r.keyword, r.frequency) for r in keyword_frequency(df, "t", ["cold", "late", "stale", "bad"], 2)
           .collect()]
    assert got == [("cold", 3), ("late", 2)]  # stale (1) is cut; bad_x is not "bad"


def test_head_sample_is_ordered(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(20)], "k int, g int")
    assert [r.k for r in head_sample(df, ["g", "k"], 4).collect()] == [0, 3, 6, 9]


def test_quantile_bins_drop_mode_keeps_going(spark):
    df = spark.createDataFrame([(i, 1.0 if i < 8 else 2.0) for i in range(10)], "k long, v double")
    got = {r.k: r.b for r in quantile_bins(df, "v", 3, [1, 2, 3], "k", "b", on_duplicate="drop").collect()}
    assert set(got.values()) <= {1, 2, 3} and got[0] == 1 and got[9] == 3
