import datetime as dt
import re
from decimal import ROUND_HALF_UP, Decimal
from fractions import Fraction

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from phaselens.functions.calendar import CRISIS, PRE, RECOVERY, REFERENCE_CALENDAR, with_phase
from phaselens.functions.metrics import decline_pct, pct, ratio, round_double
from phaselens.functions.text import ascii_words
from phaselens.functions.timeparse import parse_mixed_ts

US = dt.timedelta(microseconds=1)


def test_phase_boundaries_half_open_and_null(spark):
    rows = [(dt.datetime(2025, 6, 1),), (dt.datetime(2025, 6, 1) - US,), (dt.datetime(2025, 8, 1),),
            (dt.datetime(2025, 8, 1) - US,), (None,)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz")
    got = [r.phase for r in with_phase(df, "ts", REFERENCE_CALENDAR).collect()]
    assert got == [CRISIS, PRE, RECOVERY, CRISIS, RECOVERY]


def test_phase_between_matches_phase_col(spark):
    cal = REFERENCE_CALENDAR
    rows = [(dt.datetime(2025, m, d),) for m in range(1, 11) for d in (1, 15)] + [(None,)]
    df = with_phase(spark.createDataFrame(rows, "ts timestamp_ntz"), "ts", cal)
    for name in cal.names:
        a = df.where(cal.between("ts", name)).count()
        b = df.where(F.col("phase") == name).count()
        assert a == b, name


def test_phase_filter_reaches_parquet_scan(spark, tmp_path):
    path = str(tmp_path / "o.parquet")
    spark.createDataFrame([(dt.datetime(2025, 1, 1),)], "ts timestamp_ntz").write.parquet(path)
    plan = spark.read.parquet(path).where(REFERENCE_CALENDAR.between("ts", CRISIS))._jdf \
        .queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "LessThan(ts" in plan


def _half_up(fr: Fraction, d: int) -> float:
    q = Decimal(fr.numerator) / Decimal(fr.denominator) if fr.denominator != 1 else Decimal(fr.numerator)
    exact = (Decimal(abs(fr.numerator)) * (10 ** d) * 2 + fr.denominator) // (2 * fr.denominator)
    return float((exact if fr >= 0 else -exact) / Decimal(10 ** d)) if q is not None else None


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(-10**9, 10**9), st.integers(1, 10**6)), min_size=1, max_size=20))
def test_ratio_is_exact_half_up(spark, pairs):
    df = spark.createDataFrame(pairs, "n long, d long")
    got = [r.x for r in df.select(ratio("n", "d", 2).alias("x")).collect()]
    want = [_half_up(Fraction(n, d), 2) for n, d in pairs]
    assert got == want


def test_ratio_ties_round_up_and_zero_den(spark):
    df = spark.createDataFrame([(1005, 1000), (2675, 1000), (-2675, 1000), (1, 0)], "n long, d long")
    got = [r.x for r in df.select(ratio("n", "d", 2).alias("x")).collect()]
    assert got == [1.01, 2.68, -2.68, None]
    assert df.select(pct(F.lit(1), F.lit(8)).alias("p")).first().p == 12.5
    assert df.select(decline_pct(F.lit(10), F.lit(0)).alias("p")).first().p == 100.0
    assert df.select(decline_pct(F.lit(0), F.lit(0)).alias("p")).first().p is None
    # monthly means: 10 over 5 months vs 1 over 2 months -> (2 - 0.5) / 2 = 75 %
    assert df.select(decline_pct(F.lit(10), F.lit(1), 5, 2).alias("p")).first().p == 75.0


def test_round_double_is_decimal_half_up(spark):
    df = spark.createDataFrame([(100.015,), (1.005,), (2.675,), (-0.125,)], "x double")
    assert [r.y for r in df.select(round_double("x").alias("y")).collect()] == [100.02, 1.01, 2.68, -0.13]


def test_ascii_words_matches_python_word_boundaries(spark):
    texts = ["late2 café bad_x cold, stale-late 5late it's", "Cold FOOD!! never again; naïve-late",
             "", "über_late late_ late", "café late"]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    got = [r.w for r in df.select(ascii_words("t").alias("w")).collect()]
    assert got[0] == ["cold", "stale", "late", "it", "s"]
    for text, words in zip(texts, got):
        assert words == re.findall(r"\b[a-z]+\b", text.lower()), text
    assert got[-1] is None


def test_parse_mixed_timestamps_dayfirst(spark):
    texts = ["2025-06-01 10:00", "01-06-2025 10:00", "13/06/2025", "06/13/2025", "2025-13-06",
             "1-6-2025 9:05", "2025-06-01 10:00:30", "junk", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.p for r in df.select(parse_mixed_ts("t").alias("p")).collect()]
    assert got == [dt.datetime(2025, 6, 1, 10), dt.datetime(2025, 6, 1, 10), dt.datetime(2025, 6, 13),
                   dt.datetime(2025, 6, 13), dt.datetime(2025, 6, 13), dt.datetime(2025, 6, 1, 9, 5),
                   dt.datetime(2025, 6, 1, 10, 0, 30), None, None]


def test_parse_mixed_timestamps_can_raise(spark):
    import pytest
    df = spark.createDataFrame([("junk",)], "t string")
    with pytest.raises(Exception, match="unparseable"):
        df.select(parse_mixed_ts("t", on_error="raise")).collect()


def test_money_rounding_matches_decimal_module():
    assert float(Decimal("0.125").quantize(Decimal("0.01"), ROUND_HALF_UP)) == 0.13


def test_phase_boundaries_do_not_depend_on_session_time_zone(spark):
    rows = [(dt.datetime(2025, 6, 1),), (dt.datetime(2025, 6, 1) - US,)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz")
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        for tz in ("UTC", "Asia/Kolkata", "America/Los_Angeles"):
            spark.conf.set("spark.sql.session.timeZone", tz)
            got = [r.phase for r in with_phase(df, "ts", REFERENCE_CALENDAR).collect()]
            assert got == [CRISIS, PRE], tz
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_null_phase_option_is_consistent_in_columns_and_sql(spark):
    from phaselens.functions.calendar import PhaseCalendar
    rows = [(dt.datetime(2025, 1, 1),), (dt.datetime(2025, 9, 1),), (None,)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz")
    df.createOrReplaceTempView("cal_probe")
    for null_phase, want in (("last", [PRE, RECOVERY, RECOVERY]), (None, [PRE, RECOVERY, None])):
        cal = PhaseCalendar([(p.name, p.start, p.end, p.months) for p in REFERENCE_CALENDAR.phases],
                            null_phase=null_phase)
        assert [r.ph for r in df.select(cal.phase_col("ts").alias("ph")).collect()] == want
        assert [r.ph for r in spark.sql(f"SELECT {cal.sql_case('ts')} AS ph FROM cal_probe").collect()] == want
        for name in cal.names:
            a = df.where(cal.between("ts", name)).count()
            b = spark.sql(f"SELECT * FROM cal_probe WHERE {cal.sql_between('ts', name)}").count()
            assert a == b == sum(1 for w in want if w == name), (null_phase, name)


def test_means_round_once_at_full_precision(spark):
    import pandas as pd

    from phaselens.functions.metrics import exact_mean
    for values, digits in (([0.125, 0.125, -0.004], 3), ([0.1234, 0.5678, -0.9999, 0.0001], 4), ([1.0, 2.0], 3)):
        df = spark.createDataFrame([(v,) for v in values], "v double")
        assert df.agg(exact_mean("v", digits).alias("m")).first()["m"] == round(pd.Series(values).mean(), digits)


def test_mixed_timestamps_in_further_shapes(spark):
    import datetime as dt

    import pytest
    from phaselens.functions.timeparse import parse_mixed_ts
    expected = {
        "2025-06-01T10:00:00": dt.datetime(2025, 6, 1, 10), "2025-06-01 10:00:00.250": dt.datetime(2025, 6, 1, 10, 0, 0, 250000),
        "01/06/2025 10:30 PM": dt.datetime(2025, 6, 1, 22, 30), "1 Jun 2025": dt.datetime(2025, 6, 1),
        "2025-06-01T10:00:00.123456": dt.datetime(2025, 6, 1, 10, 0, 0, 123456), "June 1, 2025": dt.datetime(2025, 6, 1),
        "01-06-2025 1:05:09 am": dt.datetime(2025, 6, 1, 1, 5, 9), "01 September 2025 12:00": dt.datetime(2025, 9, 1, 12),
        "2025/6/1 07:08": dt.datetime(2025, 6, 1, 7, 8), "13/06/2025": dt.datetime(2025, 6, 13),
    }
    df = spark.createDataFrame([(t,) for t in expected], "t string")
    assert {r["t"]: r["p"] for r in df.withColumn("p", parse_mixed_ts("t", on_error="raise")).collect()} == expected
    bad = spark.createDataFrame([("next Tuesday",)], "t string")
    assert bad.select(parse_mixed_ts("t")).first()[0] is None
    with pytest.raises(Exception, match="unparseable timestamp: next Tuesday"):
        bad.select(parse_mixed_ts("t", on_error="raise")).collect()


def _plain_date(text):
    """A plain reading of one text, field by field."""
    t = text.strip()
    if re.search("[A-Za-z]{3}", t):
        t = t.replace(",", "")
    m = re.fullmatch(r"(.+?)(?:(?<=\d)[ ](\d{1,2}):(\d\d)(?::(\d\d)(\.\d+)?)?(\s*[AaPp][Mm])?)?", re.sub(r"^(\d{4}-\d{1,2}-\d{1,2})T", r"\1 ", t))
    date, hour, minute, second, fraction, half = m.groups()
    if fraction and half:
        return None
    orders = []
    for rx, names in ((r"(\d{4})-(\d{1,2})-(\d{1,2})", ("ymd", "ydm")), (r"(\d{1,2})([-/])(\d{1,2})\2(\d{4})", ("d-my", "m-dy")),
                      (r"(\d{1,2})\.(\d{1,2})\.(\d{4})", ("dmy",)), (r"(\d{4})/(\d{1,2})/(\d{1,2})", ("ymd",)),
                      (r"(\d{1,2}) ([A-Za-z]{3,}) (\d{4})", ("dmy",)), (r"([A-Za-z]{3,}) (\d{1,2}) (\d{4})", ("mdy",))):
        if found := re.fullmatch(rx, date):
            orders = [dict(zip(o, found.groups())) for o in names]
    months = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
    for o in orders:
        try:
            month = int(o["m"]) if o["m"].isdigit() else months.index(o["m"][:3].lower()) + 1
            h = int(hour or 0)
            if half:
                if not 1 <= h <= 12:
                    return None
                h = h % 12 + 12 * (half.strip().lower() == "pm")
            return dt.datetime(int(o["y"]), month, int(o["d"]), h, int(minute or 0), int(second or 0), int(((fraction or ".0")[1:] + "00000")[:6]))
        except ValueError:
            continue
    return None


def test_mixed_timestamps_equal_a_plain_reading(spark):
    import random

    rnd = random.Random(8)
    texts = set()
    for _ in range(4000):
        y, m, d = rnd.choice(["2001", "2025"]), rnd.choice(["1", "06", "12", "13", "00", "Jun", "sept", "OCTOBER", "May", "Foo"]), rnd.choice(["1", "09", "28", "30", "31", "12"])
        sep = rnd.choice("-/. ")
        t = sep.join([[y, m, d], [d, m, y], [m, d, y]][rnd.randrange(3)])
        t = t.replace(" ", ", ", 1) if rnd.random() < 0.2 else t
        texts.add(t + rnd.choice(["", " 10:30", "T9:05:07", " 23:59:60", " 24:00", " 0:30 AM", " 12:30pm", " 1:5", " 13:00 PM", " 10:00:00.25",
                                  " 10:00:00.1234567", " 12:00:00AM", "  10:30", " 3:04 xm", " 10:61"]))
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r["t"]: r["p"] for r in df.select("t", parse_mixed_ts("t").alias("p")).collect()}
    assert {t: p for t, p in got.items() if p != _plain_date(t)} == {}
    assert sum(p is not None for p in got.values()) > 300
