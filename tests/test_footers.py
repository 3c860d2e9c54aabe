"""Profiles from Parquet footers against scans."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from phaselens.operators.footers import counts_from_footers, footer_session, profile_files, reads_footers_only
from phaselens.operators.profile import profile_groups, table_groups

SF = "/root/testdata/sf0.001"
TABLES = ("customer", "orders", "lineitem", "documents", "events", "embeddings")


def _scan(spark, tables):
    frames = {n: spark.read.parquet(p) for n, p in tables.items()}
    return sorted(map(tuple, profile_groups(table_groups(frames)).select(
        "table_name", "column_name", "data_type", "rows", "null_count", "non_null").collect()))


def test_driver_tables(spark):
    tables = {t: f"{SF}/{t}.parquet" for t in TABLES}
    got = profile_files(spark, tables).collect()
    assert sorted(tuple(r)[:6] for r in got) == _scan(spark, tables)
    by_footer = {(r["table_name"], r["column_name"]) for r in got if r["from_footer"]}
    assert ("documents", "text") in by_footer and ("embeddings", "embedding") not in by_footer
    assert len(by_footer) >= len(got) - 2


@pytest.mark.parametrize("bare", [[], ["b"], ["a", "c"], ["a", "b", "c", "d e"]])
def test_columns_without_statistics_are_scanned(spark, tmp_path, bare):
    table = pa.table({"a": [1, None, 3] * 50, "b": ["x", None, None] * 50, "c": [None] * 149 + [1.5], "d e": [True, False, None] * 50})
    keep = [c for c in table.column_names if c not in bare]
    pq.write_table(table, tmp_path / "one.parquet", row_group_size=40, write_statistics=keep or False)
    pq.write_table(table.slice(0, 7), tmp_path / "two.parquet")
    got = profile_files(spark, {"t": str(tmp_path)}).collect()
    assert sorted(tuple(r)[:6] for r in got) == _scan(spark, {"t": str(tmp_path)})
    assert {r["column_name"] for r in got if r["from_footer"]} == set(keep)


def test_the_plan_reads_no_page_and_settings_stay(spark):
    old = spark.conf.get("spark.sql.sources.useV1SourceList")
    own = footer_session(spark)
    assert reads_footers_only(counts_from_footers(own, f"{SF}/orders.parquet", ["o_orderkey", "o_orderstatus"]))
    assert spark.conf.get("spark.sql.sources.useV1SourceList") == old
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"
    plain = spark.read.parquet(f"{SF}/orders.parquet").groupBy().count()
    assert not reads_footers_only(plain)


def test_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "a int, b string").write.parquet(str(tmp_path / "t"))
    got = profile_files(spark, {"t": str(tmp_path / "t")}).collect()
    assert sorted(tuple(r)[:6] for r in got) == [("t", "a", "int", 0, 0, 0), ("t", "b", "string", 0, 0, 0)]
