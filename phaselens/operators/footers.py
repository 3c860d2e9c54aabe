"""Row and null counts of Parquet tables from their footers.

A Parquet footer holds the rows of each row group and, where the writer kept
statistics, the nulls of each column. Spark's file source can answer ``COUNT``
from them without reading a page; that is asked for in a session of its own,
so no setting of the caller's session changes. Columns whose footers lack the
counts (or whose type has none) are counted by a scan, those columns only."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

_SETTINGS = {"spark.sql.sources.useV1SourceList": "", "spark.sql.parquet.aggregatePushdown": "true"}


def footer_session(spark: SparkSession) -> SparkSession:
    """A session of the same application that counts from footers."""
    own = spark.newSession()
    for k, v in _SETTINGS.items():
        own.conf.set(k, v)
    return own


def counts_from_footers(own: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """One row: ``rows`` and, per column, its non-null values; fails if run
    over files without the statistics."""
    df = own.read.parquet(path)
    return df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(columns)])


def reads_footers_only(df: DataFrame) -> bool:
    """Whether a plan's scans are answered by footers."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "PushedAggregation: [COUNT" in plan


def _footer_counts(own: SparkSession, path: str, columns: list[str]) -> tuple[int | None, dict[str, int]]:
    """(rows, non-null values of the columns whose footers hold them): all at
    once, else in halves, so that one bare column costs a few small jobs."""
    try:
        found = counts_from_footers(own, path, columns)
        if reads_footers_only(found):
            row = found.first()
            return row["rows"] or 0, {c: row[f"n{i}"] or 0 for i, c in enumerate(columns)}  # null without row groups
    except (PySparkException, Py4JJavaError) as e:
        if "Number of nulls not set" not in str(e):
            raise
    if len(columns) < 2:
        return None, {}
    half = len(columns) // 2
    parts = [_footer_counts(own, path, c) for c in (columns[:half], columns[half:])]
    return next((n for n, _ in parts if n is not None), None), parts[0][1] | parts[1][1]


def profile_files(spark: SparkSession, tables: dict[str, str]) -> DataFrame:
    """table_name, column_name, data_type, rows, null_count, non_null,
    from_footer of the Parquet tables at the given paths. The counts are made
    when this is called: a few values per column."""
    own, out = footer_session(spark), []
    for table, path in tables.items():
        df = spark.read.parquet(path)
        flat = [f.name for f in df.schema if not isinstance(f.dataType, (ArrayType, MapType, StructType))]
        rows, known = _footer_counts(own, path, flat) if flat else (None, {})
        left = [c for c in df.columns if c not in known]
        scanned = {}
        if left or rows is None:
            row = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(left)]).first()
            rows, scanned = row["rows"], {c: row[f"n{i}"] for i, c in enumerate(left)}
        for c, kind in df.dtypes:
            filled = known.get(c, scanned.get(c))
            out.append((table, c, kind, rows, rows - filled, filled, c in known))
    return spark.createDataFrame(out, "table_name string, column_name string, data_type string, rows long, null_count long, "
                                      "non_null long, from_footer boolean")
