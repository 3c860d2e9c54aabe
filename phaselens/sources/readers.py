"""Table sources: reference-format CSV files and the driver's Parquet tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from phaselens.sources.quoted_csv import read_quoted_csv
from phaselens.sources.schemas import REFERENCE_TABLES

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
                 "events", "documents", "embeddings", "pages", "benchmark", "labels",
                 "conversations")

#: Reference tables whose texts hold line breaks.
QUOTED_LINE_BREAKS = ("fact_ratings",)

# Declared schemas of the driver tables this library reads: a declared
# schema skips the footer-reading job that schema inference launches.
DRIVER_SCHEMAS = {
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": ("o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
               "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING"),
    "lineitem": ("l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
                 "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, "
                 "l_linestatus STRING, l_shipdate TIMESTAMP_NTZ"),
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
}


def read_parquet_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reader = spark.read
    if name in DRIVER_SCHEMAS:
        reader = reader.schema(DRIVER_SCHEMAS[name])
    return reader.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def read_reference_csv(spark: SparkSession, base_path: str, tables=None) -> dict[str, DataFrame]:
    """The reference's eight CSV files with their declared schemas.

    Timestamps are parsed as TIMESTAMP_NTZ by the schema; the mixed-format
    ``review_timestamp`` stays text and goes through ``parse_mixed_ts``. Review
    texts hold line breaks; their file is cut by its quotes
    (:mod:`phaselens.sources.quoted_csv`), so it is read by many tasks too."""
    options = {"mode": "FAILFAST", "escape": '"',  # a quote inside a field is doubled
               "timestampNTZFormat": "yyyy-MM-dd[ HH:mm[:ss[.SSSSSS]]]"}
    out = {}
    for name, (fname, schema) in REFERENCE_TABLES.items():
        if tables and name not in tables:
            continue
        path = os.path.join(base_path, fname)
        if name in QUOTED_LINE_BREAKS:
            out[name] = read_quoted_csv(spark, path, schema, options)
        else:
            out[name] = spark.read.schema(schema).options(header=True, **options).csv(path)
    return out


def register_views(tables: dict[str, DataFrame]) -> None:
    """Expose a dict of DataFrames as temp views (SQL namespace)."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
