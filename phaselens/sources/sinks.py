"""Result sinks."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame

from phaselens.sources.schemas import REFERENCE_TABLES


def write_result(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None,
                 fmt: str = "parquet") -> None:
    """Persist a query result (columnar by default). Partitioning by a
    low-cardinality column such as ``month`` lets later reads prune files."""
    writer = df.write.mode(mode).format(fmt)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def save_table(df: DataFrame, name: str, mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    """Persist as a catalog table (``CREATE TABLE ... USING parquet``)."""
    writer = df.write.mode(mode).format("parquet")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.saveAsTable(name)


def write_reference_csv(tables: dict[str, DataFrame], folder: str) -> None:
    """Tables under their reference names as CSV with a header, in the declared
    column order: what ``read_reference_csv`` reads. A quote inside a field is
    doubled, and texts keep their blanks and line breaks."""
    for name, df in tables.items():
        file, schema = REFERENCE_TABLES[name]
        (df.select(*schema.fieldNames()).write.mode("overwrite")
         .options(header=True, escape='"', timestampNTZFormat="yyyy-MM-dd HH:mm:ss", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
         .csv(os.path.join(folder, file)))
