"""CSV files whose quoted fields hold line breaks, read by many tasks.

Spark's ``multiLine`` reader gives a whole file to one task, since a task that
starts in the middle of a file can't know whether it starts inside a quoted
field. Here files are cut like any text file, and what a range starts with
follows from the quotes before it:

1. every range of a file counts its *turns*, the lines with an odd number of
   quotes: each opens or closes a field that goes on in the next line (a
   doubled quote inside a field adds two);
2. a running sum over the ranges of a file, one row a range, gives the turns
   before each; an odd number means that the range starts inside a field;
3. each task walks its ranges in order. A line outside a field with an even
   number of quotes is a record and goes on as it is. Other lines are pieces of
   the record that the turns before them number (n // 2, in whichever range
   they stand); only pieces are shuffled, to be joined in file order.

A record is then parsed by ``from_csv`` with the declared schema. Line breaks
inside fields come out as one ``\\n`` each.

Input cases: blank lines between records are skipped; an empty or header-only
file gives no row; a file that ends inside a field gives its last record as far
as it goes. Quotes must stand as RFC 4180 has them: a lone quote in a field
without quotes would be counted."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_LINES = "file string, start long, line long, record long, value string"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of the files, with the file and the first byte of the range
    that a task reads them in."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def turns_before(lines: DataFrame) -> DataFrame:
    """file, start, before: the lines with an odd number of quotes in the
    ranges of a file before the one that starts at ``start``."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    per_range = lines.groupBy("file", "start").agg(F.sum(quotes % 2).alias("turns"))
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    return per_range.select("file", "start", F.coalesce(F.sum("turns").over(earlier), F.lit(0)).alias("before"))


def _cut(header: bool):
    """Lines to records (``record`` null) and pieces of records."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, turns, number = None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            start = batch.column(1).to_numpy()
            names = batch.column(0).dictionary_encode()
            code = names.indices.to_numpy()
            cuts = [0, *(np.flatnonzero((start[1:] != start[:-1]) | (code[1:] != code[:-1])) + 1).tolist(), len(start)]
            value = batch.column(2)
            odd = pc.count_substring(value, '"').to_numpy() % 2
            before, line = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
            for a, b in zip(cuts, cuts[1:]):
                here = (names.dictionary[int(code[a])].as_py(), int(start[a]))
                if here != last:  # another range
                    last, turns, number = here, batch.column(3)[a].as_py(), 0
                run_ = np.cumsum(odd[a:b])
                before[a:b] = turns + run_ - odd[a:b]
                line[a:b] = number + np.arange(b - a)
                turns, number = turns + int(run_[-1]), number + b - a
            whole = (before % 2 == 0) & (odd == 0)
            keep = np.ones(len(start), bool)
            if header:
                keep &= ~((start == 0) & (line == 0))
            out = pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(line), pa.array(before // 2, mask=whole),
                 pc.replace_substring_regex(value, "\r$", "")], ["file", "start", "line", "record", "value"])
            yield out.filter(pa.array(keep))

    return run


def read_records(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """One column ``value``: the records of the CSV files at ``path``, each
    with its line breaks."""
    lines = _lines(spark, path)
    # one row a range, as many as tasks that read the files
    ranges = F.broadcast(turns_before(lines))
    cut = lines.join(ranges, ["file", "start"]).select("file", "start", "value", "before").mapInArrow(_cut(header), _LINES)
    pieces = (cut.where("record is not null").groupBy("file", "record")
              .agg(F.sort_array(F.collect_list(F.struct("start", "line", "value"))).alias("pieces"))
              .select(F.array_join(F.transform("pieces", lambda p: p["value"]), "\n").alias("value")))
    return cut.where("record is null and trim(value) <> ''").select("value").unionByName(pieces)


def read_quoted_csv(spark: SparkSession, path: str, schema: StructType, options: dict[str, str], header: bool = True) -> DataFrame:
    """The table in the CSV files at ``path`` (a file, folder or pattern)."""
    parsed = F.from_csv("value", ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema), options)
    return read_records(spark, path, header).select(parsed.alias("r")).select("r.*")
