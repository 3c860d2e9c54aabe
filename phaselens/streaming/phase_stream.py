"""Incremental phase x month order trend with Structured Streaming.

The same aggregation as ``s01_monthly_orders`` / ``s02_phase_revenue``,
maintained as new order files land instead of recomputed from scratch.
The grouping key (month, phase) has at most months x phases values, so
the streaming state stays tiny whatever the order volume; partial
aggregation happens before the state-store shuffle as in batch.

Sink: ``foreachBatch`` writes the complete aggregate of each micro-batch to
a folder of its own, ``batch_id=<n>`` (idempotent: a batch replayed after a
failure writes the same rows to the same place), so readers never find the
table half replaced; :func:`read_trend` reads the latest finished one and
older ones are dropped. The checkpoint lives under the session's shared
``spark.checkpoint.dir``, so a restarted query resumes where it stopped.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from phaselens.functions.calendar import PhaseCalendar
from phaselens.functions.metrics import ratio, scaled_sum, yn_flag
from phaselens.session import ensure_checkpoint_dir


def order_stream(spark: SparkSession, path: str, schema: str, max_files_per_trigger: int = 64) -> DataFrame:
    """Parquet files under ``path`` (a folder or glob) as a stream, with a
    declared schema (streams never infer)."""
    return (spark.readStream.schema(schema)
            .option("maxFilesPerTrigger", max_files_per_trigger)
            .parquet(path))


def phase_month_trend(orders: DataFrame, calendar: PhaseCalendar, ts: str = "order_timestamp",
                      cancelled: str = "is_cancelled", amount: str = "total_amount") -> DataFrame:
    """Streaming (or batch) aggregate: month, phase, orders, kept orders and
    their exact revenue."""
    kept = ~yn_flag(cancelled)
    return (orders.groupBy(F.date_format(ts, "yyyy-MM").alias("order_month"),
                           calendar.phase_col(ts).alias("business_phase"))
            .agg(F.count(F.lit(1)).alias("total_orders"),
                 F.count_if(kept).alias("kept_orders"),
                 scaled_sum(F.when(kept, F.col(amount))).alias("_kept_cents"))
            .withColumn("kept_revenue", ratio(F.col("_kept_cents"), F.lit(100)))
            .drop("_kept_cents"))


def _finished(spark: SparkSession, out_path: str) -> list[int]:
    """Batch numbers whose write has ended, ascending."""
    jvm = spark.sparkContext._jvm
    pattern = jvm.org.apache.hadoop.fs.Path(os.path.join(out_path, "batch_id=*", "_SUCCESS"))
    found = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern)
    return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found or [])


def write_trend(batch: DataFrame, out_path: str, batch_id: int, keep: int = 2) -> None:
    """Write one batch's table; the ``keep`` latest finished ones stay."""
    spark = batch.sparkSession
    batch.write.mode("overwrite").parquet(os.path.join(out_path, f"batch_id={batch_id}"))
    for old in _finished(spark, out_path)[:-keep]:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(os.path.join(out_path, f"batch_id={old}"))
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def read_trend(spark: SparkSession, out_path: str) -> DataFrame:
    """The latest finished table."""
    return spark.read.parquet(os.path.join(out_path, f"batch_id={_finished(spark, out_path)[-1]}"))


def start_trend_query(trend: DataFrame, out_path: str, name: str = "phase_month_trend",
                      checkpoint: str | None = None, trigger_seconds: int | None = None) -> StreamingQuery:
    """Run ``trend`` in complete mode; every micro-batch writes the full,
    current table to a folder of its own under ``out_path``."""
    spark = trend.sparkSession
    ckpt = checkpoint or os.path.join(ensure_checkpoint_dir(spark), "streams", name)

    def write(batch: DataFrame, batch_id: int) -> None:
        write_trend(batch, out_path, batch_id)

    writer = (trend.writeStream.outputMode("complete").queryName(name)
              .option("checkpointLocation", ckpt).foreachBatch(write))
    if trigger_seconds:
        writer = writer.trigger(processingTime=f"{trigger_seconds} seconds")
    return writer.start()


def driver_order_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver's orders as a stream, shaped like ``fact_orders``."""
    from phaselens.sources.readers import DRIVER_SCHEMAS
    raw = order_stream(spark, os.path.join(sf_dir, "orders*.parquet"), DRIVER_SCHEMAS["orders"])
    return raw.select(F.col("o_orderkey").alias("order_id"),
                      F.col("o_custkey").alias("customer_id"),
                      F.col("o_orderdate").alias("order_timestamp"),
                      F.col("o_totalprice").cast("decimal(18,2)").alias("total_amount"),
                      F.when(F.col("o_orderstatus") == "P", "Y").otherwise("N").alias("is_cancelled"))
