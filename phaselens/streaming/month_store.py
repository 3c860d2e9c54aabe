"""Incremental month aggregates: a partitioned table of additive figures per
month, phase and city, kept up to date as order files come, change and go.

Layout of the store's folder::

    parts/<version>/order_month=2025-06/...   figures of a month
    manifests/<version>/files/                the input files that are counted
    manifests/<version>/months/               the version that holds each month

An update lists the input files (a Spark job over their names, sizes and
times), compares them with the latest manifest and reads only what that asks
for. New files alone are read alone and added to their months' figures; months
that a changed or removed file took part in are counted again, from the files
known to hold them and the new ones. Only affected months are written, in a
folder of the new version; the manifest is written under a temporary name and
published by one rename. A reader that opened the version before still finds
its months, as the parts of the last two versions stay; an update that dies
leaves no trace that a reader sees, and the next one does its work again.

The figures of a changed dimension table are not followed: rebuild the store
(``update(..., again=True)``)."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phaselens.functions.calendar import PhaseCalendar
from phaselens.functions.metrics import pct, ratio, scaled_sum

KEYS = ("order_month", "business_phase", "known_customer", "city")
FIGURES = ("total_orders", "cancelled_orders", "kept_orders", "kept_cents", "kept_amounts")
_PART = "order_month string, business_phase string, known_customer boolean, city string, " + ", ".join(f"{f} long" for f in FIGURES)
_FILES = "file string, bytes long, changed timestamp, order_month string"
NO_MONTH = "none"  # orders without a time


class MonthStore:
    """``orders``: a function from Parquet file paths to a DataFrame with
    order_id, customer_id, order_timestamp, total_amount, is_cancelled and
    ``file`` (see :func:`order_files`). ``customers``: customer_id, city."""

    def __init__(self, spark: SparkSession, folder: str, calendar: PhaseCalendar, customers: DataFrame,
                 orders: Callable[[list[str]], DataFrame]):
        self.spark, self.folder, self.calendar, self.customers, self.orders = spark, folder, calendar, customers, orders

    # -- the store's folder ----------------------------------------------
    def _path(self, *names: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(os.path.join(self.folder, *names))
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def versions(self) -> list[int]:
        """Published versions, ascending."""
        fs, path = self._path("manifests")
        found = fs.listStatus(path) if fs.exists(path) else []
        return sorted(int(f.getPath().getName()) for f in found if f.getPath().getName().isdigit())

    def _manifest(self, version: int | None, name: str, schema: str) -> DataFrame:
        if version is None:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(os.path.join(self.folder, "manifests", str(version), name))

    def _months(self, version: int | None) -> dict[str, int]:
        """Month -> version that holds it: a row a month."""
        return {r["order_month"]: r["part"] for r in self._manifest(version, "months", "order_month string, part int").collect()}

    # -- figures -----------------------------------------------------------
    def _figures(self, orders: DataFrame, *also: str) -> DataFrame:
        month = F.coalesce(F.date_format("order_timestamp", "yyyy-MM"), F.lit(NO_MONTH))
        known = self.customers.select("customer_id", "city").withColumn("known_customer", F.lit(True))
        kept = F.col("is_cancelled") == "N"
        return (orders.withColumn("order_month", month).withColumn("business_phase", self.calendar.phase_col("order_timestamp"))
                .join(known, "customer_id", "left").withColumn("known_customer", F.coalesce("known_customer", F.lit(False)))
                .groupBy(*also, *KEYS).agg(
                    F.count("order_id").alias("total_orders"), F.count_if(F.col("is_cancelled") == "Y").cast("long").alias("cancelled_orders"),
                    F.count(F.when(kept, F.col("order_id"))).alias("kept_orders"),
                    F.coalesce(scaled_sum(F.when(kept, F.col("total_amount"))), F.lit(0)).cast("long").alias("kept_cents"),
                    F.count(F.when(kept, F.col("total_amount"))).alias("kept_amounts")))

    @staticmethod
    def _added(frames: list[DataFrame]) -> DataFrame:
        rows = reduce(lambda a, b: a.unionByName(b), [f.select(*KEYS, *FIGURES) for f in frames])
        return rows.groupBy(*KEYS).agg(*[F.sum(f).alias(f) for f in FIGURES])

    def _read(self, months: dict[str, int]) -> DataFrame:
        frames = [self.spark.createDataFrame([], _PART)]
        for part in sorted(set(months.values())):
            base = os.path.join(self.folder, "parts", str(part))
            own = [os.path.join(base, f"order_month={m}") for m, v in sorted(months.items()) if v == part]
            frames.append(self.spark.read.schema(_PART).option("basePath", base).parquet(*own))
        return reduce(lambda a, b: a.unionByName(b), frames)

    def table(self) -> DataFrame:
        """The figures of the latest version."""
        versions = self.versions()
        return self._read(self._months(versions[-1] if versions else None))

    # -- updates -----------------------------------------------------------
    def update(self, files: DataFrame, again: bool = False) -> list[str]:
        """Bring the store up to the input ``files`` (file, bytes, changed;
        see :func:`order_files`). Returns the months that were written."""
        versions = self.versions()
        last = versions[-1] if versions and not again else None
        known = self._manifest(last, "files", _FILES)
        one = known.select("file", "bytes", "changed").distinct()
        same = ["file", "bytes", "changed"]
        new = [r["file"] for r in files.join(one, same, "left_anti").select("file").distinct().collect()]
        gone = one.join(files, same, "left_anti").select("file", "bytes", "changed")
        recount = {r["order_month"] for r in known.join(gone, same, "left_semi").select("order_month").distinct().collect()}
        if not new and not recount and last is not None:
            return []
        months, version = self._months(last), (versions[-1] if versions else 0) + 1
        still = known.join(gone, same, "left_anti")
        frames, fresh_months = [], self.spark.createDataFrame([], "file string, order_month string")
        if new:
            fresh = self._figures(self.orders(new), "file").persist()
            fresh_months = fresh.select("file", "order_month").distinct()
            frames.append(fresh)
        affected = recount | {r["order_month"] for r in fresh_months.select("order_month").distinct().collect()}
        frames.append(self._read({m: v for m, v in months.items() if m in affected - recount}))
        if recount:
            old = [r["file"] for r in still.where(F.col("order_month").isin(*recount)).select("file").distinct().collect()]
            if old:
                frames.append(self._figures(self.orders(old)).where(F.col("order_month").isin(*recount)))
        out = os.path.join(self.folder, "parts", str(version))
        (self._added(frames).repartition("order_month").write.mode("overwrite").partitionBy("order_month").parquet(out))
        fs, path = self._path("parts", str(version))
        written = sorted(f.getPath().getName().partition("=")[2] for f in fs.listStatus(path) if "=" in f.getPath().getName())
        counted = still.unionByName(fresh_months.join(files, "file").select(*same, "order_month"))
        self._publish(version, counted, {m: v for m, v in months.items() if m not in affected} | {m: version for m in written})
        if new:
            fresh.unpersist()
        return written

    def _publish(self, version: int, counted: DataFrame, months: dict[str, int]) -> None:
        draft = os.path.join("manifests", f"draft-{uuid.uuid4().hex}")
        counted.write.parquet(os.path.join(self.folder, draft, "files"))
        rows = self.spark.createDataFrame(sorted(months.items()), "order_month string, part int")
        rows.coalesce(1).write.parquet(os.path.join(self.folder, draft, "months"))
        fs, path = self._path(draft)
        _, final = self._path("manifests", str(version))
        if not fs.rename(path, final):
            raise OSError(f"version {version} was published by someone else")
        kept = self.versions()[-2:]
        needed = {str(v) for k in kept for v in self._months(k).values()}
        for name, keep in (("manifests", {str(k) for k in kept}), ("parts", needed)):
            fs, path = self._path(name)
            for f in fs.listStatus(path):
                if f.getPath().getName() not in keep:
                    fs.delete(f.getPath(), True)

    # -- queries ------------------------------------------------------------
    def monthly_orders(self) -> DataFrame:
        """As ``s01_monthly_orders``."""
        month = F.when(F.col("order_month") != NO_MONTH, F.col("order_month"))
        return (self.table().groupBy(month.alias("order_month"), "business_phase").agg(F.sum("total_orders").alias("total_orders"))
                .orderBy("order_month", "business_phase"))

    def phase_revenue(self) -> DataFrame:
        """As ``s02_phase_revenue``."""
        per = self.table().groupBy("business_phase").agg(*[F.sum(f).alias(f) for f in ("kept_orders", "kept_cents", "kept_amounts")])
        cents = F.col("kept_cents")
        return (per.where("kept_orders > 0 or kept_amounts > 0")
                .select("business_phase", F.col("kept_orders").alias("total_orders"), ratio(cents, F.lit(100)).alias("total_revenue"),
                        ratio(cents, F.lit(100 * 10_000_000)).alias("revenue_in_crores"),
                        ratio(cents, F.col("kept_amounts") * 100).alias("avg_order_value"))
                .orderBy(self.calendar.ordinal_col("business_phase")))

    def city_cancellations(self) -> DataFrame:
        """As ``s03_city_phase_cancel``."""
        return (self.table().where("known_customer").groupBy("city", "business_phase")
                .agg(F.sum("total_orders").alias("total_orders"), F.sum("cancelled_orders").alias("cancelled_orders"))
                .withColumn("cancellation_rate_pct", pct(F.col("cancelled_orders"), F.col("total_orders")))
                .orderBy(F.desc("cancellation_rate_pct"), "city", "business_phase"))


def order_files(spark: SparkSession, path: str) -> DataFrame:
    """file, bytes, changed of the Parquet files under ``path``; no content is
    read."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path)
            .select(F.col("path").alias("file"), F.col("length").alias("bytes"), F.col("modificationTime").alias("changed")))
