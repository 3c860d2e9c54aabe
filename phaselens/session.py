"""SparkSession construction and shared-storage settings."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every phaselens job relies on. AQE re-plans joins and coalesces
# shuffle partitions at runtime; skew-join splits hot keys.
_DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.sql.ansi.enabled": "true",
}


def get_session(master: str = "local[*]", shuffle_partitions: int = 8,
                app_name: str = "phaselens", extra: dict | None = None) -> SparkSession:
    """Local/test session. On a cluster, use the cluster's own session and
    call :func:`ensure_checkpoint_dir` instead."""
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(_DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf["spark.driver.memory"] = os.environ.get("PHASELENS_DRIVER_MEMORY", "8g")
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint directory of the session.

    A cluster names a shared folder in ``spark.checkpoint.dir``; we read it
    and never override it. Where it is unset, only a local master gets a fresh
    scratch folder (removed when the process ends); on a cluster this raises,
    as each executor would write to its own disk."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not configured:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="phaselens-ckpt-")
        atexit.register(shutil.rmtree, configured, ignore_errors=True)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def _tables_folder(spark: SparkSession) -> str:
    return os.path.join(ensure_checkpoint_dir(spark), "phaselens")


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once as Parquet under the session's shared checkpoint
    folder and read it back: later passes read a columnar table (pruned,
    pushed down) instead of recomputing ``df``, lineage is cut, and the
    files outlive the executors that wrote them. Unlike
    ``Dataset.checkpoint`` this computes ``df`` only once. The folder is the
    session's; :func:`release` deletes it when its tables are used up."""
    path = os.path.join(_tables_folder(df.sparkSession), f"{name}-{uuid.uuid4().hex}")
    df.write.mode("error").parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._materialized_path = path
    return table


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables that :func:`materialize` returned, once what was computed
    from them is written itself."""
    for t in tables:
        _delete(t.sparkSession, t._materialized_path)


def release(spark: SparkSession) -> None:
    """Delete every table that :func:`materialize` wrote in this session.
    DataFrames that still read one can't be computed afterwards."""
    _delete(spark, _tables_folder(spark))
