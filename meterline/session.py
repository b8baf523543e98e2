"""Session construction and cluster-safe helpers shared by every job."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Session settings every job relies on: UTC wall clock (ledger and OTLP
# times are UTC), AQE for runtime coalescing and skew-join splitting.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str = "local[*]", partitions: int = 8,
                  app: str = "meterline", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app)
    conf = dict(BASE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(partitions)
    conf["spark.ui.enabled"] = "false"
    if master.startswith("local"):
        conf.setdefault("spark.driver.memory", "16g")
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_utc(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def _context(spark: SparkSession):
    """The classic SparkContext, or None on a session without one."""
    try:
        return spark.sparkContext
    except Exception:  # e.g. a Spark Connect session
        return None


def app_id(spark: SparkSession) -> str:
    sc = _context(spark)
    return sc.applicationId if sc is not None else spark.conf.get("spark.app.id", "meterline")


def parallelism(spark: SparkSession) -> int:
    sc = _context(spark)
    if sc is not None:
        return sc.defaultParallelism
    return int(spark.conf.get("spark.sql.shuffle.partitions", "8"))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster.

    ``spark.checkpoint.dir`` is read from the session (or the context's
    checkpoint directory). When neither is set a local master gets a private
    temporary folder; on a cluster that is an error, since executors do not
    share such a folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    sc = _context(spark)
    if not configured and sc is not None:
        current = sc._jsc.sc().getCheckpointDir()
        configured = current.get() if current.isDefined() else None
    if not configured:
        if sc is None or not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="meterline-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    if sc is not None:
        sc.setCheckpointDir(configured)
    return configured


def move(spark: SparkSession, source: str, target: str) -> None:
    """Renames a folder on the file system that Spark writes to; the target's
    parent is made, whether or not there is a source."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path
    src, dst = path(source), path(target)
    fs = src.getFileSystem(sc._jsc.hadoopConfiguration())
    fs.mkdirs(dst.getParent())
    if fs.exists(src) and not fs.rename(src, dst):
        raise OSError(f"{source} was not renamed to {target}")


def bounded_broadcast(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """Broadcast a dimension side only after proving its size.

    Counting a dimension table is cheap; when it is larger than ``max_rows``
    the plain DataFrame is returned and Spark falls back to a shuffle join
    (AQE may still convert it at runtime if the actual size is small).
    """
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
