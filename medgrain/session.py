"""Session settings and the durable-cut helper shared by the operators."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
}


def build_session(app: str = "medgrain", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the library's settings; ``extra`` uses ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def even_partitions(spark: SparkSession) -> None:
    """Let the session merge shuffle partitions up to the library's size and no further; a smaller size of the caller's stays.

    A task may sort and group the same rows several times over, which takes up to fifty times their shuffled bytes, so
    this size, not the input's, decides how much memory a task needs.
    """
    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    in_bytes = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    if in_bytes(spark.conf.get(name)) > in_bytes(DEFAULTS[name]):
        spark.conf.set(name, DEFAULTS[name])


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for durable intermediate data.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master may fall
    back to a temporary folder, because there every task runs on this machine.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        named = tempfile.mkdtemp(prefix="medgrain-")
    context.setCheckpointDir(named)
    return context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` onto the shared folder, so a lost executor costs nothing."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let go of the plans, broadcasts and shuffle files of finished jobs: Spark deletes them when the driver collects its
    garbage, which a small plan may not bring about for a long time."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as compressed Parquet in the shared folder and read back, for a wide frame with several readers."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
