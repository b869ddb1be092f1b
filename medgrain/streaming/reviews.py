"""Review log to latest snapshot as a stateful stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medgrain.operators.skew import first_per_key
from medgrain.sources.artifacts import current_version, read_artifact, write_artifact
from medgrain.sources.storage import children

BUCKETS, COMPACT_AFTER = 64, 16
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def append_changes(log: DataFrame, keys: Sequence[str], order: Sequence[str], out: str, checkpoint: str,
                   first_batch: int = 0) -> None:
    """Keep the latest entry per key in state and append the changed keys of each batch to the change log.

    ``order`` lists the ascending version columns. State lies in RocksDB, so its size is not bound by the executors'
    heap. The log has one folder per batch, overwritten on replay; a stream with a checkpoint of its own numbers its
    batches from ``first_batch``.
    """
    spark = log.sparkSession
    rest = [c for c in log.columns if c not in keys]
    latest = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    changes = latest.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={first_batch + batch_id}")

    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        query = (
            changes.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start()
        )
        query.awaitTermination()
    finally:
        spark.conf.set(STATE_STORE, before) if before else spark.conf.unset(STATE_STORE)


def latest_stream(log: DataFrame, keys: Sequence[str], order: Sequence[str], out: str, checkpoint: str,
                  compact_after: int = COMPACT_AFTER) -> DataFrame:
    """The latest entry per key of a streaming ``log``. Once ``compact_after`` batches of changes wait, they are merged
    into a new version of the snapshot."""
    append_changes(log, keys, order, out, checkpoint)
    if len(waiting(log.sparkSession, out)) >= compact_after:
        compact(log.sparkSession, out, keys)
    return latest_snapshot(log.sparkSession, out, keys)


def _snapshot(spark: SparkSession, out: str) -> DataFrame | None:
    """Rows of the current snapshot, with the batch each came from; nothing before the first compaction."""
    path = f"{out.rstrip('/')}/_snapshot"
    return read_artifact(spark, path) if current_version(spark, path) else None


def waiting(spark: SparkSession, out: str) -> list[int]:
    """Batches of the change log that no snapshot holds yet."""
    held = _snapshot(spark, out)
    last = -1 if held is None else held.agg(F.max("batch_id")).first()[0]
    found = [int(name.partition("=")[2]) for name, _ in children(spark, out) if name.startswith("batch_id=")]
    return sorted(b for b in found if last is None or b > last)


def _tail(spark: SparkSession, out: str, keys: Sequence[str]) -> DataFrame | None:
    """The newest waiting change per key; only the folders of waiting batches are read."""
    batches = waiting(spark, out)
    if not batches:
        return None
    changes = spark.read.option("basePath", out).parquet(*[f"{out.rstrip('/')}/batch_id={b}" for b in batches])
    return first_per_key(changes, keys, ["-batch_id"]).withColumn("batch_id", F.col("batch_id").cast("bigint"))


def _merged(held: DataFrame | None, tail: DataFrame | None, keys: Sequence[str]) -> DataFrame:
    """Changed keys from the tail, all others as they are: the snapshot itself is never grouped again."""
    if held is None or tail is None:
        return tail if held is None else held
    changed = tail.select(*[F.col(k).alias(f"_c_{k}") for k in keys])
    on = [F.col(k).eqNullSafe(F.col(f"_c_{k}")) for k in keys]
    return held.join(changed, on, "left_anti").select(*tail.columns).unionByName(tail)


def compact(spark: SparkSession, out: str, keys: Sequence[str], buckets: int = BUCKETS) -> None:
    """Merge the waiting batches into a new snapshot version, dealt by a hash of the key; the pointer moves at the end,
    so readers see the version before or this one."""
    tail = _tail(spark, out, keys)
    if tail is not None:
        merged = _merged(_snapshot(spark, out), tail, keys)
        write_artifact(merged.repartition(buckets, *keys), f"{out.rstrip('/')}/_snapshot")


def latest_snapshot(spark: SparkSession, out: str, keys: Sequence[str]) -> DataFrame:
    """The newest change per key: the snapshot, with the batches since laid over it."""
    return _merged(_snapshot(spark, out), _tail(spark, out, keys), keys).drop("batch_id")
