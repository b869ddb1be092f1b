"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import os
import sys
import types
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from medgrain.sources.storage import delete, scratch

#: Words of every contract: runs of anything but the space and the five control characters after the tab.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def folder(spark: SparkSession, name: str) -> str:
    """A new path on the shared storage, deleted when the driver's JVM ends."""
    path = scratch(spark, name)
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet on the shared storage and read back: a cut that outlives lost executors."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished jobs: Spark deletes them when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class Cuts:
    """Stored cuts of one computation, each deleted when its last reader is done."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = folder(self.spark, name)
        df.write.parquet(path)
        self.paths.setdefault(name, []).append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def bucketed(self, df: DataFrame, name: str, key: str, compression: str) -> DataFrame:
        """``df`` in buckets of ``key``: joins on it need no further shuffle of these rows."""
        path = folder(self.spark, name)
        self.paths.setdefault(name, []).append(path)
        return bucketed(df, name, key, compression, path)

    def drop(self, *names: str, but_last: bool = False) -> None:
        for name in names:
            held = self.paths.get(name, [])
            for path in held[:len(held) - but_last]:
                delete(self.spark, path)
            self.paths[name] = held[len(held) - but_last:]

    def clear(self) -> None:
        self.drop(*self.paths)
        release(self.spark)


def bucketed(df: DataFrame, name: str, key: str, compression: str, path: str | None = None) -> DataFrame:
    """``df`` written in as many buckets of ``key`` as shuffles have partitions. The catalog holds its name only until
    the frame is bound to the files."""
    spark, named = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    (df.write.format("parquet").option("path", path or folder(spark, name)).option("compression", compression)
     .bucketBy(partitions(spark), key).saveAsTable(named))
    out = spark.table(named)
    spark.sql(f"DROP TABLE {named}")
    return out


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id``, ``text`` (null: empty) and the columns in ``more``; anything else a table carries is left out."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *more)


def fold(doc_id: Column) -> Column:
    """crc32 of the decimal form of an id, mod 5; fold 0 is held out from training."""
    return F.crc32(doc_id.cast("string")) % 5


def give_back() -> None:
    """Return this process's freed memory to the system: a reused Python worker holds on to it between tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def kept_by_worker(name: str, make: Callable[[], object]) -> object:
    """A value that this Python worker keeps for its later tasks; a new worker makes its own."""
    home = sys.modules.setdefault("_medgrain_worker", types.ModuleType("_medgrain_worker"))
    if not hasattr(home, name):
        setattr(home, name, make())
    return getattr(home, name)


def map_columns(df: DataFrame, fn: Callable[[Iterator[dict]], Iterator[tuple]], kind: str | T.StructType,
                as_is: tuple[str, ...] = ()) -> DataFrame:
    """``mapInArrow`` over column lists: ``fn`` takes dicts of Python lists and yields tuples of lists or arrays.

    ``kind`` is the result's schema. Columns in ``as_is`` stay arrays, for those that only pass through. Lists keep nulls and 64-bit integers as they are, which pandas would turn into
    floats.
    """
    schema = T.StructType.fromDDL(kind) if isinstance(kind, str) else kind
    kinds = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = ({n: b.column(i) if n in as_is else b.column(i).to_pylist() for i, n in enumerate(b.schema.names)}
                   for b in batches)
        for out in fn(columns):
            arrays = [c if isinstance(c, pa.Array) else pa.array(c, type=k.type) for c, k in zip(out, kinds)]
            yield pa.RecordBatch.from_arrays(arrays, names=kinds.names)
        give_back()

    return df.mapInArrow(run, schema)


@contextmanager
def small_batches(spark: SparkSession, most: str = "8m") -> Iterator[None]:
    """Jobs started inside send Arrow batches of at most ``most`` bytes (or one row) to Python: for wide rows."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, most)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def tokenizer_file(name: str) -> str:
    """Path of a public vocabulary file."""
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))


def ordered(df: DataFrame, order: list[str], sums: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``_index``, its row's place in the global ``order``, and ``_before_<c>``, the sum of ``c`` over all
    earlier rows, for each long column ``c`` of ``sums``.

    One range-partitioned sort; places and sums inside a partition are counted as its rows stream by, stored, and
    raised by the totals of the partitions before it. The table of those totals has a row for each partition.
    """
    counted = [("_index", None), *[(f"_before_{c}", c) for c in sums]]
    schema = T.StructType([*df.schema.fields, T.StructField("_part", T.IntegerType()),
                           *[T.StructField(n, T.LongType()) for n, _ in counted]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = dict.fromkeys([n for n, _ in counted], 0)
        for b in batches:
            arrays = list(b.columns)
            for name, column in counted:
                values = (np.ones(b.num_rows, np.int64) if column is None
                          else b.column(b.schema.get_field_index(column)).to_numpy())
                ends = total[name] + np.cumsum(values)
                arrays.append(pa.array(ends - values))
                total[name] = int(ends[-1]) if len(ends) else total[name]
            yield pa.RecordBatch.from_arrays(arrays, names=[*b.schema.names, *[n for n, _ in counted]])

    placed = df.repartitionByRange(*[F.col(c).asc() for c in order]).sortWithinPartitions(*order)
    rows = stored(placed.withColumn("_part", F.spark_partition_id()).mapInArrow(run, schema), "ordered")
    totals = rows.groupBy("_part").agg(
        F.count("*").alias("_n"), *[F.sum(c).alias(f"_n_{c}") for c in sums])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("_part", *[
        F.coalesce(F.sum("_n" if c is None else f"_n_{c}").over(before), F.lit(0)).alias(f"_base{n}")
        for n, c in counted])
    joined = rows.join(F.broadcast(bases), "_part")
    return joined.select(*df.columns, *[(F.col(n) + F.col(f"_base{n}")).alias(n) for n, _ in counted])
