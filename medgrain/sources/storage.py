"""Small file-system helpers that work on any Hadoop file system."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import SparkSession

from medgrain.session import checkpoint_root


def _status(spark: SparkSession, path: str) -> list:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return list(system.globStatus(target) or [])


def exists(spark: SparkSession, path: str) -> bool:
    return bool(_status(spark, path))


def signature(spark: SparkSession, path: str) -> str:
    """``size:mtime`` of a file."""
    found = _status(spark, path)[0]
    return f"{found.getLen()}:{found.getModificationTime()}"


def first_existing(spark: SparkSession, candidates: Sequence[str]) -> str | None:
    return next((c for c in candidates if exists(spark, c)), None)


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _system(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> None:
    _system(spark, path).delete(_path(spark, path), True)


def children(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Names and modification times of what lies in a folder; an absent one is empty."""
    return [(s.getPath().getName(), s.getModificationTime()) for s in _status(spark, f"{path.rstrip('/')}/*")]


def read_text(spark: SparkSession, path: str) -> str:
    jvm = spark.sparkContext._jvm
    stream = _system(spark, path).open(_path(spark, path))
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file beside ``path``, then rename it over ``path`` in one step."""
    jvm = spark.sparkContext._jvm
    beside = f"{path}.{uuid.uuid4().hex}"
    stream = _system(spark, path).create(_path(spark, beside), True)
    stream.write(bytearray(text.encode()))
    stream.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        _path(spark, path).toUri() if "://" in path or path.startswith("file:") else _system(spark, path).getUri(),
        spark.sparkContext._jsc.hadoopConfiguration())
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    context.rename(_path(spark, beside), _path(spark, path), how)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder on the shared storage."""
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
