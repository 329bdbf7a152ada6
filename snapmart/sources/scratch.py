"""Intermediate tables in the folder all executors share.

A table that several jobs read is written once and read back: the lineage ends
there, so a lost executor costs a re-read and not the joins before it.

Such a table has to outlive the frame that reads it, which Spark evaluates later. Who
consumes a result knows when that is: tables made inside ``leased`` are dropped when it
ends. What several results share is made inside ``kept`` and stays.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="snapmart-")


#: Paths given out under the open leases, innermost last; None while they are suspended.
_LEASES: list[list[str] | None] = []


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/snapmart-{name}-{uuid.uuid4().hex}"
    if _LEASES and _LEASES[-1] is not None:
        _LEASES[-1].append(path)
    return path


@contextmanager
def leased(spark: SparkSession) -> Iterator[None]:
    """Drop every table made inside once the block ends, that is, once its result is consumed."""
    _LEASES.append([])
    try:
        yield
    finally:
        for path in _LEASES.pop() or []:
            drop(spark, path)


@contextmanager
def kept() -> Iterator[None]:
    """Tables made inside belong to no lease."""
    _LEASES.append(None)
    try:
        yield
    finally:
        _LEASES.pop()


def drop(spark: SparkSession, path: str) -> None:
    """Delete a table, on whatever file system it is."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write once, read back."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
