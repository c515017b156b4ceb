"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below ``spark.checkpoint.dir`` (the caller must have set it)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{base.rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


#: Bytes of rows that Spark hands to a Python worker at once; its own default is sixteen times as many.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Keep the batches of this session small, so that a worker's memory does not follow the length of texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def give_back() -> None:
    """Return freed memory of this worker to the system: what workers of earlier steps hold back adds up otherwise."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # only where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


_RECORDS: list[list[str]] = []


@contextlib.contextmanager
def recorded() -> Iterator[list[str]]:
    """The paths of all tables that ``stored`` writes meanwhile, for ``delete`` once their readers are done."""
    paths: list[str] = []
    _RECORDS.append(paths)
    try:
        yield paths
    finally:
        _RECORDS.remove(paths)


def delete(spark: SparkSession, paths: Iterable[str]) -> None:
    """Remove tables, by the file system that Spark reads them with."""
    for path in map(spark.sparkContext._jvm.org.apache.hadoop.fs.Path, paths):
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back.

    Cuts the lineage with files that outlive any executor, and gives later
    joins a plain scan on that side, so that a skewed partition can be split.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    for paths in _RECORDS:
        paths.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
