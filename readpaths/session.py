"""SparkSession helpers.

The library never builds its own cluster configuration: jobs take the
caller's ``SparkSession``.  ``get_spark`` exists for tests, the bench and
local runs, and only fills in settings that are still unset.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on.  Bounds of the time range are UTC
# instants, so the session time zone must be UTC as well.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def get_spark(master: str | None = None, app_name: str = "readpaths",
              shuffle_partitions: int | None = None) -> SparkSession:
    """Return the active session, or a local one for tests and the bench."""
    active = SparkSession.getActiveSession()
    if active is not None:
        ensure_conf(active)
        return active
    builder = (
        SparkSession.builder.appName(app_name)
        .master(master or os.environ.get("SPARK_MASTER", "local[8]"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or 8))
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
    )
    for key, value in REQUIRED_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_conf(spark)
    return spark


def ensure_conf(spark: SparkSession) -> None:
    """Set the required settings on an existing session."""
    for key, value in REQUIRED_CONF.items():
        spark.conf.set(key, value)


def checkpoint_dir(spark: SparkSession, sub: str | None = None) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    A session that names none may have set it on its context (local runs and
    tests do); otherwise this raises, as no other folder is known to be
    shared.  Returns a fresh sub-folder when ``sub`` is given.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    base = base.rstrip("/")
    return base if sub is None else f"{base}/{sub}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back.

    What several branches of a plan use is then computed once, a lost
    executor costs nothing, and a join sees a plain scan on that side, so a
    skewed partition of the other side can be split.
    """
    path = checkpoint_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(df: DataFrame) -> None:
    """Remove a table that ``stored`` returned, once nothing reads it any more."""
    spark = df.sparkSession
    files = df.inputFiles()
    if files:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(files[0])).getParent()
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def scale_conf(input_bytes: int, partition_bytes: int = 256 * 1024 ** 2,
               max_partitions: int = 100_000) -> dict[str, str]:
    """Settings sized for an input of ``input_bytes`` (a starting point for a cluster).

    Initial shuffle partitions are sized so that a partition holds about
    ``partition_bytes`` of the input; AQE then coalesces small ones and
    splits skewed ones, so the number only needs to be large enough for
    the biggest stage.  File splits use the same target size.
    """
    parts = max(200, min(max_partitions, -(-int(input_bytes) // int(partition_bytes))))
    size = str(int(partition_bytes))
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.files.maxPartitionBytes": size,
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": size,
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": size,
        "spark.sql.session.timeZone": "UTC",
    }
