"""Session settings the library relies on, and where it cuts lineage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# AQE picks broadcast joins from measured sizes and splits skewed join partitions; the last
# setting keeps a fact that is partitioned by order_id in place for (order_id, product_id) joins.
RUNTIME_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.session.timeZone": "UTC",
}

# What one task holds: shuffles start with so many partitions, which AQE merges up to a size; a scan takes files in splits of a size.
# Values a session has set itself stay.
TASK_SETTINGS = {
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "1000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    "spark.sql.files.maxPartitionBytes": "32m",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session and return it."""
    unset = {key: value for key, value in TASK_SETTINGS.items() if spark.conf.get(key, None) is None}
    for key, value in {**RUNTIME_SETTINGS, **unset}.items():
        spark.conf.set(key, value)
    return spark


@contextmanager
def sorted_groups(spark: SparkSession) -> Iterator[None]:
    """Inside, a write sums groups that collect values in sorted order, one group at a time.

    Spark's hashing of such groups gives up after 128 of them in a task and sorts all rows with their sums; rows that joins have sorted
    by the key already need neither.
    """
    name = "spark.sql.execution.useObjectHashAggregateExec"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


@contextmanager
def released_shuffles(spark: SparkSession) -> Iterator[None]:
    """Inside, each write or collect removes its shuffle files when it ends: what is staged no longer needs them.

    Otherwise they lie on the executors' disks until the driver's garbage collection notices.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or the session's checkpoint folder.

    Where neither is set, a folder of the default file system is used and deleted when the session's JVM ends;
    that is refused if the file system is local and the executors are not.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    jvm, conf = context._jvm, context._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(f"/tmp/checkpoints/{context.applicationId}")
    system = path.getFileSystem(conf)
    path = system.makeQualified(path)
    local = context.master == "local" or context.master.startswith("local[")
    if path.toUri().getScheme() == "file" and not local:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    system.mkdirs(path)
    system.deleteOnExit(path)
    return path.toString()


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: computed once, columns still prunable."""
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)
