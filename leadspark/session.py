"""Session settings the library relies on; all are plain Spark SQL options."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

RUNTIME_OPTIONS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split hot keys even when a later step could have reused the partitioning
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_OPTIONS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a private one only on one machine where none is set."""
    context = spark.sparkContext
    current = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get(
        "spark.checkpoint.dir", None
    )
    if context.getCheckpointDir() is None:
        if not current and not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(current or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return current or context.getCheckpointDir()


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder and read back, for what several later steps read."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate data through the file system that Spark wrote it with."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def rename(spark: SparkSession, old: str, new: str) -> None:
    """Move a file or folder within the file system that Spark writes to; the new one's parent is made."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    system = path(old).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(path(new).getParent())
    if not system.rename(path(old), path(new)):
        raise OSError(f"cannot move {old} to {new}")


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, in order; none if there is no such folder."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in system.listStatus(p)) if system.exists(p) else []
