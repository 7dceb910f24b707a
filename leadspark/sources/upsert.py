"""Tables in hash buckets that are replaced bucket by bucket.

A table lies in ``<path>/bucket=<k>``, its log in ``<path>-log``; a row's bucket is a hash of its key. An upsert reads and
rewrites only the buckets that its keys fall in, by dynamic partition overwrite, so its cost
follows the rows that come, not the table. The new buckets are staged first: the staged
folder is a redo log. If a run dies after staging, the next call publishes it; if it dies before,
the table is as it was. A commit marker for each batch makes a repeated batch do nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import children, remove

BUCKETS = 64


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*(F.col(k).cast("string") for k in keys)), F.lit(buckets)).cast("int")


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _exists(spark: SparkSession, path: str) -> bool:
    p = _path(spark, path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _mark(spark: SparkSession, path: str) -> None:
    p = _path(spark, path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True).close()


def create(rows: DataFrame, path: str, keys: list[str], buckets: int = BUCKETS) -> None:
    """A new table with the rows; their number of buckets stays."""
    spark = rows.sparkSession
    rows.withColumn("bucket", bucket_of(keys, buckets)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
    _mark(spark, f"{path}-log/layout/buckets={buckets}")


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _buckets(spark: SparkSession, path: str) -> int:
    return int(children(spark, f"{path}-log/layout")[0].split("=")[1])


def _publish(spark: SparkSession, path: str, batch: str) -> None:
    staged = spark.read.parquet(f"{path}-log/staged/{batch}")
    staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    _mark(spark, f"{path}-log/commits/{batch}")
    remove(spark, f"{path}-log/staged/{batch}")


def recover(spark: SparkSession, path: str) -> list[str]:
    """Publish what was staged whole but not committed; drop what was not staged whole."""
    done = []
    for batch in children(spark, f"{path}-log/staged"):
        if _exists(spark, f"{path}-log/staged/{batch}/_SUCCESS") and not _exists(spark, f"{path}-log/commits/{batch}"):
            _publish(spark, path, batch)
            done.append(batch)
        else:
            remove(spark, f"{path}-log/staged/{batch}")
    return done


def upsert(rows: DataFrame, path: str, keys: list[str], batch: str, replace_all: bool = True, publish: bool = True) -> bool:
    """Rows of ``batch`` replace the table's rows of the same keys; ``False`` if the batch was committed before.

    With ``replace_all`` all rows of a key that comes are replaced by all rows that come for it; else
    the key's columns stay unless a row brings a value (nulls change nothing). Null keys equal
    each other. Batches are applied one at a time by one writer.
    """
    spark = rows.sparkSession
    recover(spark, path)
    if _exists(spark, f"{path}-log/commits/{batch}"):
        return False
    table, buckets = read(spark, path), _buckets(spark, path)
    columns = [c for c in table.columns if c != "bucket"]
    placed = rows.withColumn("bucket", bucket_of(keys, buckets))
    # at most ``buckets`` numbers
    touched = [r.bucket for r in placed.select("bucket").distinct().collect()]
    if touched:
        old = table.filter(F.col("bucket").isin(touched)).alias("o")
        new = placed.alias("n")
        same = F.col("o.bucket") == F.col("n.bucket")
        for k in keys:
            same &= F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}"))
        if replace_all:
            rest = old.join(new.select("bucket", *keys).distinct().alias("n"), same, "left_anti")
            merged = rest.unionByName(placed, allowMissingColumns=True).select(*columns, "bucket")
        else:
            brought = set(rows.columns)
            value = lambda c: F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")) if c in brought else F.col(f"o.{c}")
            merged = old.join(new, same, "full").select(*(value(c).alias(c) for c in columns), F.coalesce("o.bucket", "n.bucket").alias("bucket"))
        merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}-log/staged/{batch}")
        if not publish:
            return True
        _publish(spark, path, batch)
    else:
        _mark(spark, f"{path}-log/commits/{batch}")
    return True
