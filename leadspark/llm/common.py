"""Small helpers of the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir, tune

#: Rows in one Arrow batch; texts can be long, so batches stay small.
ARROW_ROWS = 2000


def ready(spark: SparkSession) -> SparkSession:
    """The session with the library's options and small Arrow batches."""
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def folder(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder of the cluster."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def saved(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends here, lost executors cost nothing."""
    path = folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def lower_ascii(column: Column) -> Column:
    """A-Z lower-cased, all other characters as they are."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def matching(docs: DataFrame, keys: DataFrame, marks: bool = False) -> DataFrame:
    """The rows of ``docs`` whose doc_id and ``xxhash64`` of the text are in ``keys (k_id, k_hash)``.

    With ``marks`` the two key columns stay, named by ``fresh(docs, "k_id", "k_hash")``.
    """
    a, b = fresh(docs, "k_id", "k_hash")
    marked = docs.withColumns({a: F.col("doc_id").cast("long"), b: F.xxhash64(text_or_empty())}).alias("l")
    found = marked.join(keys.select("k_id", "k_hash").toDF(a, b).alias("r"), F.col(f"l.{a}").eqNullSafe(F.col(f"r.{a}")) & (F.col(f"l.{b}") == F.col(f"r.{b}")), "left_semi")
    return found if marks else found.drop(a, b)
