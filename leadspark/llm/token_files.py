"""Token ids in ORC files.

One row per document, in ascending doc_id order over all files: ORC writes the ids as
run-length encoded integers in stripes, keeps a row index and a Bloom filter of doc_id per
row group, and so lets readers take stripes in parallel and skip those without a wanted id.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from .common import text_or_empty
from .tokens import encoder

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("block", T.LongType()), T.StructField("block_start", T.LongType()),
    T.StructField("n", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType(), False)),
])
ORC_OPTIONS = {
    "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true",
    "orc.row.index.stride": "2000", "orc.stripe.size": str(32 << 20), "compression": "zstd",
}


def _encode(tokenizer: str, end_id: int):
    end = end_id.to_bytes(4, "little")

    def task(batches):
        encode, block, before = encoder(tokenizer).encode, TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for at in range(0, len(texts), 500):
                parts = [encode(t) + end for t in texts[at : at + 500]]
                sizes = np.fromiter((len(p) // 4 for p in parts), np.int64, len(parts))
                offsets = np.concatenate(([0], np.cumsum(sizes)))
                ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(parts), np.int32)))
                n = len(parts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[at : at + n], pa.array(np.full(n, block, np.int64)), pa.array(before + offsets[:-1]), pa.array(sizes), ids],
                    names=SCHEMA.names,
                )
                before += int(offsets[-1])

    return task


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Write ``doc_id, block, block_start, n, ids`` as ORC files under ``path``.

    Rows go out by doc_id (nulls first; equal ids by text hash), dealt by ranges and sorted
    within each; ``block`` numbers the files in that order ``block_start`` counts the ids
    before a document in its file and ``n`` its own. A null text is empty: its ids are ``end_id`` alone.
    Repeated rows are all written; an empty table gives a readable folder without rows. Other
    columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    # ranges also cut among rows of one doc_id; equal rows may go either way
    keys = rows.withColumns({"h": F.xxhash64("text"), "m": F.monotonically_increasing_id()})
    ordered = keys.repartitionByRange("doc_id", "h", "m").sortWithinPartitions("doc_id", "h", "m").select("doc_id", "text")
    writer = ordered.mapInArrow(_encode(tokenizer, end_id), SCHEMA).write
    writer.options(**ORC_OPTIONS).orc(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """The documents in the files; filters on ``doc_id`` reach the stripes' indexes and Bloom filters."""
    return spark.read.schema(SCHEMA).orc(path)


def with_starts(rows: DataFrame) -> DataFrame:
    """Add ``start``: the ids of all documents before, by the files' totals of ``n`` and the place in the file; the ids are not read."""
    blocks = rows.groupBy("block").agg(F.sum("n").alias("total"))
    # a row per file
    before = blocks.select("block", F.coalesce(F.sum("total").over(W.Window.orderBy("block").rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return rows.join(before, "block").withColumn("start", F.col("before") + F.col("block_start")).drop("before")


@F.arrow_udf(T.StructType([T.StructField("n", T.LongType()), T.StructField("crc", T.LongType())]))
def _digest(ids: pa.Array) -> pa.Array:
    values, offsets = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False), ids.offsets.to_numpy()
    raw = memoryview(np.ascontiguousarray(values)).cast("B")
    crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    return pa.StructArray.from_arrays([pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())], names=["n", "crc"])


def digests(rows: DataFrame) -> DataFrame:
    """Per document ``n_tokens`` and ``ids_crc32``, from the ids themselves."""
    return rows.withColumn("d", _digest("ids")).select("*", F.col("d.n").alias("n_tokens"), F.col("d.crc").alias("ids_crc32")).drop("d", "ids")
