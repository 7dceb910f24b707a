"""All links between texts by the Jaccard similarity of their word shingles.

The set of a text is that of its shingles' 64-bit hashes. Two sets of similarity ``t`` or more
share one of the first ``n - ceil(t n) + 1`` elements of each, in any order that is the same for all
sets (prefix filter). Shingles common to many texts come last in the order, so few texts meet
that are not similar. Counts of common shingles only choose the order, never what is linked.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from ..session import remove
from .common import folder, saved

#: Most common shingles that all tasks hold.
MOST = 1 << 20
#: Shingles counted at a time.
_HELD = 1 << 20
#: Texts of one key from which they are compared with its ends first.
MANY = 8
#: Slack of the filters, so that rounding never excludes a pair; the last comparison has none.
_SLACK = 1e-6
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Odd multipliers of a shingle's words.
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def shingle_set(text: str) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles of five words; of a shorter text one, of one without words none."""
    words = text.encode().translate(_LOWER).split()
    if len(words) <= len(_MIX):
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words))] if words else [], np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(w) - len(_MIX) + 1
    h = w[:n] * _MIX[0]
    for i in range(1, len(_MIX)):
        h += w[i : i + n] * _MIX[i]
    h ^= h >> np.uint64(32)
    return np.unique(h * _MIX[0])


def _sets(batches):
    """``(node, set)`` of each row ``(node, text)``."""
    for batch in batches:
        for node, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            yield node, shingle_set(text)


def _repeats(batches):
    """Shingles that several sets of a stretch of the rows have, with their number there."""
    held, size = [], 0

    def counted():
        h, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(h[n > 1].view(np.int64)), pa.array(n[n > 1])], names=["h", "n"])

    for _, h in _sets(batches):
        held.append(h)
        size += len(h)
        if size >= _HELD:
            yield counted()
            held, size = [], 0
    if held:
        yield counted()


def common_shingles(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """At most ``MOST`` common shingles, sorted, and their counts."""
    found = saved(texts.mapInArrow(_repeats, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "common-shingles")
    size = F.floor(F.log2("n"))
    least, room = None, MOST
    for row in sorted(found.groupBy(size.alias("size")).count().collect(), reverse=True):
        room -= row["count"]
        if room < 0:
            break
        least = row["size"]
    table = found.filter(size >= least if least is not None else F.lit(False)).toArrow()
    h, n = table["h"].to_numpy().view(np.uint64), table["n"].to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def prefix(h: np.ndarray, similarity: float, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first elements of a set, of which a similar one has one among its own first."""
    size = len(h) - int(np.ceil(similarity * len(h) - _SLACK)) + 1 if len(h) else 0
    if len(common):
        at = np.minimum(np.searchsorted(common, h), len(common) - 1)
        h = h[np.argsort(np.where(common[at] == h, counts[at], 0), kind="stable")]
    return h[:size]


def _needed(similarity: float) -> Column:
    """Common elements that similar sets of sizes ``n`` and ``n2`` have at least."""
    return (F.col("n") + F.col("n2")) * (similarity / (1 + similarity)) - _SLACK


def _across(met: DataFrame) -> DataFrame:
    """The rows of keys in which several classes meet."""
    keys = saved(met.groupBy("h").agg(F.min("class").alias("a"), F.max("class").alias("b")).filter("a < b").select("h"), "similar-keys")
    return saved(met.join(keys.hint("merge"), "h"), "similar-met")


def class_links(texts: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """``u, v``: links between ``classes (node, class)`` of ``texts (node, text)`` that join all similar ones.

    Equal nodes are one text. Texts of one class count as linked. Where many texts share a key, each
    is first compared with the key's smallest and largest class, and what these links join is
    one class in the second pass. There all texts of one key and different classes meet, and a pair
    leaves if even with all elements behind its first ones in common it could not be similar.
    Both passes compare whole sets. The joins are of written tables and can split a hot key. Those with keys
    or sets are merge joins: in memory these are many times their files, by which Spark sizes a broadcast.
    """
    shared = texts.sparkSession.sparkContext.broadcast(common_shingles(texts))

    def keys(batches):
        columns, rows = ([], [], [], []), 0
        for node, h in _sets(batches):
            first = prefix(h, similarity, *shared.value)
            for column, values in zip(columns, (first.view(np.int64), np.full(len(first), node), np.full(len(first), len(h), np.int32), np.arange(len(first), dtype=np.int32)), strict=True):
                column.append(values)
            rows += len(first)
            if rows >= 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], names=["h", "node", "n", "at"])
                columns, rows = ([], [], [], []), 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], names=["h", "node", "n", "at"])

    def arrays(batches):
        for batch in batches:
            sets = [h.view(np.int64) for _, h in _sets([batch])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "set"])

    spark, path = texts.sparkSession, folder(texts.sparkSession, "similar-prefixes")
    texts.mapInArrow(keys, "h long, node long, n int, at int").write.parquet(path)
    keyed = spark.read.schema("h long, node long, n int, at int").parquet(path).withColumn("short", F.hash("h"))
    # most keys have one text; those go by a short hash, whose chance meetings go below
    again = saved(keyed.groupBy("short").count().filter("count > 1").select("short"), "similar-short")
    met = saved(keyed.join(again.hint("merge"), "short").drop("short").distinct(), "similar-met")
    remove(spark, path)
    met = _across(saved(met.join(classes, "node"), "similar-met"))

    def linked(pairs: DataFrame) -> DataFrame:
        pairs = saved(pairs.select("node", "class", "node2", "class2"), "similar-pairs")
        nodes = saved(pairs.select(F.explode(F.array("node", "node2")).alias("node")).distinct(), "similar-nodes")
        wanted = texts.join(nodes, "node", "left_semi").select("node", "text")
        sets = saved(wanted.mapInArrow(arrays, "node long, set array<long>").dropDuplicates(["node"]), "similar-sets")
        both = pairs.join(sets.toDF("node", "a").hint("merge"), "node").join(sets.toDF("node2", "b").hint("merge"), "node2")
        both = both.withColumn("common", F.size(F.array_intersect("a", "b")))
        similar = both.filter(F.col("common") / (F.size("a") + F.size("b") - F.col("common")) >= similarity)
        return saved(similar.select(F.col("class").alias("u"), F.col("class2").alias("v")).distinct(), "similar-links")

    needed, fields = _needed(similarity), ("class", "node", "n", "at")
    row = F.struct(*fields)
    ends = saved(met.groupBy("h").agg(F.count("*").alias("texts"), F.array(F.min(row), F.max(row)).alias("ends")).filter(F.col("texts") > MANY).select("h", "ends"), "similar-ends")
    stars = met.join(ends, "h").select(*met.columns, F.explode("ends").alias("e")).select(*met.columns, *[F.col(f"e.{c}").alias(f"{c}2") for c in fields])
    # at the first common element of similar sets, what follows in both is enough
    first = linked(stars.filter((F.col("class") != F.col("class2")) & (F.least(F.col("n") - F.col("at"), F.col("n2") - F.col("at2")) >= needed)).dropDuplicates(["node", "node2"]))
    joined = saved(components(first), "similar-classes").select(F.col("node").alias("class"), "component")
    met = met.join(joined, "class", "left").select("h", "node", "n", F.coalesce("component", "class").alias("class"))
    met = _across(saved(met, "similar-met"))
    shared_first = met.join(met.toDF("h", "node2", "n2", "class2"), "h").filter(
        (F.col("class") < F.col("class2")) & (F.least("n", "n2") >= F.greatest("n", "n2") * similarity - _SLACK)
    ).groupBy("node", "class", "n", "node2", "class2", "n2").agg(F.count("*").alias("common"))
    behind = F.ceil(F.greatest("n", "n2") * similarity - _SLACK) - 1
    second = linked(shared_first.filter(F.col("common") + behind >= needed))
    return first.unionByName(second)
