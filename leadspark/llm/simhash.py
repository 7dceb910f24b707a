"""SimHash near-duplicates found by Golay-code keys.

A 64-bit fingerprint is three segments of 22, 21 and 21 bits. With four or fewer differing
bits at most one segment differs in three or more, so two segments differ in two or fewer.
Padded to 23 bits, a segment and its one-bit neighbours are decoded by the perfect Golay
code (23, 12); two segments at distance two or less have a common neighbour, so they share
a codeword index. The indices of every pair of segments are the keys of a fingerprint.

Two settings share this. The plain one (``similarity=None``) has shingles of four words and
links at four bits, which the keys never miss. With a similarity, shingles have five words and
a fingerprint has 128 bits: the first 64 give the same keys, all 128 are compared, and two
texts link at as many differing bits as that similarity gives on average and a standard
deviation more, so that most pairs of just that similarity are within it. There a pair is
found if two of its three segments agree but for about two bits (see README for the recall).
"""

from __future__ import annotations

from functools import cache, reduce
from itertools import combinations
from math import acos, pi, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.components import components
from .common import saved, text_or_empty
from .exact_dedup import one_of_each
from .similar_sets import class_links

SHINGLE = 4
SEED = 42
#: Fingerprints link at this many differing bits or fewer; the keys are made for four.
LINK_BITS = 4
#: Shingle size and fingerprint bits where texts link by similarity.
SIMILAR_SHINGLE, SIMILAR_BITS = 5, 128
#: Generator polynomial of the Golay code (23, 12).
_GENERATOR = 0b101011100011
#: (first bit, bits) of the segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_LANES = np.arange(16, dtype=np.int64) * 256


def link_bits(similarity: float) -> int:
    """Differing bits of ``SIMILAR_BITS`` that two sets of this Jaccard similarity have on average, and a standard deviation."""
    share = acos(2 * similarity / (1 + similarity)) / pi
    return int(SIMILAR_BITS * share + sqrt(SIMILAR_BITS * share * (1 - share)))


def fingerprint(text: str, shingle: int = SHINGLE, digest=xxhash.xxh64_digest) -> int:
    """Unsigned SimHash of a text's word shingles, repeats included, with the bits of ``digest``."""
    words = text.encode().translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = digest(joined, SEED)
    else:
        edges = np.zeros(len(words) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1, out=edges[1:])
        hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip(edges[:-shingle].tolist(), (edges[shingle:] - 1).tolist(), strict=True)])
    width = len(digest(b""))
    lanes = np.frombuffer(hashes, np.uint8).reshape(-1, width)
    counts = np.bincount((lanes + _LANES[:width]).ravel(), minlength=width * 256).reshape(width, 256) @ _BITS
    return int.from_bytes(np.packbits(2 * counts.ravel() > len(lanes)).tobytes(), "big")


@F.arrow_udf(T.LongType())
def fingerprints(texts: pa.Array) -> pa.Array:
    return pa.array(np.array([fingerprint(t) for t in texts.to_pylist()], np.uint64).view(np.int64))


def similar_fingerprint(text: str) -> int:
    """Unsigned 128-bit SimHash of a text's shingles of five words."""
    return fingerprint(text, SIMILAR_SHINGLE, xxhash.xxh3_128_digest)


_TWO = T.StructType([T.StructField("fp", T.LongType()), T.StructField("fp_b", T.LongType())])


@F.arrow_udf(_TWO)
def similar_fingerprints(texts: pa.Array) -> pa.Array:
    found = b"".join(similar_fingerprint(t).to_bytes(16, "big") for t in texts.to_pylist())
    halves = np.frombuffer(found, ">i8").astype(np.int64).reshape(-1, 2)
    return pa.StructArray.from_arrays([pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy())], names=["fp", "fp_b"])


def _remainder(word: int) -> int:
    for bit in range(22, 10, -1):
        if word >> bit & 1:
            word ^= _GENERATOR << (bit - 11)
    return word


@cache
def golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the upper and lower word halves; per syndrome, the changes of the index and their number."""
    syndrome = np.array([_remainder(1 << i) for i in range(23)])
    spread = lambda bits, base: np.array([np.bitwise_xor.reduce(syndrome[[base + i for i in range(bits) if v >> i & 1]], initial=0) for v in range(1 << bits)])
    error = np.zeros(2048, np.int64)
    for weight in (1, 2, 3):
        for places in combinations(range(23), weight):
            error[np.bitwise_xor.reduce(syndrome[list(places)])] = sum(1 << i for i in places)
    flips = [0] + [1 << i for i in range(23)]
    own = [0, *syndrome.tolist()]
    changes = [sorted({(w ^ int(error[s ^ o])) >> 11 for w, o in zip(flips, own, strict=True)}) for s in range(2048)]
    width = max(map(len, changes))
    table = np.array([c + c[:1] * (width - len(c)) for c in changes])
    return spread(12, 11), spread(11, 0), table, np.array(list(map(len, changes)))


def segment_indices(fp: np.ndarray, first: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Codeword indices near a segment of each fingerprint (padded), and how many there are."""
    upper, lower, table, number = golay_tables()
    word = (((fp >> np.uint64(first)) & np.uint64((1 << bits) - 1)) << np.uint64(23 - bits)).astype(np.int64)
    s = upper[word >> 11] ^ lower[word & 2047]
    return (word >> 11)[:, None] ^ table[s], number[s]


def golay_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(place in fp, key)`` pairs; fingerprints within ``LINK_BITS`` bits share a key."""
    rows, keys = [], []
    near = [segment_indices(fp, *s) for s in SEGMENTS]
    for number, (a, b) in enumerate(combinations(range(3), 2)):
        (left, left_n), (right, right_n) = near[a], near[b]
        i, j = np.arange(left.shape[1]), np.arange(right.shape[1])
        valid = (i[None, :, None] < left_n[:, None, None]) & (j[None, None, :] < right_n[:, None, None])
        key = (number << 24) | (left[:, :, None] << 12) | right[:, None, :]
        at = np.nonzero(valid)
        rows.append(at[0])
        keys.append(key[at])
    return np.concatenate(rows), np.concatenate(keys)


def _key_rows(batches):
    for batch in batches:
        for start in range(0, batch.num_rows, 5000):
            part = batch.slice(start, 5000)
            at, keys = golay_keys(part.column(0).to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int32)), *(c.take(pa.array(at)) for c in part.columns)], names=["key", *part.schema.names])


def with_keys(fps: DataFrame) -> DataFrame:
    """A row ``key, *columns`` for each key of each row of ``fps`` (long columns, the fingerprint first)."""
    return fps.mapInArrow(_key_rows, T.StructType([T.StructField("key", T.IntegerType()), *fps.schema.fields]))


def _near(a: list[str], b: list[str], limit: int) -> Column:
    return reduce(Column.__add__, [F.bit_count(F.col(x).bitwiseXOR(F.col(y))) for x, y in zip(a, b, strict=True)]) <= limit


def _node(fp: list[str]) -> Column:
    """One long for a fingerprint: itself, or a hash of its two halves."""
    return F.col(fp[0]) if len(fp) == 1 else F.xxhash64(*fp)


def fingerprint_components(distinct: DataFrame, limit: int = LINK_BITS) -> DataFrame:
    """``fp, root`` (or ``fp, fp_b, root``) of all fingerprints ``distinct`` (columns ``fp`` or ``fp, fp_b``).

    Groups of near copies share many keys, so pairs are not listed. First every fingerprint is
    compared with the smallest and the largest of each of its keys; the components of these
    links are one class each. Then only fingerprints of one key and different classes are
    compared, which misses no link. Both joins verify the distance and can split a hot key. They are merge
    joins: Spark takes the keys for no larger than the fingerprints, of which each has about a hundred.
    """
    fp = [c for c in ("fp", "fp_b") if c in distinct.columns]
    low, high, other = ([p + c for c in fp] for p in ("low_", "high_", "other_"))
    spread = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = with_keys(distinct.select(*fp).repartition(spread))
    ends = keyed.groupBy("key").agg(
        F.min("fp").alias("low_fp"), F.max("fp").alias("high_fp"),
        *[f.alias(n) for c in fp[1:] for f, n in ((F.min_by(c, "fp"), f"low_{c}"), (F.max_by(c, "fp"), f"high_{c}"))],
    ).filter("low_fp < high_fp")
    meets = lambda end: (F.col("fp") != F.col(end[0])) & _near(fp, end, limit)
    stars = keyed.hint("merge").join(ends, "key").filter(meets(low) | meets(high))
    link = lambda end: F.when(meets(end), F.struct(_node(fp).alias("u"), _node(end).alias("v")))
    links = stars.select(F.explode(F.array_compact(F.array(link(low), link(high)))).alias("e")).select("e.*").distinct()
    links = saved(links, "near-links")
    first = saved(components(links), "near-classes")
    nodes = distinct.select(*fp, _node(fp).alias("node"))
    classes = nodes.join(first, "node", "left").select(*fp, F.coalesce("component", "node").alias("class"))
    classes = saved(classes, "near-fingerprints")
    rows = with_keys(classes.repartition(spread))
    left, right = rows.toDF("key", *fp, "class").hint("merge"), rows.toDF("key", *other, "class2")
    across = left.join(right, (left["key"] == right["key"]) & (F.col("class") < F.col("class2")) & _near(fp, other, limit)).select("class", "class2").distinct()
    across = saved(across, "near-across")
    second = saved(components(across.select(F.col("class").alias("u"), F.col("class2").alias("v"))), "near-roots")
    joined = classes.join(second.withColumnRenamed("node", "class"), "class", "left")
    return joined.select(*fp, F.coalesce("component", "class").alias("root"))


def near_groups(docs: DataFrame, similarity: float | None = None, whole: bool = False) -> DataFrame:
    """``doc_id, k_hash, fp, component_id, root`` for each row; ``component_id`` is the smallest doc_id reachable.

    ``root`` names the component: a ``component_id`` can be null, or an id that stands in two components.

    Fingerprints link at ``LINK_BITS`` or fewer differing bits, or with a ``similarity`` at
    ``link_bits(similarity)`` of 128 (and ``fp_b`` is their second half). With ``whole`` all texts whose
    sets of shingles have that similarity link too, however far apart their fingerprints are.
    A null text is empty; texts without words have fingerprint zero and link like any other. Equal
    fingerprints are one node, so copies cost nothing. Null doc ids count as no id (a component of
    nulls has null). Repeated rows all stay; an empty table gives no rows; other columns are not read.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_or_empty()).alias("k_hash"), text_or_empty().alias("text"))
    if similarity is None:
        limit, fp = LINK_BITS, ["fp"]
        rows = own.withColumn("fp", fingerprints("text")).drop("text")
    else:
        limit, fp = link_bits(similarity), ["fp", "fp_b"]
        rows = own.withColumn("both", similar_fingerprints("text")).select("doc_id", "k_hash", "both.*")
    rows = saved(rows, "fingerprints")
    least = saved(rows.groupBy(*fp).agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    rooted = saved(least.join(fingerprint_components(least, limit), fp), "near-rooted")
    if whole:
        classes = saved(rows.join(rooted, fp).select(F.col("k_hash").alias("node"), F.col("root").alias("class")).distinct(), "near-texts")
        links = class_links(own.select(F.col("k_hash").alias("node"), "text"), classes, similarity)
        joined = saved(components(links), "near-joined").select(F.col("node").alias("root"), "component")
        rooted = saved(rooted.join(joined, "root", "left").select(*fp, "least", F.coalesce("component", "root").alias("root")), "near-rooted")
    # written first, so that the join back deals both sides anew and can split a hot component
    smallest = saved(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "near-smallest")
    mapping = saved(rooted.join(smallest, "root").select(*fp, "component_id", "root"), "near-mapping")
    return rows.join(mapping, fp).select("doc_id", "k_hash", *fp, "component_id", "root")


def hex_fingerprint(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def near_dedup(docs: DataFrame, similarity: float | None = None) -> DataFrame:
    """``docs`` with one document of each component of ``near_groups``: the one with the smallest doc_id.

    With a ``similarity`` all pairs of texts that have it are linked (``whole``), not only those the keys find.
    Of rows that repeat that id the text with the smallest hash stays, once. A component of null
    ids keeps one row. Null and empty texts are one group; an empty table stays empty.
    """
    groups = near_groups(docs, similarity, whole=similarity is not None).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    keys = groups.groupBy("root").agg(F.min("component_id").alias("k_id"), F.min("k_hash").alias("k_hash"))
    return one_of_each(docs, keys.select("k_id", "k_hash"))
