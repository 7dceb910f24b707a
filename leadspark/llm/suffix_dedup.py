"""Passages that stand more than once, cut out byte for byte by distributed prefix doubling.

Ranking every byte position would move about twenty bytes for each byte of text and round. So the
positions that are ranked are a sample chosen by content: of the places in a string of ``length``
bytes that keep ``BEFORE`` bytes before and ``CORE - BEFORE`` after them, the leftmost one whose
eight bytes have the least hash, its *anchor*. Equal strings have their anchors at equal places,
so a string is known by its anchor and the offset from its start to the anchor, and neighbouring
strings share an anchor: one row stands for all offsets that an anchor answers for.

Round zero ranks the anchors by the ``CORE`` bytes that all these strings share. Each further
round splits the offsets of an anchor into finer segments and ranks it by the pair of its last
rank and the longer string that all strings of the segment share (``core``: 32 bytes, then 158,
190 and all 200). A core that stands once ends its segment: nothing in it repeats. Where
the union of the segment's strings (``hull``) stands twice, all of them repeat. Only segments
whose core meets different hulls go on, until a segment is a single string. Ranks are 64-bit
names of the content; a hull counts as repeated only if both names, core and hull, agree.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import remove
from .common import folder, text_or_empty

#: Bytes of a repeated string.
LENGTH = 200
#: Bytes that all strings of an anchor share, and how many of them are before it.
CORE, BEFORE = 32, 12
#: Offsets in the segments of the rounds after the first.
WIDTHS = (43, 11, 1)
#: String starts handled at once within a long text.
CHUNK = 1 << 22
_ANCHORS = "k1 long, k2 long, doc_id long, pos long, lo int, hi int, core long, hull long"
_PIECES = "sid long, k1 long, k2 long, pos long, lo int, hi int, core long, bytes binary"
_SEGMENTS = "sid long, first int, last int, lo int, hi int, core long, hull long"
_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def anchors(raw: bytes, length: int = LENGTH):
    """``(anchor, first start, last start)`` for the strings of ``length`` bytes in ``raw``, in blocks."""
    window = length - CORE + 1
    for base in range(0, len(raw) - length + 1, CHUNK):
        part = np.frombuffer(raw, np.uint8)[base : base + CHUNK - 1 + length]
        grams = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(part, 8)).view("<u8").ravel() * np.uint64(0x9E3779B97F4A7C15)
        grams ^= grams >> np.uint64(29)
        grams *= np.uint64(0xBF58476D1CE4E5B9)
        n = len(part) - length + 1
        # hash above place: the least value is the leftmost of the least hashes
        value = (grams & np.uint64(0xFFFFFFFF00000000))[BEFORE : BEFORE + n + window - 1] | np.arange(BEFORE, BEFORE + n + window - 1, dtype=np.uint64)
        rows = np.concatenate([value, np.full(-len(value) % window, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, window)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()[window - 1 : window - 1 + n]
        behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()[:n]
        place = (np.minimum(ahead, behind) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(place[1:] != place[:-1]) + 1])
        last = np.append(first[1:], n) - 1
        yield place[first] + base, first + base, last + base


def _signed(values) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


def _anchor_rows(batches, length: int):
    name = xxhash.xxh3_64_intdigest
    for batch in batches:
        for k1, k2, doc_id, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for place, first, last in anchors(raw, length):
                lo, hi, at = place - last, place - first, place.tolist()
                core = _signed([name(raw[a - BEFORE : a - BEFORE + CORE]) for a in at])
                hull = _signed([name(raw[s : e + length], d) for s, e, d in zip(first.tolist(), last.tolist(), (lo * length + hi).tolist(), strict=True)])
                same = [pa.array(np.full(len(at), v)) for v in (k1, k2)] + [pa.array([doc_id] * len(at), pa.int64())]
                yield pa.RecordBatch.from_arrays([*same, pa.array(place), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)), pa.array(core), pa.array(hull)], names=["k1", "k2", "doc_id", "pos", "lo", "hi", "core", "hull"])


def _pieces(batches, length: int):
    """The bytes around each wanted anchor of a text: all strings it answers for."""
    names = ["sid", "k1", "k2", "pos", "lo", "hi", "core", "bytes"]
    for batch in batches:
        out = [
            (w["sid"], k1, k2, w["pos"], w["lo"], w["hi"], w["core"], raw[w["pos"] - w["hi"] : w["pos"] - w["lo"] + length])
            for k1, k2, raw, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True) for w in wanted
        ]
        if out:
            kinds = [pa.int64()] * 4 + [pa.int32()] * 2 + [pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def _split(batches, length: int, width: int):
    """For each segment ``first..last`` of an anchor its parts of ``width`` offsets, with their core and hull.

    The core of a part is what all its strings share, whether or not the anchor answers for
    all of its offsets; the hull is the union of the strings it does answer for.
    """
    name = xxhash.xxh3_64_intdigest
    for batch in batches:
        out = []
        for sid, lo, hi, rank, raw, segments in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for segment in segments:
                for first in range(segment["first"], segment["last"] + 1, width):
                    last = min(first + width - 1, segment["last"])
                    a, b = max(first, lo), min(last, hi)
                    if a <= b:
                        seed = (rank if segment["core"] is None else segment["core"]) & 0xFFFFFFFFFFFFFFFF ^ first * length + last
                        core = name(raw[hi - first : hi - last + length], seed)
                        hull = name(raw[hi - b : hi - a + length], core ^ a * length + b)
                        out.append((sid, first, last, a, b, core, hull))
        if out:
            sid, first, last, a, b, core, hull = zip(*out, strict=True)
            arrays = [pa.array(sid, pa.int64()), *(pa.array(v, pa.int32()) for v in (first, last, a, b)), pa.array(_signed(core)), pa.array(_signed(hull))]
            yield pa.RecordBatch.from_arrays(arrays, names=["sid", "first", "last", "lo", "hi", "core", "hull"])


def _keyed(docs: DataFrame) -> DataFrame:
    text = text_or_empty()
    return docs.select(F.xxhash64(F.lit(0), text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"), F.col("doc_id").cast("long").alias("doc_id"), text.cast("binary").alias("raw"))


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``k1, k2, spans``: for each text with repeats (named by two hashes) the spans of its strings
    of ``length`` bytes that start anywhere else too, in bytes, end exclusive, unordered and overlapping.

    Copies of a text repeat all its strings. Strings never cross texts; a null text is empty; a
    text shorter than ``length`` has none. Every join has one row per key on its other side,
    so a string that stands in a third of all texts is a skewed key that can be split. Long
    texts are read in blocks. Intermediate tables are removed as soon as they are used up.
    """
    spark, base = docs.sparkSession, folder(docs.sparkSession, "repeats")

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{base}/{name}")
        return spark.read.schema(df.schema).parquet(f"{base}/{name}")

    texts = _keyed(docs)
    placed = stored(texts.mapInArrow(partial(_anchor_rows, length=length), _ANCHORS), "anchors")
    # tables of ranks are written first, so that a join deals both sides anew and can split a hot rank
    repeated = stored(placed.groupBy("core").agg(F.count("*").alias("n")).filter("n > 1").select("core"), "repeated")
    ranked = stored(placed.join(repeated, "core"), "ranked")
    remove(spark, f"{base}/anchors")

    hulls = ranked.groupBy("core", "hull").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "doc_id", "pos", "lo", "hi")).alias("one"))
    hulls = stored(hulls.select("core", "hull", "n", "one.*").withColumn("sid", F.monotonically_increasing_id()), "hulls")
    whole = ranked.join(hulls.filter("n > 1").select("core", "hull"), ["core", "hull"])
    whole = stored(whole.select("k1", "k2", (F.col("pos") - F.col("hi")).alias("start"), (F.col("pos") - F.col("lo") + length).alias("end")).distinct(), "whole")
    mixed = stored(hulls.groupBy("core").agg(F.count("*").alias("kinds")).filter("kinds > 1").select("core"), "mixed")
    wanted = hulls.join(mixed, "core").groupBy("k1", "k2", "doc_id").agg(F.collect_list(F.struct("sid", "pos", "lo", "hi", "core")).alias("wanted"))
    at, want = texts.alias("t"), wanted.alias("w")
    same = (F.col("t.k1") == F.col("w.k1")) & (F.col("t.k2") == F.col("w.k2")) & F.col("t.doc_id").eqNullSafe(F.col("w.doc_id"))
    pieces = at.join(want, same).select("t.k1", "t.k2", "t.raw", "w.wanted").mapInArrow(partial(_pieces, length=length), _PIECES)
    pieces = stored(pieces, "pieces")
    remove(spark, f"{base}/ranked")

    found = []
    everything = F.array(F.struct(F.lit(BEFORE).alias("first"), F.lit(length - CORE + BEFORE).alias("last"), F.lit(None).cast("long").alias("core")))
    asked = pieces.withColumn("segments", everything)
    for turn, width in enumerate(WIDTHS):
        rows = asked.select("sid", "lo", "hi", "core", "bytes", "segments").mapInArrow(partial(_split, length=length, width=width), _SEGMENTS)
        rows = stored(rows, f"segments-{turn}")
        kinds = stored(rows.groupBy("core", "hull").agg(F.count("*").alias("n")), f"kinds-{turn}")
        twice = rows.join(kinds.filter("n > 1").select("core", "hull"), ["core", "hull"]).select("sid", "lo", "hi")
        found.append(stored(twice, f"found-{turn}"))
        if width > 1:
            open_cores = stored(kinds.groupBy("core").agg(F.count("*").alias("kinds")).filter("kinds > 1").select("core"), f"open-{turn}")
            left = rows.join(open_cores, "core").groupBy("sid").agg(F.collect_list(F.struct("first", "last", "core")).alias("segments"))
            asked = pieces.join(left, "sid")
    parts = found[0]
    for more in found[1:]:
        parts = parts.unionByName(more)
    parts = parts.join(pieces.select("sid", "k1", "k2", "pos"), "sid").select("k1", "k2", (F.col("pos") - F.col("hi")).alias("start"), (F.col("pos") - F.col("lo") + length).alias("end"))
    spans = whole.unionByName(parts).groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    spans = spark.read.schema(spans.schema).parquet(_written(spans, f"{base}/spans"))
    for name in ("repeated", "hulls", "whole", "mixed", "pieces", *(f"{kind}-{turn}" for kind in ("segments", "kinds", "found", "open") for turn in range(len(WIDTHS)))):
        remove(spark, f"{base}/{name}")
    return spans


def _written(df: DataFrame, path: str) -> str:
    df.write.parquet(path)
    return path


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Overlapping and touching spans joined, in order."""
    out: list[tuple[int, int]] = []
    for start, end in sorted((s["start"], s["end"]) for s in spans or ()):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


@F.arrow_udf(_SPANS)
def _maximal(spans: pa.Array) -> pa.Array:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return pa.array([[{"start": a, "end": b} for a, b in merged(s)] for s in spans.to_pylist()], kind)


@F.arrow_udf(T.BinaryType())
def without(raw: pa.Array, spans: pa.Array) -> pa.Array:
    """The bytes outside the spans (maximal, in order), concatenated."""
    out = []
    for text, cuts in zip(raw.to_pylist(), spans.to_pylist(), strict=True):
        ends = [0, *(c["end"] for c in cuts)]
        starts = [*(c["start"] for c in cuts), len(text)]
        out.append(b"".join(text[a:b] for a, b in zip(ends, starts, strict=True)))
    return pa.array(out, pa.binary())


@F.arrow_udf(T.StringType())
def kept_digest(raw: pa.Array, spans: pa.Array) -> pa.Array:
    """SHA-256 of the bytes outside the spans."""
    out = []
    for text, cuts in zip(raw.to_pylist(), spans.to_pylist(), strict=True):
        digest, at, view = hashlib.sha256(), 0, memoryview(text)
        for cut in cuts:
            digest.update(view[at : cut["start"]])
            at = cut["end"]
        digest.update(view[at:])
        out.append(digest.hexdigest())
    return pa.array(out)


def repeated_passages(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc_id, raw, spans`` for each row of ``docs``: its bytes and the maximal runs of repeated ones.

    A byte is repeated if a string of ``length`` bytes that covers it also starts anywhere else,
    in the same text too. A null text is empty bytes; short texts and texts without repeats have
    no spans. Null and repeated ids are carried; repeated rows are copies of each other and
    all have a row here. An empty table gives no rows; other columns are not read.
    ``without(raw, spans)`` is what is left of a text.
    """
    texts, spans = _keyed(docs), repeated_spans(docs, length)
    none = F.array().cast(_SPANS)
    return texts.join(spans, ["k1", "k2"], "left").select("doc_id", "raw", _maximal(F.coalesce("spans", none)).alias("spans"))


def removed_bytes(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda total, s: total + s.end - s.start)
