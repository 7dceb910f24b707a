"""Language-model scores by prediction by partial matching, beside a word baseline.

Spark counts byte n-grams of the training texts; they are the levels of a trie of byte
contexts. A byte is coded in the longest known context; if it never followed there, an
escape is coded (its probability by the number of different followers) and the next shorter
context is tried without the bytes already excluded, down to a uniform choice. As the trie
is fixed after training, all positions of many texts are looked up at once.

What goes to all tasks is bounded whatever the corpus: the log probabilities of the most
frequent n-grams, from complete counts, and the frequent words. All other n-grams of a text
are sent to the part of the whole trie that holds their last two context bytes; with these all
their longer contexts are in that part. Rarer words are looked up by a join.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import saved, text_or_empty

#: Bytes of context.
ORDER = 4
#: Most n-grams, and most words, that go to all tasks; a cache, no result depends on it.
MOST = 1 << 21
#: N-grams in one part of the trie, about.
_PART = 1 << 18
#: No UTF-8 text has this byte; it stands before and after each text.
EDGE = b"\xff"
#: One tenth of the documents is held out.
FOLDS = 10
ADDED = 0.1
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_WORD, _GRAM, _END = 0, 1, 2
#: Bytes that are looked up together, and distinct entries that one task holds before it sends them on.
_CHUNK, _HELD = 4 << 20, 1 << 20

COUNTS = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("key", T.LongType()), T.StructField("n", T.LongType())])
SCORED = T.StructType([
    T.StructField("row", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("held_out", T.BooleanType()), T.StructField("n_tokens", T.LongType()),
    T.StructField("n_known", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType()), T.StructField("rare", T.ArrayType(T.LongType())),
    T.StructField("missed", T.ArrayType(T.LongType())), T.StructField("times", T.ArrayType(T.LongType())),
])


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id's text is divisible by ten; a null id has the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def word_hashes(words) -> np.ndarray:
    """Signed 64-bit hashes; two words of a corpus of a billion share one with a chance of 3 %."""
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(w) for w in words]), ">u8").astype("<u8").view(np.int64)


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram (context and byte) of each byte and end of the texts, and where each text's begin."""
    joined = np.frombuffer(b"".join(EDGE * ORDER + t + EDGE for t in texts), np.uint8)
    code = np.zeros(len(joined) - ORDER, np.int64)
    for back in range(ORDER + 1):
        code = (code << 8) | joined[back : len(joined) - ORDER + back]
    size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    starts = np.concatenate(([0], np.cumsum(size + ORDER)[:-1]))
    # the places of the next text's edge are no positions
    keep = np.ones(len(code), bool)
    for shift in range(ORDER):
        keep[(starts[1:] - ORDER + shift)] = False
    return code[keep], np.concatenate(([0], np.cumsum(size)[:-1]))


def chunks(texts: list[bytes]):
    """Slices of a list of texts of about ``_CHUNK`` bytes."""
    begin, size = 0, 0
    for at, text in enumerate(texts):
        size += len(text) + 1
        if size >= _CHUNK:
            yield begin, at + 1
            begin, size = at + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def _add_up(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    key, n = (np.concatenate([p[i] for p in parts]) for i in range(2))
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.nonzero(np.concatenate(([True], key[1:] != key[:-1])))[0] if len(key) else np.empty(0, np.int64)
    return key[first], np.add.reduceat(n, first) if len(key) else n


def _count(batches):
    words: Counter = Counter()
    parts: list = []
    documents = 0

    def rows(kind: int, key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int32)), pa.array(key), pa.array(n)], names=COUNTS.names)

    def word_rows():
        return rows(_WORD, word_hashes(words), np.fromiter(words.values(), np.int64, len(words)))

    for batch in batches:
        texts = [t.encode().translate(_LOWER) for t in batch.column(0).to_pylist()]
        documents += len(texts)
        for text in texts:
            words.update(text.split())
        for a, b in chunks(texts):
            parts.append(np.unique(grams(texts[a:b])[0], return_counts=True))
            if sum(len(p[0]) for p in parts) > 2 * _HELD:
                parts = [_add_up(parts)]
        if len(words) > _HELD:
            yield word_rows()
            words.clear()
        if parts and len(parts[0][0]) > _HELD:
            yield rows(_GRAM, *_add_up(parts))
            parts = []
    yield word_rows()
    if parts:
        yield rows(_GRAM, *_add_up(parts))
    yield rows(_END, np.zeros(1, np.int64), np.array([documents]))


def count(training: DataFrame) -> DataFrame:
    """``kind, key, n``: words, byte n-grams and ends of all training texts, added up by Spark."""
    texts = training.select(text_or_empty().alias("text"))
    return saved(texts.mapInArrow(_count, COUNTS).groupBy("kind", "key").agg(F.sum("n").alias("n")), "lm-counts")


@dataclass
class Level:
    """Contexts of one length and the bytes seen after them, both sorted."""

    grams: np.ndarray
    n: np.ndarray
    contexts: np.ndarray
    total: np.ndarray
    kinds: np.ndarray
    #: After an escape from a context: weight and number of the followers in the next shorter one that are not excluded.
    below: np.ndarray
    below_kinds: np.ndarray


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


class Trie:
    """Levels for contexts of zero to ``ORDER`` bytes, from sorted ``(n-grams, counts)`` of one to ``ORDER + 1`` bytes."""

    def __init__(self, tables: list[tuple[np.ndarray, np.ndarray]]):
        self.levels: list[Level] = []
        for order, (code, n) in enumerate(tables):
            context = code >> 8
            first = np.nonzero(np.concatenate(([True], context[1:] != context[:-1])))[0] if len(code) else np.empty(0, np.int64)
            contexts, kinds = context[first], np.diff(np.append(first, len(code)))
            total = np.add.reduceat(n, first) if len(code) else n
            below, below_kinds = np.zeros(len(contexts), np.int64), np.zeros(len(contexts), np.int64)
            if order and len(code):
                lower, mask = self.levels[-1], (1 << 8 * order) - 1
                parent, _ = _find(lower.contexts, contexts & (mask >> 8))
                same, _ = _find(lower.grams, code & mask)
                below = lower.total[parent] - np.add.reduceat(lower.n[same], first)
                below_kinds = lower.kinds[parent] - kinds
            self.levels.append(Level(code, n, contexts, total, kinds, below, below_kinds))
        top = self.levels[-1]
        owner = np.repeat(np.arange(len(top.contexts)), top.kinds)
        self.log_top = np.log10(top.n / (top.total + top.kinds)[owner]) if len(top.n) else np.empty(0)

    def log10(self, codes: np.ndarray) -> np.ndarray:
        """Log10 probability of each n-gram's last byte after the others."""
        at, known = _find(self.levels[-1].grams, codes)
        out = self.log_top[at] if len(self.log_top) else np.zeros(len(codes))
        left = np.nonzero(~known)[0]
        if len(left):
            out[left] = self._by_escapes(codes[left])
        return out

    def _by_escapes(self, codes: np.ndarray) -> np.ndarray:
        out, going = np.zeros(len(codes)), np.ones(len(codes), bool)
        longer = np.full(len(codes), -1)
        for order in range(ORDER, -1, -1):
            level = self.levels[order]
            code = codes & ((1 << 8 * (order + 1)) - 1)
            context, found = _find(level.contexts, code >> 8)
            place, hit = _find(level.grams, code)
            hit &= found & going
            if len(level.contexts):
                weight, kinds = level.total[context], level.kinds[context]
                if order < ORDER:
                    above = self.levels[order + 1]
                    if len(above.contexts):
                        weight = np.where(longer >= 0, above.below[longer], weight)
                        kinds = np.where(longer >= 0, above.below_kinds[longer], kinds)
                room = weight + kinds
                out[hit] += np.log10(level.n[place[hit]] / room[hit])
                escape = going & found & ~hit & (kinds > 0)
                out[escape] += np.log10(kinds[escape] / room[escape])
            going &= ~hit
            longer = np.where(found, context, -1)
        seen = int(self.levels[0].kinds[0]) if len(self.levels[0].kinds) else 0
        out[going] -= np.log10(256 - seen) if seen < 256 else 0.0
        return out


@dataclass
class Scorer:
    """What a task needs: frequent n-grams and words with their log10 probability."""

    grams: np.ndarray
    log_grams: np.ndarray
    words: np.ndarray
    log_words: np.ndarray
    log_end: float
    end_known: bool

    def rows(self, first_row: int, ids: list, held: list, texts: list[str]) -> pa.RecordBatch:
        lower = [t.encode().translate(_LOWER) for t in texts]
        parts = [self._scores(lower[a:b]) for a, b in chunks(lower)]
        score, missing, missed, times = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else [np.empty(0, np.int64)] * 4
        number: dict[bytes, int] = {}
        place, sizes = [], []
        for text in lower:
            split = text.split()
            sizes.append(len(split))
            place += [number.setdefault(w, len(number)) for w in split]
        hashes = word_hashes(number)
        at, known = _find(self.words, hashes)
        value = np.where(known, self.log_words[at], 0.0) if len(self.words) else np.zeros(len(hashes))
        place, sizes = np.array(place, np.int64), np.array(sizes, np.int64)
        ends = np.cumsum(sizes)
        running = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[np.concatenate(([0], ends))])
        base = np.array([value[place[b - n : b]].sum() for b, n in zip(ends.tolist(), sizes.tolist(), strict=True)]) + self.log_end
        is_known = known[place] if len(place) else np.empty(0, bool)
        rare = hashes[place[~is_known]] if len(place) else hashes
        offsets = np.concatenate(([0], np.cumsum(running(~is_known)))).astype(np.int32)
        places = pa.array(np.concatenate(([0], np.cumsum(missing))).astype(np.int32))
        n = len(texts)
        return pa.RecordBatch.from_arrays([
            pa.array(np.arange(first_row, first_row + n)), pa.array(ids, pa.int64()), pa.array(held, pa.bool_()), pa.array(sizes + 1),
            pa.array(running(is_known) + int(self.end_known)), pa.array(base, pa.float64()), pa.array(score, pa.float64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(rare)),
            pa.ListArray.from_arrays(places, pa.array(missed)), pa.ListArray.from_arrays(places, pa.array(times)),
        ], names=SCORED.names)

    def _scores(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        """Of each text the score of the known n-grams and the number of the others; these n-grams and how often each comes."""
        codes, starts = grams(texts)
        at, known = _find(self.grams, codes)
        value = np.where(known, self.log_grams[at], 0.0) if len(self.grams) else np.zeros(len(codes))
        left = np.nonzero(~known)[0]
        text, code = np.searchsorted(starts, left, "right") - 1, codes[left]
        order = np.lexsort((code, text))
        text, code = text[order], code[order]
        first = np.nonzero(np.concatenate(([True], (code[1:] != code[:-1]) | (text[1:] != text[:-1]))))[0] if len(left) else left
        return np.add.reduceat(value, starts), np.bincount(text[first], minlength=len(texts)), code[first], np.diff(np.append(first, len(left)))


def _sorted(table: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Two columns of a small table, by the first."""
    found = table.toArrow()
    key, value = (found.column(i).to_numpy() for i in range(2))
    order = np.argsort(key)
    return key[order], value[order]


def _shortened(key: np.ndarray, n: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    return _add_up([(key & ((1 << 8 * length) - 1), n)])


def frequent_grams(all_grams: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """At most ``MOST`` of the most frequent n-grams and their log10 probabilities, by the complete totals of their contexts."""
    size = F.floor(8 * F.log2("n"))
    bins = sorted(((r.b, r.k) for r in all_grams.groupBy(size.alias("b")).agg(F.count("*").alias("k")).collect()), reverse=True)
    room, least = MOST, None
    for b, k in bins:
        room -= k
        if room < 0:
            break
        least = b
    context = F.shiftright("key", 8).alias("context")
    totals = all_grams.groupBy(context).agg((F.sum("n") + F.count("*")).alias("room"))
    often = all_grams.filter(size >= least if least is not None else F.lit(False)).select("key", "n", context)
    return _sorted(often.join(totals, "context").select("key", F.log10(F.col("n") / F.col("room")).alias("p")))


ANSWERS = T.StructType([T.StructField("code", T.LongType()), T.StructField("p", T.DoubleType())])


def answers(all_grams: DataFrame, entries: int, codes: DataFrame) -> DataFrame:
    """``code, p``: the log10 probability of each n-gram of ``codes`` (one column ``code``) in the trie of all ``entries`` n-grams.

    N-grams and questions meet by the two bytes before the last: all n-grams of three bytes and
    more that a question needs are then in its part. Shorter ones (at most 256 + 256**2) go to all.
    """
    small = lambda length: _sorted(all_grams.groupBy(F.col("key").bitwiseAND((1 << 8 * length) - 1).alias("key")).agg(F.sum("n").alias("n")))
    short = codes.sparkSession.sparkContext.broadcast([small(1), small(2)])

    def task(batches):
        kept = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if not kept:
            return
        key, n = (np.concatenate(x) for x in zip(*kept, strict=True))
        asked, key, n = key[n == 0], key[n > 0], n[n > 0]
        if not len(asked):
            return
        trie = Trie([*short.value, *(_shortened(key, n, length) for length in range(3, ORDER + 2))])
        for a in range(0, len(asked), _HELD):
            part = asked[a : a + _HELD]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(trie.log10(part))], names=ANSWERS.names)

    # a question is an n-gram without a count
    rows = all_grams.select("key", "n").unionByName(codes.select(F.col("code").alias("key"), F.lit(0).cast("long").alias("n")))
    parts = rows.repartition(-(-entries // _PART) + 1, F.shiftright("key", 8).bitwiseAND(0xFFFF))
    return parts.mapInArrow(task, ANSWERS)


def score_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for each row of ``docs``.

    A-Z are lower-cased. Tokens are words and one end; ``base_score`` adds up
    ``log10((c + 0.1) / (N + 0.1 (V + 1)))``. ``score`` is the trie's log10 probability of the
    text's bytes and its end. Both learn from documents that are not held out. A null text is
    empty, a null doc id is held out; repeated rows all count and all stay; an empty table
    gives no rows; other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    counts = count(docs.filter(~held_out(F.col("doc_id"))))
    seen = {r.kind: r for r in counts.groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).collect()}
    ends = seen[_END].n if _END in seen else 0
    tokens = ends + (seen[_WORD].n if _WORD in seen else 0)
    kinds = int(ends > 0) + (seen[_WORD].kinds if _WORD in seen else 0)
    room = tokens + ADDED * (kinds + 1)
    words = counts.filter(F.col("kind") == _WORD).select("key", "n")
    often = max(1, -(-tokens // MOST))
    key, n = _sorted(words.filter(F.col("n") >= often))
    all_grams = counts.filter(F.col("kind") == _GRAM).select("key", "n")
    scorer = Scorer(*frequent_grams(all_grams), key, np.log10((n + ADDED) / room), float(np.log10((ends + ADDED) / room)), ends > 0)
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def task(batches):
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(3)]
            for a in range(0, batch.num_rows, 1000):
                yield shared.value.rows(row, *(c[a : a + 1000] for c in columns))
                row += min(1000, batch.num_rows - a)

    rows = saved(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(task, SCORED), "lm-scores")
    rare = rows.select("row", F.explode("rare").alias("key"))
    found = rare.join(words.filter(F.col("n") < often), "key", "left").groupBy("row").agg(
        F.sum(F.log10((F.coalesce("n", F.lit(0)) + ADDED) / room)).alias("more"), F.count("n").alias("more_known")
    )
    missed = rows.select("row", F.inline(F.arrays_zip("missed", "times"))).toDF("row", "code", "times")
    known = answers(all_grams, seen[_GRAM].kinds if _GRAM in seen else 0, missed.select("code").distinct())
    others = missed.join(known, "code").groupBy("row").agg(F.sum(F.col("times") * F.col("p")).alias("rest"))
    return rows.drop("rare", "missed", "times").join(found, "row", "left").join(others, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("more", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("rest", F.lit(0.0))).alias("score"),
    )
