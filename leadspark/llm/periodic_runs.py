"""Periodic runs of words by an online sparse diagonal dynamic program.

Words that equal the word ``q`` places before form diagonals of lag ``q``; a run of period ``q`` and
length ``n`` is a diagonal of ``n - q`` matches. The words of a text are read once. Each
one's earlier occurrence adds to the match length of its lag; a lag that it does not
reach ends, and if it was long enough its run is emitted on the spot.

What keeps it sparse: a run of four periods or more has at least ``3 q`` matches, so for the
lags from ``2**k`` to ``2**(k + 1) - 1`` only places matter whose last ``3 * 2**k`` words stand
there too. Of these earlier places only the latest can belong to a smallest period: two
periods under ``2**(k + 1)`` of so long a stretch have their common divisor as a period too. So a
word meets one earlier occurrence for each power of two, a text of ``n`` words costs
``n log n`` however often its words repeat, and where no stretch of ``3 * 2**k`` words repeats, the
text is done.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_or_empty

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: A run has at least so many words and at least so many periods.
LEAST, PERIODS = 6, 4
#: Words of several texts that are handled together.
TOGETHER = 300_000
_RUNS = "array<struct<start: long, length: long, period: long>>"
_OUT = f"doc_id long, n_words long, runs {_RUNS}, collapsed string"
_RUN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def periodic_variant(words: list[str], doc_id: int | None) -> list[str]:
    """The words, made periodic from some place on where 10 divides the CRC-32 of the id in decimals."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def _paired(names: np.ndarray, step: int) -> np.ndarray:
    """Names of the stretches twice as long: equal exactly if both halves are."""
    pairs = names[:-step] * (int(names.max(initial=0)) + 1) + names[step:]
    return np.unique(pairs, return_inverse=True)[1]


def find_runs(names: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of every run in a sequence of word numbers, by end, then period.

    ``names`` may hold several texts, if no two of them share a number.
    """
    found: list[tuple[int, int, int]] = []
    scale, length = 1, PERIODS - 1
    #: names of the stretches of ``length`` words that end at ``length - 1``, ``length``, ...
    long_names = names
    for _ in range(2):
        if len(long_names) > 1:
            count = int(names.max(initial=0)) + 1
            long_names = np.unique(long_names[:-1] * count + names[len(names) - len(long_names) + 1 :], return_inverse=True)[1]
        else:
            long_names = long_names[:0]
    covered: dict[int, list[tuple[int, int]]] = {}
    while len(long_names) > 1:
        again = np.flatnonzero(np.bincount(long_names)[long_names] > 1)
        if not len(again):
            break
        _scan(again.tolist(), long_names[again].tolist(), scale, length, least, covered, found)
        if len(long_names) <= length:
            break
        long_names = _paired(long_names, length)
        scale, length = 2 * scale, 2 * length
    return found


def _scan(places, names, scale, length, least, covered, found) -> None:
    """One pass over the stretches that stand more than once, for the lags from ``scale`` to ``2 * scale - 1``."""
    latest: dict[int, int] = {}
    waiting = 0
    lag = matches = 0
    before = -2

    def ends(end: int) -> None:
        """The diagonal's last match was at word ``end``."""
        start, size = end - matches - lag + 1, matches + lag
        if size >= max(least, PERIODS * lag):
            # a smaller period of the same stretch ends at the same word
            if not any(s <= start for s, _ in covered.get(end, ())):
                found.append((start, size, lag))
                covered.setdefault(end, []).append((start, lag))

    for at, (place, name) in enumerate(zip(places, names, strict=True)):
        while places[waiting] <= place - scale:
            latest[names[waiting]] = places[waiting]
            waiting += 1
        earlier = latest.get(name)
        step = 0 if earlier is None else place - earlier
        if step >= 2 * scale:
            step = 0
        if lag and (step != lag or place != before + 1):
            ends(before + length - 1)
            lag = 0
        if step:
            if lag:
                matches += 1
            else:
                lag, matches = step, length
        before = place
    if lag:
        ends(before + length - 1)


def text_runs(words: list[str]) -> list[tuple[int, int, int]]:
    """The runs of one text, by start, then period."""
    numbers: dict[str, int] = {}
    return sorted(((s, n, p) for s, n, p in find_runs(np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64))), key=lambda r: (r[0], r[2]))


def collapsed(words: list[str], runs: list[tuple[int, int, int]]) -> str:
    """The words that no run contains after its first period, joined by spaces."""
    if not runs:
        return " ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return " ".join([words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)])


def _together(batches, variant):
    """The texts' words in groups of about ``TOGETHER``; a longer text is a group of its own."""
    group, size = [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = WORD.findall(text)
            words = variant(words, doc_id) if variant else words
            group.append((doc_id, words))
            size += len(words)
            if size >= TOGETHER:
                yield group
                group, size = [], 0
    if group:
        yield group


def _rows(batches, variant):
    for group in _together(batches, variant):
        names, starts, base = [], [], 0
        for _, words in group:
            numbers: dict[str, int] = {}
            starts.append(len(names))
            names += [numbers.setdefault(w, base + len(numbers)) for w in words]
            base += len(numbers)
        begins = np.array(starts, np.int64)
        runs: list[list[tuple[int, int, int]]] = [[] for _ in group]
        for start, length, period in find_runs(np.array(names, np.int64)):
            # the last text that begins at or before the run; texts without words begin where the next does
            owner = int(np.searchsorted(begins, start, "right")) - 1
            runs[owner].append((start - starts[owner], length, period))
        for own in runs:
            own.sort(key=lambda r: (r[0], r[2]))
        yield pa.RecordBatch.from_arrays([
            pa.array([d for d, _ in group], pa.int64()), pa.array([len(w) for _, w in group], pa.int64()),
            pa.array([[{"start": s, "length": n, "period": p} for s, n, p in own] for own in runs], _RUN_TYPE),
            pa.array([collapsed(w, own) for (_, w), own in zip(group, runs, strict=True)], pa.string()),
        ], names=["doc_id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, variant=None) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` for each row of ``docs``.

    A run is a stretch of words with smallest period ``q`` and at least ``max(6, 4 q)`` words
    that neither neighbour extends; ``runs`` has all of them by start, then period.
    ``collapsed`` is the text without the words that a run contains after its first period.
    ``variant(words, doc_id)`` may change the words first. A null text is empty; an empty one has no
    runs and an empty ``collapsed``. Null and repeated ids are carried, repeated rows each have a
    row, an empty table gives none, other columns are not read. Nothing is shuffled, and
    memory is in proportion to the longest text.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(partial(_rows, variant=variant), _OUT)


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest length for its period; of equal ones the first, then the shortest period."""
    best = None
    for start, length, period in runs:
        if best is None or (length * best[2], -start, -period) > (best[1] * period, -best[0], -best[2]):
            best = (start, length, period)
    return best


@F.arrow_udf(T.StructType([T.StructField(name, T.LongType()) for name in ("start", "length", "period")]))
def strongest_run(runs: pa.Array) -> pa.Array:
    """``strongest`` of a column of runs; null where there is none."""
    best = [strongest([(r["start"], r["length"], r["period"]) for r in own]) for own in runs.to_pylist()]
    return pa.array([None if b is None else {"start": b[0], "length": b[1], "period": b[2]} for b in best], _RUN_TYPE.value_type)


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
