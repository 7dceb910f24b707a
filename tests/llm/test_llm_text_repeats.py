"""Spelling variants, periodic runs and repeated passages against plain versions, and their edge cases."""

import os
import random
import sys
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
sys.path.insert(0, os.path.dirname(os.path.dirname(__file__)))

import llm_reference as ref  # noqa: E402

from leadspark.llm import common, periodic_runs, queries, spelling, suffix_dedup  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
CLASH = ("word", "n", "run", "raw", "spans", "k1", "k2", "core", "runs", "signature", "form", "root", "sid", "wanted", "collapsed")


def frame(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return common.ready(spark) and docs.withColumns({c: F.lit(f"own {c}") for c in CLASH})


# -- spelling ---------------------------------------------------------------------------------

def _answers(df):
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect()}


def _misspelt_texts(seed, alphabet):
    rng = random.Random(seed)
    base = ["".join(rng.choices(alphabet, k=rng.randint(6, 10))) for _ in range(25)]
    for i in range(250):
        out = []
        for _ in range(40):
            w = rng.choice(base[:3] if rng.random() < 0.7 else base)
            for _ in range((rng.random() < 0.25) + (rng.random() < 0.08)):
                k = rng.randrange(len(w))
                w = w[:k] + rng.choice(["", rng.choice(alphabet), w[k] + rng.choice(alphabet)]) + w[k + 1 :]
            out.append(w if rng.random() < 0.8 else w.upper())
        yield (None if i % 50 == 0 else i // 2), " ".join(out)


@pytest.mark.parametrize("alphabet", ["abcdeéÿß", "aAÀ×b"])
@pytest.mark.parametrize("parts", [spelling.PARTS, 5])
def test_spelling_equals_brute_force(spark, alphabet, parts):
    rows = [*_misspelt_texts(len(alphabet), alphabet), (5, None), (6, ""), (7, "abcdefgh1ijklmno abcdefghijklmnoé"), (7, "zzzzzzz zzzzzzz ğğğğğğğ ğğğğğğğ")]
    want = ref.spelling(rows)
    assert _answers(spelling.spelling_variants(frame(spark, rows), parts=parts, misspell=True)) == want
    assert any(v[2] for v in want.values())


def test_signatures_meet(spark):
    """Words one edit apart share a signature, whatever the parts are."""
    rng = random.Random(4)
    pairs = []
    for _ in range(300):
        w = "".join(rng.choices("abcdefghij", k=rng.randint(7, 12)))
        k = rng.randrange(len(w))
        pairs.append((w, w[:k] + rng.choice(["", "z", w[k] + "y"]) + w[k + 1 :]))
    df = spark.createDataFrame(pairs, "a string, b string")
    parts = ["aj", "bi", "ch", "dg", "ef", "zy"]
    both = df.select(F.arrays_overlap(spelling.signatures(F.col("a"), parts), spelling.signatures(F.col("b"), parts)).alias("meet"))
    assert both.filter("NOT meet").count() == 0


def test_chains_of_forms(spark):
    counts = [("aaaaaaaa", 100_000), ("aaaaaaab", 9_000), ("aaaaaabb", 800), ("aaaaabbb", 70), ("aaaabbbb", 6), ("bbbbbbbb", 2), ("baaaaaaa", 10_000), ("caaaaaaa", 10_001)]
    got = _answers(spelling.spelling_groups(spark.createDataFrame(counts, "word string, n long")))
    assert {got[w][4] for w, _ in counts if w.startswith("aaaa")} == {"aaaaaaaa"} and got["bbbbbbbb"] == (2, 0, None, None, "bbbbbbbb")
    # the most frequent near word decides, and is not frequent enough for the last one
    assert got["baaaaaaa"][2] == "aaaaaaaa" and got["caaaaaaa"][2] is None and got["caaaaaaa"][1] == 2
    tied = _answers(spelling.spelling_groups(spark.createDataFrame([("abcdefgz", 50), ("abcdefga", 50), ("abcdefgé", 5)], "word string, n long")))
    assert tied["abcdefgé"] == (5, 2, "abcdefga", 50, "abcdefga")


def test_spelling_of_nothing(spark):
    assert spelling.spelling_variants(frame(spark, []), misspell=True).collect() == []
    assert spelling.spelling_variants(frame(spark, [(1, None), (None, ""), (2, "short words only")])).collect() == []


# -- periodic runs -------------------------------------------------------------------------------

def test_runs_equal_brute_force():
    rng = random.Random(1)
    for _ in range(4000):
        k, out = rng.choice([1, 2, 2, 3, 5]), []
        n = rng.randint(0, 120)
        while len(out) < n:
            unit = [rng.choice("abcdefgh"[:k]) for _ in range(rng.randint(1, 7))]
            if rng.random() < 0.3:
                unit = unit * rng.randint(1, 5) + [rng.choice("ab")]
            out += (unit * rng.randint(1, 6))[: None if rng.random() < 0.6 else -1]
        words = out[:n]
        got = periodic_runs.text_runs(words)
        assert got == ref.runs(words), words


def test_long_repetitive_texts_are_quick():
    same = ["a"] * 100_000
    assert periodic_runs.text_runs(same) == [(0, 100_000, 1)]
    assert periodic_runs.text_runs([*same, "b", *same]) == [(0, 100_000, 1), (100_001, 100_000, 1)]
    nested = (["a"] * 6 + ["b"]) * 9_000
    runs = periodic_runs.text_runs(nested)
    assert len(runs) == 9_001 and (0, len(nested), 7) in runs and (7, 6, 1) in runs


def test_periodic_query(spark):
    docs = {r.doc_id: r.text for r in common.table(spark, SF, "documents").collect()}
    rows = queries.op12_periodic_runs(spark, SF).collect()
    assert len(rows) == len(docs) and any(r.n_runs for r in rows)
    for r in rows:
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) == ref.periodic(r.doc_id, docs[r.doc_id]), r.doc_id


def test_runs_of_odd_rows(spark, monkeypatch):
    ten = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    rows = [(1, None), (2, ""), (None, "x " * 9), (3, " \t\n"), (4, "a b " * 5), (4, "a b " * 5), (ten, "p q r s t u v w x y z " * 3), (5, "A a A a A a A a"), (6, "y " * 70_000), (ten, None), (7, "a\x1ca a\x1ca")]
    got = periodic_runs.periodic_runs(frame(spark, rows), periodic_runs.periodic_variant)
    assert got.columns == ["doc_id", "n_words", "runs", "collapsed"]
    found = Counter((r.doc_id, r.n_words, tuple(map(tuple, r.runs)), r.collapsed) for r in got.collect())
    want = Counter()
    for doc_id, text in rows:
        words = periodic_runs.periodic_variant(ref.words(text), doc_id)
        own = ref.runs(words) if len(words) < 1000 else [(0, len(words), 1)]
        gone = {i for s, n, q in own for i in range(s + q, s + n)}
        want[doc_id, len(words), tuple(own), " ".join(w for i, w in enumerate(words) if i not in gone)] += 1
    assert found == want
    assert periodic_runs.periodic_runs(frame(spark, [])).collect() == []
    best = [(5, 8, 2), (1, 12, 3), (1, 4, 1), (0, 4, 1)]
    assert periodic_runs.strongest(best) == (0, 4, 1) and periodic_runs.strongest([]) is None


# -- repeated passages ------------------------------------------------------------------------------

def _left(df):
    rows = df.select("doc_id", F.octet_length("raw").alias("n"), suffix_dedup.removed_bytes(F.col("spans")).alias("r"), F.size("spans").alias("s"), suffix_dedup.kept_digest("raw", "spans").alias("k"))
    return Counter((r.doc_id, r.n, r.r, r.s, r.k) for r in rows.collect())


def _patchwork(seed, alphabet, length):
    rng = random.Random(seed)
    pool = ["".join(rng.choices(alphabet, k=rng.randint(length, 4 * length))) for _ in range(12)]
    texts = []
    for _ in range(60):
        out = ""
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(pool)
            a = rng.randint(0, len(p) // 2)
            part = p[a : rng.randint(a, len(p))] if rng.random() < 0.6 else "".join(rng.choices("qwertyuiopé ", k=rng.randint(0, 300)))
            if rng.random() < 0.3 and part:
                j = rng.randrange(len(part))
                part = part[:j] + "#" + part[j + 1 :]
            out += part
        texts.append(out)
    x = "x" * length
    return [*texts, texts[0], texts[5], None, "", x[:-1], x, x + "x", "y" * length, texts[7] + "z", x * 3]


@pytest.mark.parametrize("seed,alphabet,length", [(0, "ab", 200), (1, "abcdefgh é", 200), (2, "x", 200), (3, "abc ", 90), (4, "日本 語", 200)])
def test_repeats_equal_brute_force(spark, seed, alphabet, length):
    texts = _patchwork(seed, alphabet, length)
    docs = frame(spark, list(enumerate(texts))).repartition(4)
    assert _left(suffix_dedup.repeated_passages(docs, length)) == Counter((i, *w) for i, w in enumerate(ref.without_repeats(texts, length)))


def test_repeats_of_documents(spark):
    docs = {r.doc_id: r.text for r in common.table(spark, SF, "documents").collect()}
    want = dict(zip(docs, ref.without_repeats(list(docs.values()), 200), strict=True))
    rows = queries.op13_suffix_dedup(spark, SF).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == want and any(r.n_removed for r in rows)


def test_repeats_of_odd_rows(spark):
    """Null and repeated ids, copies, and a text that is read in several blocks."""
    rng = random.Random(9)
    noise = "".join(rng.choices("abcdefghij klmn", k=40_000))
    rows = [(None, noise[:500]), (None, noise[:500]), (1, noise[:300]), (1, noise[100:420] + "q"), (2, None), (3, noise), (3, noise), (4, "z" * 30_000)]
    before, suffix_dedup.CHUNK = suffix_dedup.CHUNK, 7_000
    try:
        blocks = list(suffix_dedup.anchors(noise.encode()))
    finally:
        suffix_dedup.CHUNK = before
    starts = [s for _, first, last in blocks for a, b in zip(first.tolist(), last.tolist(), strict=True) for s in range(a, b + 1)]
    assert len(blocks) > 4 and starts == list(range(len(noise) - 199))
    want = Counter((d, *w) for (d, _), w in zip(rows, ref.without_repeats([t for _, t in rows], 200), strict=True))
    assert _left(suffix_dedup.repeated_passages(frame(spark, rows))) == want
    assert suffix_dedup.repeated_passages(frame(spark, [])).collect() == []
    kept = suffix_dedup.repeated_passages(frame(spark, rows)).select(suffix_dedup.without("raw", "spans").alias("left")).collect()
    assert Counter(ref.hashlib.sha256(bytes(r.left)).hexdigest() for r in kept) == Counter(w[4] for w in want.elements())


def test_anchors_depend_on_the_string_only():
    rng = random.Random(6)
    core = "".join(rng.choices("abc def", k=260)).encode()
    places = set()
    for _ in range(20):
        left, right = ("".join(rng.choices("abcxyz ", k=rng.randint(0, 500))).encode() for _ in range(2))
        text = left + core + right
        owner = {s: a for at, first, last in suffix_dedup.anchors(text) for a, f, b in zip(at.tolist(), first.tolist(), last.tolist(), strict=True) for s in range(f, b + 1)}
        places.add(tuple(owner[len(left) + s] - len(left) for s in range(61)))
    assert len(places) == 1
