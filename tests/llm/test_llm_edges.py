"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names."""

import os
import random
import sys
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(__file__))))

import corpus_pipeline  # noqa: E402
import llm_reference as ref  # noqa: E402
import public_tokenizers  # noqa: E402

from leadspark.llm import chat_format, common, exact_dedup, mixing, packing, ppm, quality, secrets, simhash, token_files, url_filter  # noqa: E402

PROSE = " ".join(f"word{i % 61}x and then the {i % 17} of it." for i in range(40))
#: Names that the operators use themselves.
CLASH = ("kept", "size", "k_id", "k_hash", "row", "name", "fp", "copies", "again", "p", "group", "at", "ids", "start", "place", "component_id", "spans")
ROWS = [
    (1, PROSE, "en", "a"), (2, PROSE, "en", "b"), (2, PROSE, "en", "b"), (3, None, None, None), (4, "", "de", "a"), (None, PROSE.upper(), "en", None),
    (None, None, None, None), (5, " \n\t ", "xx", "é"), (6, "one", "fr", "a"), (7, PROSE + " tail", "en", "a"), (8, "verylong " * 60_000, "en", "b"),
    (9, "x" * 300_000, "es", "c"), (2, "another text of the same id " + PROSE, "en", "b"), (10, "\u0000퟿\U0001f600 </s> \\", "en", "a"),
]


def frame(spark, rows):
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return docs.withColumns({c: F.lit(f"own {c}") for c in CLASH})


@pytest.fixture(scope="module")
def docs(spark):
    return frame(common.ready(spark), ROWS)


@pytest.fixture(scope="module")
def empty(spark):
    return frame(common.ready(spark), []).filter("false")


BPE = public_tokenizers.path("byte_bpe_50k.json")
#: Operators that answer for each row of the input.
PER_ROW = {
    "secrets": lambda d: secrets.find_secrets(d, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN),
    "scores": ppm.score_documents,
    "quality": quality.judged,
    "near": simhash.near_groups, "similar": lambda docs: simhash.near_groups(docs, 0.8),
    "exact": exact_dedup.exact_groups,
    "urls": lambda d: url_filter.url_verdicts(d.withColumnRenamed("doc_id", "page_id").withColumnRenamed("text", "url"), url_filter.rule_table(d.sparkSession)),
}


@pytest.mark.parametrize("name", sorted(PER_ROW))
def test_one_answer_per_row(docs, empty, name):
    got = PER_ROW[name](docs).collect()
    key = "page_id" if name == "urls" else "doc_id"
    assert Counter(r[key] for r in got) == Counter(r[0] for r in ROWS)
    nothing = PER_ROW[name](empty)
    assert nothing.collect() == [] and nothing.columns == PER_ROW[name](docs).columns


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES[:-1]])
def test_stages_keep_columns(spark, docs, empty, stage):
    got = stage(spark, docs, "")
    assert got.columns == docs.columns and got.schema.simpleString() == docs.schema.simpleString()
    rows = got.collect()
    assert set(map(tuple, rows)) <= set(map(tuple, docs.collect()))
    assert stage(spark, empty, "").collect() == []


def test_exact_ties(docs):
    groups = exact_dedup.exact_groups(docs).collect()
    prose = [r for r in groups if r.text_sha256 == ref.sha(PROSE.lower())]
    assert len(prose) == 4 and sum(r.kept for r in prose) == 1 and {(r.keep_id, r.group_size) for r in prose} == {(2, 4)}
    blank = [r for r in groups if r.text_sha256 == ref.sha("")]
    assert {(r.doc_id, r.keep_id, r.kept) for r in blank} == {(3, 4, False), (4, 4, True), (None, 4, False)}
    left = exact_dedup.exact_dedup(docs).collect()
    assert Counter(r.doc_id for r in left) == Counter([2, 2, 4, 5, 6, 7, 8, 9, 10])


def test_only_null_ids(spark):
    rows = [(None, "same", "en", "a")] * 3 + [(None, "other", "en", "a")]
    docs = frame(spark, rows)
    assert sorted(r.text for r in exact_dedup.exact_dedup(docs).collect()) == ["other", "same"]
    assert sum(r.kept for r in exact_dedup.exact_groups(docs).collect()) == 2
    assert len(simhash.near_dedup(docs).collect()) == 2


def test_near_dedup_by_component(spark):
    """An id of two distant texts does not join their components, and a component of null ids keeps one row."""
    words = [f"w{i * i}" for i in range(300)]
    text, near = " ".join(words), [" ".join([*words[:-1], f"other{i}"]) for i in range(50)]
    apart = [(simhash.fingerprint(text) ^ simhash.fingerprint(t)).bit_count() for t in near]
    other = next(t for t, d in zip(near, apart, strict=True) if 0 < d <= simhash.LINK_BITS)
    distant = " ".join(f"v{i * 7}" for i in range(300))
    got = simhash.near_dedup(frame(spark, [(1, text, "en", "a"), (1, distant, "en", "a"), (2, other, "en", "a")])).collect()
    assert [r.doc_id for r in got] == [1, 1] and {r.text for r in got} == {text, distant}
    got = simhash.near_dedup(frame(spark, [(None, text, "en", "a"), (None, other, "en", "a"), (None, distant, "en", "a")])).collect()
    assert len(got) == 2 and distant in {r.text for r in got}


def test_quality_keeps_repeats(spark):
    rng = random.Random(4)
    syllables = ("the", "an", "re", "tion", "in", "er", "ou")
    text = lambda: " ".join("".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(120))
    rows = [(i, text(), "en", "a") for i in range(30)] * 2
    assert quality.quality_filter(frame(spark, rows)).count() == 60


def test_mixing_repeats(docs):
    decisions = mixing.with_copies(docs, mixing.mixed(docs).withColumnRenamed("copies", "times"), "times").collect()
    assert len(decisions) == len(ROWS) and all(0 <= r.times <= 2 for r in decisions)
    assert len({r.times for r in decisions if r.doc_id == 2 and r.text == PROSE}) == 1
    assert all(r.times == 0 for r in decisions if not ref.words(r.text))
    assert mixing.mix(docs).count() == sum(r.times for r in decisions)


def test_a_table_without_source_or_lang(spark):
    docs = spark.createDataFrame([(1, PROSE), (2, None)], "doc_id long, text string")
    assert mixing.mix(docs).columns == ["doc_id", "text"] and quality.quality_filter(docs).columns == ["doc_id", "text"]


def test_packing_edges(docs, empty):
    rows = packing.pack(docs, BPE).collect()
    assert sum(r.start == 0 for r in rows) == len(ROWS) and packing.pack(empty, BPE).collect() == []
    assert sum(r.length for r in rows if r.start == 0 and r.doc_tokens == 1) == 3
    masked = packing.pack(docs.withColumn("from", F.lit(10)), BPE, loss_from="from").collect()
    assert sum(r.loss_tokens for r in masked) == sum(max(0, r.doc_tokens - 10) for r in masked if r.start == 0)


def test_token_file_edges(spark, docs, empty, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    for name, frame_, n in (("full", docs, len(ROWS)), ("empty", empty, 0)):
        token_files.write_ids(frame_, str(tmp_path / name), path, 2)
        rows = token_files.with_starts(token_files.read_ids(spark, str(tmp_path / name))).collect()
        assert len(rows) == n
        at = 0
        for r in sorted(rows, key=lambda r: r.start):
            assert r.start == at and r.ids[-1] == 2
            at += len(r.ids)
        ids = [r.doc_id for r in sorted(rows, key=lambda r: r.start)]
        assert ids == sorted(ids, key=lambda i: (i is not None, i))


def test_chat_edges(spark):
    schema = "conv_id long, turn long, role string, text string, formatted string, merged int"
    rows = [(None, 1, "user", "a", "", 1), (None, 1, "user", "a", "", 1), (7, None, None, None, None, None)]
    got = {r.conv_id: r for r in chat_format.format_chats(spark.createDataFrame(rows, schema)).collect()}
    assert got[None].formatted == "[INST]user[/INST]a<sep>a</s>" and got[7].formatted == "[INST][/INST]</s>" and list(got[7].loss_spans) == []
    assert chat_format.format_chats(spark.createDataFrame([], schema)).collect() == []


def test_pipeline_against_plain_version(spark):
    """Each stage against its definition, on what the stage before it kept."""
    sf = "/root/testdata/sf0.001"
    docs = common.table(spark, sf, "documents")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        path = common.folder(spark, "test-stage")
        stage(spark, docs, sf).write.parquet(path)
        out = spark.read.parquet(path)
        kept[name] = (docs.collect(), out.collect())
        docs = out
    before, after = kept["quality rules"]
    verdict = {r.doc_id: r.kept for r in quality.judged(common.table(spark, sf, "documents")).collect()}
    assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in before if verdict[r.doc_id])
    assert all(ref.statistics(r.text)[0] >= 50 for r in after)
    before, after = kept["exact dedup"]
    best = {}
    for r in before:
        text = r.text.translate(ref.LOWER)
        best[text] = max(best.get(text, -1), r.doc_id)
    assert sorted(r.doc_id for r in after) == sorted(best.values())
    before, after = kept["near dedup"]
    keys = lambda fp: set(simhash.golay_keys(np.array([fp], np.uint64))[1].tolist())
    groups = ref.similar_components({r.doc_id: r.text for r in before}, simhash.link_bits(corpus_pipeline.SIMILARITY), keys)
    assert {r.doc_id for r in after} == set(groups.values())
    before, after = kept["source mix"]
    times, size, source = Counter(r.doc_id for r in after), {r.doc_id: len(ref.words(r.text)) for r in before}, {r.doc_id: r.source for r in before}
    total, taken = Counter(), Counter()
    for i, n in size.items():
        total[source[i]] += n
        taken[source[i]] += n * times[i]
    want = ref.targets(dict(total))
    assert max(times.values()) <= 2 and set(map(tuple, after)) <= set(map(tuple, before))
    for s in total:
        assert abs(taken[s] - want[s]) <= max(n for i, n in size.items() if source[i] == s)
    before, after = kept["packing"]
    assert Counter(r.doc_id for r in after if r.start == 0) == Counter(r.doc_id for r in before)
    assert sum(r.length for r in after) == sum(r.doc_tokens for r in after if r.start == 0)
    assert Counter(map(tuple, after)) == Counter(map(tuple, corpus_pipeline.run(spark, sf).collect()))


def test_near_dedup_links_all_similar_texts(spark):
    """Every pair of similarity 0.8 or more is linked, also where no keys of the fingerprints meet."""
    rng = random.Random(11)
    texts, passage = {}, [f"p{i}" for i in range(60)]
    for group in range(60):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice((60, 200, 300)))] + passage * (group % 3)
        for copy in range(3):
            w = list(base)
            for place in rng.sample(range(len(w)), rng.choice((0, 1, 2, 4, 6, 9))):
                w[place] = rng.choice(("edited", w[place].upper(), f"x{place}"))
            texts[len(texts)] = " ".join(w[: len(w) - rng.choice((0, 0, 20))])
    texts |= {1000: "", 1001: " \n", 1002: "one two", 1003: "One  two", 1004: "one two three", 1005: " ".join(passage)}
    split = {i: ref.words(t.translate(ref.LOWER)) for i, t in texts.items()}
    sets = {i: {tuple(w[j : j + 5]) for j in range(max(len(w) - 4, 1))} for i, w in split.items()}
    ids = sorted(texts)
    alike = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8]
    keys = lambda fp: set(simhash.golay_keys(np.array([fp], np.uint64))[1].tolist())
    found = ref.similar_components(texts, simhash.link_bits(0.8), keys)
    want = ref.components(ids, alike + list(found.items()))
    assert len(set(want.values())) < len(set(found.values()))
    docs = frame(spark, [(i, t, "en", "a") for i, t in texts.items()])
    assert sorted(r.doc_id for r in simhash.near_dedup(docs, 0.8).collect()) == sorted(set(want.values()))
