"""Joins of tables that grow after Spark has sized them: none may be a broadcast."""

import pytest

from leadspark.llm import exact_dedup, similar_sets, simhash


def joins_of(monkeypatch, module):
    """The first and last plan of everything that ``module`` writes, by its label."""
    plans, write = {}, module.saved

    def seen(df, label):
        df.collect()
        plans.setdefault(label, []).append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, label)

    monkeypatch.setattr(module, "saved", seen)
    return plans


@pytest.mark.parametrize("similarity", [None, 0.8])
def test_keys_of_fingerprints_are_not_broadcast(spark, monkeypatch, similarity):
    words = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(i, " ".join(words[:30] + [f"x{i}"] * (i % 3) + words[i:])) for i in range(30)], "doc_id long, text string")
    plans = joins_of(monkeypatch, simhash)
    assert simhash.near_groups(docs, similarity).count() == 30
    for label in ("near-links", "near-across"):
        assert "SortMergeJoin" in plans[label][0] and "BroadcastHashJoin" not in plans[label][0]


def test_blocks_of_texts_are_not_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"{i % 3} " * 9000) for i in range(6)], "doc_id long, text string")
    plans = joins_of(monkeypatch, exact_dedup)
    assert exact_dedup.exact_dedup(docs).count() == 3
    assert "SortMergeJoin" in plans["names"][0] and "BroadcastHashJoin" not in plans["names"][0]


def test_keys_and_sets_of_shingles_are_not_broadcast(spark, monkeypatch):
    words = [f"w{i}" for i in range(60)]
    texts = spark.createDataFrame([(i, " ".join([*words, f"x{i}"])) for i in range(12)], "node long, text string")
    plans = joins_of(monkeypatch, similar_sets)
    links = similar_sets.class_links(texts, texts.selectExpr("node", "node AS class"), 0.8)
    assert {c for link in links.collect() for c in link} == set(range(12))
    short, _, across = plans["similar-met"][:3]
    for plan in (short, across, plans["similar-links"][0]):
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
