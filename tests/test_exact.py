"""Distributed exact algorithms against brute force on small data."""

import random
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from leadspark.config import Settings
from leadspark.operators import components, controls, costs, deciles, fuzzy, link, quantiles, splits


@pytest.mark.parametrize("accuracy", [20, 10_000])
@pytest.mark.parametrize("kind", ["ties", "spread", "hot"])
def test_quantiles_equal_numpy(spark, monkeypatch, accuracy, kind):
    monkeypatch.setattr(quantiles, "ACCURACY", accuracy)
    rng = np.random.default_rng(5)
    values = {
        "ties": rng.integers(0, 40, 1003) / 40, "spread": rng.random(1003),
        "hot": np.where(rng.random(1003) < 0.4, 0.25, rng.random(1003)),
    }[kind]
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "x double")
    probs = [k / 10 for k in range(11)]
    got = quantiles.exact_quantiles(df, "x", probs)
    assert got == pytest.approx(list(np.quantile(values, probs)), abs=1e-12)


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert quantiles.exact_quantiles(df, "x", [0.5]) == []
    assert deciles.qcut_edges(df, "x") == []


@pytest.mark.parametrize("step", [0.001, 0.05, 0.3])
def test_qcut_equals_pandas(spark, step):
    rng = np.random.default_rng(7)
    scores = np.round(rng.random(1003) / step) * step
    df = spark.createDataFrame([(i, float(s)) for i, s in enumerate(scores)], "i int, lead_score double")
    got = [r["decile"] for r in deciles.with_qcut(df).orderBy("i").collect()]
    want = pd.qcut(scores, 10, labels=False, duplicates="drop") + 1
    assert got == list(want)


def test_running_totals_and_auc(spark):
    rng = np.random.default_rng(3)
    score = np.round(rng.random(2000), 2)
    y = (rng.random(2000) < score).astype(int)
    df = spark.createDataFrame([(float(s), int(t)) for s, t in zip(score, y)], "lead_score double, target int")
    t = quantiles.running_totals(df, "lead_score", {"n": "1"}).orderBy("lead_score").toPandas()
    assert list(t["n_before"]) == list(t["n"].cumsum() - t["n"])
    ranks = pd.Series(score).rank()
    p, q = y.sum(), (1 - y).sum()
    want = (ranks[y == 1].sum() - p * (p + 1) / 2) / (p * q)
    assert deciles.auc(df).first()["auc"] == pytest.approx(want, abs=1e-12)


WORDS = ["aberto", "interesse", "lookalike", "1%", "alunos", "programa", "video", "x", "pg2", "frio"]


@pytest.mark.parametrize("threshold", [0.75, 0.85])
def test_similar_pairs_equal_brute_force(spark, threshold):
    rng = random.Random(11)

    def name():
        return " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 6)))

    def altered(s):
        s = list(s)
        for _ in range(rng.randint(0, 5)):
            i = rng.randrange(len(s) + 1)
            if rng.random() < 0.5 and i < len(s):
                del s[i]
            else:
                s.insert(i, rng.choice("abc 12"))
        return "".join(s)

    right = sorted({name() for _ in range(60)} | {"a", "ab", "abc", "abcd"})
    left = sorted({altered(rng.choice(right)) for _ in range(120)} | {"a", "b", "abd"} - {""})
    a = spark.createDataFrame([(s,) for s in left] + [(None,)], "v string")
    b = spark.createDataFrame([(s,) for s in right], "w string")
    got = {(r["left"], r["right"], round(r["ratio"], 9)) for r in fuzzy.similar_pairs(a, b, "v", "w", threshold).collect()}
    want = set()
    for x in left:
        for y in right:
            ratio = SequenceMatcher(None, x, y).ratio()
            if ratio >= threshold and x and y:
                want.add((x, y, round(ratio, 9)))
    assert got == want


def test_similar_pairs_within_groups(spark):
    a = spark.createDataFrame([("1", "audience one"), ("2", "audience one")], "g string, v string")
    b = spark.createDataFrame([("1", "audience onee"), ("3", "audience one")], "g string, w string")
    got = fuzzy.similar_pairs(a, b, "v", "w", 0.85, within="g").collect()
    assert [(r["g"], r["left"], r["right"]) for r in got] == [("1", "audience one", "audience onee")]


def _ads(spark):
    rows = [
        ("120200000000000001", "Camp One", "s1", "Audience Alpha", "100000000001", "Video red car", 10.0),
        ("120200000000000001", "Camp One", "s2", "Audience Beta", "100000000002", "Video blue car", 20.0),
        ("120200000000000002", "Camp Two", "s3", "Audience Alpha", "100000000003", "Video red car", 40.0),
    ]
    return spark.createDataFrame(rows, "campaign_id string, campaign_name string, adset_id string, adset_name string, ad_id string, ad_name string, spend double")


def test_spend_of_ad_values(spark):
    values = spark.createDataFrame([("x|100000000003",), ("VIDEO RED CAR",), ("Video blue carr",), ("unrelated",), ("100000000002",)], "value string")
    got = {r["value"]: (r["spend"], r["matched_by"]) for r in costs.spend_of_ad_values(values, _ads(spark)).collect()}
    assert got == {
        "x|100000000003": (40.0, "id"), "VIDEO RED CAR": (10.0, "name"), "Video blue carr": (20.0, "similar"),
        "unrelated": (0.0, None), "100000000002": (20.0, "id"),
    }


def test_spend_of_campaign_values(spark):
    tail = "|120200000000000001"
    values = spark.createDataFrame([
        (f"A | B | C | FASE 1 | audience beta | PG1 | 2025-01-01{tail}",), (f"A | B | C | FASE 1 | Audience Alphaa | PG1{tail}",),
        (f"A | B | C | FASE 1 | something else | PG1{tail}",), ("A | B|120200000000000009",),
    ], "value string")
    got = sorted((r["spend"], r["matched_by"] or "") for r in costs.spend_of_campaign_values(values, _ads(spark)).collect())
    assert got == [(0.0, ""), (10.0, "adset"), (20.0, "adset"), (30.0, "campaign")]


def test_spend_of_values(spark):
    values = spark.createDataFrame([("120200000000000001",), ("Camp Two",), ("camp onee|77",), ("zzz",)], "value string")
    got = {r["value"]: (r["spend"], r["matched_by"]) for r in costs.spend_of_values(values, _ads(spark), "campaign").collect()}
    assert got == {"120200000000000001": (30.0, "id"), "Camp Two": (40.0, "name"), "camp onee|77": (30.0, "similar"), "zzz": (0.0, None)}


def test_temporal_attribution_equals_brute_force(spark):
    rng = random.Random(2)
    base = pd.Timestamp("2024-01-01")
    leads = [(i, rng.choice(["a@x.co", "b@x.co", None]), rng.choice(["1", "2", None]), base + pd.Timedelta(hours=rng.randint(0, 200))) for i in range(80)]
    leads.append((99, "a@x.co", "1", None))
    sales = [(rng.choice(["a@x.co", "b@x.co", "c@x.co"]), rng.choice(["1", "2", "3"]), float(rng.randint(1, 9)), base + pd.Timedelta(hours=rng.randint(0, 220)), "guru") for _ in range(40)]
    L = spark.createDataFrame([(i, e, p, None if t is None else t.to_pydatetime()) for i, e, p, t in leads], "lead_id int, email string, phone string, captured_at timestamp_ntz")
    S = spark.createDataFrame([(e, p, v, d.to_pydatetime(), o) for e, p, v, d, o in sales], "email string, phone string, sale_value double, sale_date timestamp_ntz, sale_origin string")
    got = {r["lead_id"]: (r["match_method"], r["sale_date"], r["sale_value"]) for r in link.attribute_sales(L, S, temporal=True).collect()}
    assert len(got) == len(leads)
    for i, e, p, t in leads:
        want = (None, None, 0.0)
        for method, k, at in (("email", e, 0), ("telefone", p, 1)):
            if t is None or k is None:
                continue
            ok = sorted((s[3], s[2]) for s in sales if s[at] == k and s[3] >= t)
            if ok:
                want = (method, ok[0][0].to_pydatetime(), ok[0][1])
                break
        assert got[i] == want


def test_components_equal_union_find(spark):
    rng = random.Random(4)
    leads = [(i, rng.choice([None, *[f"e{k}" for k in range(25)]]), rng.choice([None, *[f"p{k}" for k in range(25)]])) for i in range(60)]
    leads += [(100 + i, f"chain{i}", f"link{i}") for i in range(20)] + [(200 + i, f"chain{i + 1}", f"link{i}") for i in range(20)]
    df = spark.createDataFrame(leads, "lead_id int, email string, phone string")
    got = components.person_components(df)
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for i, e, p in leads:
        for k in (("e", e), ("p", p)):
            if k[1]:
                parent[find(("i", i))] = find(k)
    want, seen = {}, {}
    for i, e, p in leads:
        want.setdefault(find(("i", i)), set()).add(i)
    for r in got.collect():
        seen.setdefault(r["person"], set()).add(r["lead_id"])
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, seen.values()))
    sizes = {r["size"]: r["persons"] for r in components.component_sizes(got).collect()}
    assert sum(k * v for k, v in sizes.items()) == len(leads)


def test_fair_controls_equal_brute_force(spark):
    rng = random.Random(6)
    sets = {k: set(rng.sample(range(30), rng.randint(15, 28))) for k in range(24)}
    budgets = {k: float(rng.randint(50, 150)) for k in sets}
    owned = spark.createDataFrame([(k, c) for k, s in sets.items() for c in s], "campaign_id int, creative_id int")
    meta = spark.createDataFrame(list(budgets.items()), "campaign_id int, budget double")
    got = {
        (r["campaign_id"], r["control_id"], r["overlap"])
        for r in controls.fair_controls(meta.filter("campaign_id < 8"), meta.filter("campaign_id >= 8"), owned, Settings(creative_overlap=0.7)).collect()
    }
    want = set()
    for t in range(8):
        for c in range(8, 24):
            n = len(sets[t] & sets[c])
            if abs(budgets[t] - budgets[c]) / budgets[t] <= 0.3 and min(n / len(sets[t]), n / len(sets[c])) >= 0.7:
                want.add((t, c, n))
    assert got == want and want


def test_best_controls_equal_full_search(spark):
    """Every k, with campaigns that leave at each level or never, equal scores and equally used creatives."""
    rng = random.Random(8)
    base = {b: set(rng.sample(range(200), 40)) for b in range(4)}
    sets, budgets = {}, {}
    for c in range(60):
        own = sorted(base[c % 4])
        sets[c] = set(own[rng.choice((0, 0, 1, 3, 6)):]) if c != 59 else {999}
        budgets[c] = float(rng.choice((100, 100, 101, 108, 125)))
    owned = spark.createDataFrame([(k, c) for k, s in sets.items() for c in s], "campaign_id int, creative_id int")
    meta = spark.createDataFrame(list(budgets.items()), "campaign_id int, budget double")
    treated, others = meta.filter("campaign_id < 20 OR campaign_id = 59"), meta.filter("campaign_id BETWEEN 20 AND 58")
    full = {}
    for r in controls.fair_controls(treated, others, owned, Settings()).collect():
        full.setdefault(r["campaign_id"], []).append((-r["score"], r["control_id"]))
    assert sorted(full) == list(range(20))
    for k in (1, 3, 1000):
        got = {}
        for r in controls.best_controls(treated, others, owned, k, Settings()).collect():
            got.setdefault(r["campaign_id"], []).append((r["rank"], -r["score"], r["control_id"]))
        assert {c: [row[1:] for row in sorted(rows)] for c, rows in got.items()} == {c: sorted(rows)[:k] for c, rows in full.items()}
    assert controls.best_controls(treated.limit(0), others, owned, 2, Settings()).collect() == []


def test_split_by_leads_with_ties(spark):
    rows = [(i, pd.Timestamp("2024-01-01") + pd.Timedelta(days=d)) for i, d in enumerate([0] * 5 + [1] * 10 + [2] * 5)]
    df = spark.createDataFrame([(i, t.to_pydatetime()) for i, t in rows], "lead_id int, captured_at timestamp_ntz")
    got = {r["lead_id"] for r in splits.split_by_leads(df).filter("split = 'train'").collect()}
    assert got == set(range(14))


def test_split_by_person_keeps_persons_together(spark):
    rng = random.Random(9)
    rows = [(i, f"e{rng.randint(0, 60)}", f"p{rng.randint(0, 200)}", int(rng.random() < 0.2)) for i in range(300)]
    df = spark.createDataFrame(rows, "lead_id int, email string, phone string, target int")
    out = splits.split_by_person(df)
    assert out.count() == 300
    for key in ("email", "phone"):
        assert out.groupBy(key).agg(F.count_distinct("split").alias("n")).filter("n > 1").count() == 0
    assert {r["split"] for r in splits.split_report(out).collect()} <= {"train", "test"}


@pytest.mark.parametrize("names_first", [False, True])
def test_best_matches_are_the_best_of_all_pairs(spark, names_first):
    import difflib
    import random

    rng = random.Random(11)
    base = [f"demo | cap | {w} | {n:04d}" for w in ("frio", "quente", "morno") for n in rng.sample(range(10000), 15)] + ["a", "ab", "xyz"]
    altered = [b for b in base[:6]] + [b.replace("0", "1", 1) for b in base] + [b[:-1] for b in base] + [b + " v2" for b in base] + ["nothing like it at all", ""]
    names = spark.createDataFrame([(g, n) for g in ("x", "y") for n in base[: 30 if g == "x" else None]], "g string, n string")
    values = spark.createDataFrame([(g, v) for g in ("x", "y") for v in altered] + [("x", None)], "g string, v string")
    got: dict = {}
    for r in fuzzy.best_matches(values, names, "v", "n", 0.8, "g", names_first, (0.95, 0.9)).collect():
        got.setdefault((r.g, r.value), set()).add((r.name, round(r.ratio, 9)))
    want: dict = {}
    for g in ("x", "y"):
        for v in set(altered):
            scored = [(round(difflib.SequenceMatcher(None, *((n, v) if names_first else (v, n))).ratio(), 9), n) for n in base[: 30 if g == "x" else None]]
            top = max(s for s, _ in scored)
            if top >= 0.8:
                want[g, v] = {(n, s) for s, n in scored if s == top}
    assert got == want


def _counted(spark, df):
    """``df`` and the number of rows that have been taken from it so far."""
    seen = spark.sparkContext.accumulator(0)

    def count(parts):
        for part in parts:
            seen.add(len(part))
            yield part

    return df.mapInPandas(count, df.schema), seen


def test_similar_names_read_their_sources_once(spark):
    names, seen = _counted(spark, spark.createDataFrame([(f"campaign number {n:03d}",) for n in range(40)], "n string"))
    values, asked = _counted(spark, spark.createDataFrame([(f"campaign numbr {n:03d}",) for n in range(20)] + [("nothing",)], "v string"))
    assert fuzzy.best_matches(values, names, "v", "n", 0.8).count() >= 20
    assert (seen.value, asked.value) == (40, 21)


def test_best_controls_of_equal_campaigns_are_searched_once(spark, monkeypatch):
    """400 treated campaigns and 400 controls of two budgets and one set of creatives are two classes each."""
    owned = spark.range(800).selectExpr("CAST(id AS INT) AS campaign_id", "explode(sequence(1, 5)) AS creative_id")
    meta = spark.range(800).selectExpr("CAST(id AS INT) AS campaign_id", "CAST(100 + id % 4 DIV 2 AS DOUBLE) AS budget")
    full, sizes = controls.fair_controls, []

    def watched(treated, others, creatives, settings):
        sizes.append((treated.count(), others.count()))
        return full(treated, others, creatives, settings)

    monkeypatch.setattr(controls, "fair_controls", watched)
    rows = controls.best_controls(meta.filter("campaign_id % 2 = 0"), meta.filter("campaign_id % 2 = 1"), owned, 2, Settings()).collect()
    assert max(sizes) == (2, 2)
    assert sorted((r.campaign_id, r.rank, r.control_id) for r in rows) == sorted((c, k + 1, c % 4 + 1 + 4 * k) for c in range(0, 800, 2) for k in range(2))
