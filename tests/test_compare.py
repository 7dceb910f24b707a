"""Comparison of arms, name repair, imputation, look-ups, skewed keys."""

import random

import pytest
from pyspark.sql import functions as F

from leadspark.config import Settings
from leadspark.operators import compare as cmp
from leadspark.operators import costs, joins, link, metrics
from leadspark.operators import utm as names
from leadspark.sources import sinks

C1, C2 = "120200000000000001", "120200000000001002"
LEAD = "lead_id int, email string, phone string, campaign string, medium string, content string, ml_type string, converted boolean, sale_value double, sale_origin string"


def matched(spark, rows):
    return spark.createDataFrame(rows, LEAD)


def test_repaired_names_equal_brute_force(spark):
    rng = random.Random(3)
    words = ["lookalike", "interesse", "alunos", "programador", "aberto"]
    pool = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 5))) for _ in range(40)]
    missing = [("c1", p.upper() if i % 2 else p[: max(3, len(p) - rng.randint(0, 9))] + "x" * rng.randint(0, 3), i + 1) for i, p in enumerate(pool)]
    adsets = sorted(set(pool))
    got = {r["adset_name"]: r["repaired"] for r in cmp._repaired(
        spark.createDataFrame(missing, "_id15 string, adset_name string, conversions long"),
        spark.createDataFrame([("c1", a) for a in adsets] + [("c2", adsets[0])], "_id15 string, adset_name string"),
    ).filter("_id15 = 'c1'").collect()}
    want: dict[str, int] = {}
    for name in {m[1].lower() for m in missing}:
        hits = []
        for a in adsets:
            n = min(len(name), len(a))
            if name == a.lower():
                hits.append((0, a))
            elif n >= 20 and name[: int(n * 0.7)] == a.lower()[: int(n * 0.7)]:
                hits.append((1, a))
        if hits:
            most = max(m[2] for m in missing if m[1].lower() == name)
            best = min(hits)[1]
            want[best] = max(want.get(best, 0), most)
    assert got == want and want


def test_compare_adsets_and_groups(spark):
    adsets = spark.createDataFrame([
        (C1, "Camp", "1", "Set  A", "COM_ML", 100.0, 10.0), (C1, "Camp", "1", "Set A", "COM_ML", 50.0, 5.0), (C2, "Other", "2", "Set A", "SEM_ML", 30.0, 0.0),
        (C2, "Other", "3", "unused", "SEM_ML", 0.0, 0.0),
    ], "campaign_id string, campaign_name string, adset_id string, adset_name string, ml_type string, spend double, leads_standard double")
    leads = matched(spark, [
        (1, "a@x.co", None, f"n|{C1}", "Set A", None, "COM_ML", True, 300.0, "tmb"), (2, "a@x.co", None, f"n|{C1}", "Set  A", None, "COM_ML", True, 100.0, "guru"),
        (3, "b@x.co", None, f"n|{C2}", "set a", None, "SEM_ML", True, 50.0, "guru"), (4, None, None, "no id", "Set A", None, "SEM_ML", False, 0.0, None),
    ])
    out = cmp.compare_adsets(adsets, leads)
    detail = {r["adset_id"]: r for r in out["detailed"].collect()}
    assert set(detail) == {"1", "2"}
    one, two = detail["1"], detail["2"]
    assert (one["spend"], one["leads"], one["conversions"], one["revenue"]) == (150.0, 15.0, 1, 400.0)
    assert one["revenue_adjusted"] == pytest.approx(300 * 0.6211 + 100)
    # the lower-case name is repaired: conversions move, revenue does not; 0 leads count as 1
    assert (two["conversions"], two["revenue"], two["cpl"], two["comparison_group"]) == (1, 0.0, 30.0, cmp.CONTROL)
    arms = {r["ml_type"]: r for r in out["aggregated"].collect()}
    assert arms["COM_ML"]["names"] == 1 and arms["COM_ML"]["roas"] == pytest.approx(400 / 150)
    groups = spark.createDataFrame([(C1[:15], cmp.EVENTS)], "id15 string, comparison_group string")
    assert cmp.compare_adsets(adsets, leads, groups)["detailed"].count() == 1
    assert [r["roas"] for r in cmp.sorted_report(out["detailed"], {"cpl": "CPL"}).select("roas").collect()] == sorted((one["roas"], two["roas"]), reverse=True)
    report = {r["ml_type"]: r["cpl"] for r in cmp.group_report(out["detailed"], "ml_type").collect()}
    assert report["COM_ML"] == 10.0 and report["SEM_ML"] == 0.0


def test_imputed_leads(spark):
    settings = Settings(impute_lead_ids=(C1,))
    rows = spark.createDataFrame([(C1, 0.0, 52.44), (C2, 0.0, 10.0)], "campaign_id string, leads double, lead_qualified double")
    assert sorted(r["leads"] for r in cmp.impute_adset_leads(rows, settings).collect()) == [0.0, 100.0]
    stats = spark.createDataFrame([(f"x|{C1}", 0.0, 30.0), (f"y|{C2}", 100.0, 50.0), ("none", 7.0, 7.0)], "campaign string, leads double, lead_qualified double")
    got = {r["campaign"]: r["leads"] for r in metrics.impute_leads(stats, settings).collect()}
    assert got == {f"x|{C1}": 60.0, f"y|{C2}": 100.0, "none": 7.0}
    assert metrics.impute_leads(stats).count() == 3


def test_groups_of_leads(spark):
    leads = matched(spark, [
        (1, None, None, f"D | 2025-01-01|{C1}", None, None, "COM_ML", False, 0.0, None), (2, None, None, "D | 2025-12-01|12", None, None, "COM_ML", False, 0.0, None),
        (3, None, None, f"fair|{C2}", None, None, "SEM_ML", False, 0.0, None), (4, None, None, "unfair", None, None, "SEM_ML", False, 0.0, None),
        (5, None, None, "D | x|77", None, None, "COM_ML", False, 0.0, None), (6, None, None, None, None, None, "EXCLUIR", False, 0.0, None),
    ])
    fair = spark.createDataFrame([("fair",)], "campaign_name string")
    goals = spark.createDataFrame([(C1, "Lead")], "campaign_id string, optimization_goal string")
    custom = spark.createDataFrame([("77",)], "campaign_id string")
    got = {r["lead_id"]: r["comparison_group"] for r in cmp.with_comparison_group(leads, fair, goals, custom).collect()}
    assert got == {1: cmp.OPTIMISED, 2: cmp.EVENTS, 3: cmp.CONTROL, 4: cmp.OTHER, 5: cmp.EVENTS, 6: cmp.OTHER}
    groups = spark.createDataFrame([(C1[:15], cmp.OPTIMISED)], "id15 string, comparison_group string")
    got = {r["lead_id"]: r["comparison_group"] for r in cmp.with_refined_group(leads, groups).collect()}
    assert got == {1: cmp.OPTIMISED, 2: cmp.EVENTS, 3: cmp.CONTROL, 4: cmp.CONTROL, 5: cmp.EVENTS, 6: cmp.OTHER}
    arms = spark.createDataFrame([(C1, "COM_ML"), (C2, "SEM_ML")], "campaign_id string, arm string")
    rows = spark.createDataFrame([(C1,), (C2,), ("x",)], "campaign_id string")
    assert cmp.label_arms(rows, arms).count() == 2 and cmp.at_level(rows, arms.filter("arm = 'COM_ML'"), "campaign_id").count() == 1


def test_legacy_instances(spark):
    cols = "adset_name string, campaign_name string, campaign_id string, spend double, leads double"
    legacy = spark.createDataFrame([("Set  A", "L", C2, 10.0, 1.0), ("Set B", "L", C2, 5.0, None)], cols).withColumn("in_events", F.when(F.col("adset_name") == "Set  A", 1).otherwise(0))
    ours = spark.createDataFrame([("Set A", "E", C1, 0.0, 2.0), ("Set Z", "E", C1, 1.0, 1.0)], cols)
    leads = matched(spark, [(1, "a@x.co", None, f"n|{C2}", "Set A", None, "SEM_ML", True, 30.0, "guru"), (2, "a@x.co", None, f"n|{C2}", "Set A", None, "SEM_ML", True, 30.0, "guru")])
    got = sorted((r["comparison_group"], r["conversions"], r["revenue"], r["roas"]) for r in cmp.legacy_instances(legacy, ours, leads).collect())
    assert got == [(cmp.EVENTS, 0, 0.0, 0.0), (cmp.LEGACY, 1, 60.0, 6.0)]


def test_categories_and_names(spark):
    df = spark.createDataFrame([("a",), ("good",), ("new",), ("nan",), (None,)], "medium string")
    mapping = spark.createDataFrame([("a", "A")], "value string, category string")
    valid = spark.createDataFrame([("good",)], "category string")
    assert [r["medium"] for r in names.map_categories(df, "medium", mapping, valid).collect()].count("Outros") == 1
    got = {r["medium"] for r in names.unify_medium(df, mapping, valid).collect()}
    assert got == {"A", "good", "Outros", None}
    ids = spark.createDataFrame([("12345678901",), ("plain",)], "campaign string")
    dim = spark.createDataFrame([("12345678901", "Named")], "campaign_id string, campaign_name string")
    assert {r["campaign"] for r in names.name_ids(ids, dim).collect()} == {"Named", "plain"}
    cut = spark.createDataFrame([("Camp A long|120200000000000001",), ("Camp|120200000000000",), ("Camp A long",), ("alone",), (None,)], "campaign string")
    got = {r["campaign"]: r["campaign_consolidated"] for r in names.consolidate_campaigns(cut).collect()}
    full = "Camp A long|120200000000000001"
    assert got == {full: full, "Camp|120200000000000": full, "Camp A long": full, "alone": "alone", None: None}


def test_same_campaign(spark):
    df = spark.createDataFrame([("Camp One", "camp one|77", 0.0), ("Camp One", "camp onee", 0.94), ("x", "y", 0.1)], "n string, u string, r double")
    assert [r[0] for r in df.select(costs.same_campaign(F.col("n"), F.col("u"), F.col("r"))).collect()] == [True, True, False]


def test_lookup_keeps_every_row_under_skew(spark):
    """A third of the rows share one key, a third have none; nothing is lost or repeated."""
    n = 30_000
    df = spark.range(n).select(
        F.col("id").alias("lead_id"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.col("id").cast("string")).alias("k"))
    table = spark.createDataFrame([("hot", 1), ("1", 2), ("4", 3), (None, 9)], "k string, v int")
    out = joins.left_lookup(df, table, "k").cache()
    assert out.count() == n and out.select("lead_id").distinct().count() == n
    assert {r["v"]: r["count"] for r in out.groupBy("v").count().collect()} == {1: n // 3, 2: 1, 3: 1, None: n - n // 3 - 2}


def test_first_sale_prefers_email_and_order(spark):
    leads = spark.createDataFrame([(1, "a@x.co", "11"), (2, None, "11"), (3, "z@x.co", None), (4, None, None)], "lead_id int, email string, phone string").withColumn(
        "captured_at", F.lit("2025-01-01").cast("timestamp_ntz"))
    sales = spark.createDataFrame([("a@x.co", "11", 5.0, "2025-02-02", "tmb"), ("a@x.co", None, 9.0, "2025-02-01", "guru"), ("a@x.co", None, 8.0, "2025-02-01", "tmb"), ("q@x.co", "11", 1.0, "2025-01-15", "guru")],
                                  "email string, phone string, sale_value double, sale_date string, sale_origin string").withColumn("sale_date", F.to_date("sale_date"))
    got = {r["lead_id"]: (r["match_method"], r["sale_value"]) for r in link.attribute_sales(leads, sales).collect()}
    assert got == {1: ("email", 8.0), 2: ("telefone", 1.0), 3: (None, 0.0), 4: (None, 0.0)}
    undated = link.attribute_sales(leads.withColumn("captured_at", F.lit(None).cast("timestamp_ntz")), sales)
    assert undated.filter("converted").count() == 0


def test_report_tables(spark):
    leads = matched(spark, [(1, "a@x.co", "11", f"n|{C1}", "m", "c", "COM_ML", True, 30.0, "guru"), (2, "b@x.co", None, f"n|{C1}", "m", "c", "SEM_ML", False, 0.0, None)]).withColumns({
        "captured_at": F.lit("2025-01-01").cast("timestamp_ntz"), "decile": F.lit(5), "sale_date": F.lit("2025-01-03").cast("date"), "match_method": F.lit("email"), "comparison_group": F.lit(cmp.EVENTS)})
    cost = spark.createDataFrame([(C1, "n", 10.0, 2.0)], "campaign_id string, campaign_name string, spend double, leads double")
    sales = leads.filter("converted").select("email", "phone", "sale_value", "sale_date", "sale_origin")
    out = sinks.report_tables(leads, sales, metrics.campaign_metrics(leads, cost))
    assert {"overall", "campaigns", "buyers", "deciles", "groups", "ml_comparison", "matching", "adjusted"} <= set(out)
    row = out["overall"].first()
    assert (row["total_leads"], row["total_conversions"], row["total_spend"], row["roas"]) == (2, 1, 20.0, 1.5)
    assert out["buyers"].first()["tracked"] is True and out["groups"].first()["conversions"] == 1
    assert out["cumulative_revenue"].first()["cumulative_pct"] == 100.0
