"""The report data source, tables replaced bucket by bucket, nested actions."""

import os

import pytest
from pyspark.sql import functions as F

from leadspark.operators import actions
from leadspark.sources import report_source as rs
from leadspark.sources import upsert


@pytest.fixture()
def reports(tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "Ads---Conta-A-Conjuntos-de-anúncios-x.csv").write_text('Identificação do conjunto de anúncios,Valor usado (BRL),Extra\n11,"1,234.5",a\n12.0,7,"two\nlines"\n')
    (tmp_path / "deep" / "Ads---Conta-B-Conjuntos-de-anúncios-y.csv").write_text("spend,adset_id,Leads\n3,21,5\n")
    (tmp_path / "Ads---Conta-A-Anúncios-x.csv").write_text("Identificação do anúncio,Valor usado (BRL)\n31,1\n")
    (tmp_path / "Ads---Conta-A-Campanhas-x.csv").write_text("Nome da campanha,Valor usado (BRL)\nOne,1\n")
    (tmp_path / "notes.csv").write_text("a,b\n1,2\n")
    (tmp_path / "Ads---Conta-C-Conjuntos-de-anúncios-z.csv").write_text("")
    return str(tmp_path)


def test_reports_of_different_headings(spark, reports):
    rows = {r.adset_id: r for r in rs.read_reports(spark, reports, "adset").collect()}
    assert {k: (float(r.spend), r._account_name, r.leads_standard) for k, r in rows.items()} == {"11": (1234.5, "Conta A", 0.0), "12": (7.0, "Conta A", 0.0), "21": (3.0, "Conta B", 5.0)}
    assert [r.campaign_name for r in rs.read_reports(spark, reports, "campaign").collect()] == ["One"]
    assert rs.read_reports(spark, reports, "adset", ["nobody"]).collect() == []


def test_filters_choose_files(spark, reports):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    reader = rs.ReportReader(reports, rs.ReportSource({"path": reports}).schema())
    assert len(reader.partitions()) == 4
    kept = list(reader.pushFilters([EqualTo(("kind",), "adset"), In(("_account_name",), ("Conta A", "Conta C")), GreaterThan(("spend",), "1")]))
    assert kept == [GreaterThan(("spend",), "1")]
    assert [(f.kind, f.account) for f in reader.partitions()] == [("adset", "Conta A")]
    rows = rs.read_reports(spark, reports, "adset", ["Conta B"])
    assert rows.rdd.getNumPartitions() == 1 and [r.adset_id for r in rows.collect()] == ["21"]


def _files(path):
    return {d: sorted(f for f in os.listdir(f"{path}/{d}") if f.endswith(".parquet")) for d in os.listdir(path) if d.startswith("bucket=")}


def test_upsert_touches_its_buckets_only(spark, tmp_path):
    path = str(tmp_path / "table")
    rows = spark.range(100).select((F.col("id") % 50).alias("k"), F.col("id").alias("v"))
    upsert.create(rows, path, ["k"], buckets=16)
    before = _files(path)
    new = spark.createDataFrame([(3, 1000), (3, 1001), (777, 5)], "k long, v long")
    assert upsert.upsert(new, path, ["k"], "one")
    after = _files(path)
    touched = {f"bucket={r.b}" for r in new.select(upsert.bucket_of(["k"], 16).alias("b")).collect()}
    assert {d for d in after if before.get(d) != after[d]} == touched
    want = sorted([(r.k, r.v) for r in rows.collect() if r.k != 3] + [(3, 1000), (3, 1001), (777, 5)])
    got = lambda: sorted((r.k, r.v) for r in upsert.read(spark, path).collect())
    assert got() == want
    assert not upsert.upsert(new, path, ["k"], "one") and got() == want and _files(path) == after


def test_upsert_recovers(spark, tmp_path):
    path = str(tmp_path / "table")
    upsert.create(spark.createDataFrame([(1, "a"), (None, "n")], "k long, v string"), path, ["k"], buckets=4)
    upsert.upsert(spark.createDataFrame([(1, "b")], "k long, v string"), path, ["k"], "x", publish=False)
    assert {(r.k, r.v) for r in upsert.read(spark, path).collect()} == {(1, "a"), (None, "n")}
    assert upsert.recover(spark, path) == ["x"] and upsert.recover(spark, path) == []
    os.makedirs(f"{path}-log/staged/half")  # died while staging
    assert upsert.recover(spark, path) == [] and not os.path.exists(f"{path}-log/staged/half")
    upsert.upsert(spark.createDataFrame([(None, "m")], "k long, v string"), path, ["k"], "y")
    upsert.upsert(spark.createDataFrame([], "k long, v string"), path, ["k"], "z")
    assert {(r.k, r.v) for r in upsert.read(spark, path).collect()} == {(1, "b"), (None, "m")}


def test_upsert_of_some_columns(spark, tmp_path):
    path = str(tmp_path / "table")
    upsert.create(spark.createDataFrame([(1, "a", None), (2, "b", 0.5)], "k long, v string, s double"), path, ["k"], buckets=4)
    upsert.upsert(spark.createDataFrame([(1, 0.9), (2, None), (3, 0.1)], "k long, s double"), path, ["k"], "s", replace_all=False)
    assert {tuple(r) for r in upsert.read(spark, path).select("k", "v", "s").collect()} == {(1, "a", 0.9), (2, "b", 0.5), (3, None, 0.1)}


def test_actions_of_odd_payloads(spark):
    texts = [
        '{"campaign_id":"c","adset_id":7,"actions":[{"action_type":"lead","value":"2"},{"action_type":"lead","value":3}]}',
        '{"campaign_id":"c","adset_id":"7","actions":[{"action_type":"offsite_conversion.fb_pixel_custom","value":4},{"action_type":"lead"}]}',
        '{"campaign_id":"d","actions":[{"action_type":"offsite_conversion.fb_pixel_custom","value":4}]}', '{"campaign_id":"e","actions":"none"}', '{"campaign_id":"e"', "[]", None, "",
        '{"campaign_id":"f","adset_id":7,"actions":[{"action_type":"lead","value":"x"}]}',
    ]
    frame = spark.createDataFrame([(t,) for t in texts], "payload string")
    adsets = spark.createDataFrame([("7", "Good"), ("7", "Good"), ("8", None)], "adset_id string, custom_event string")
    names = spark.createDataFrame([("lead",), ("Good",)], "event string")
    events = actions.campaign_events(actions.shredded(frame), adsets, names)
    assert {tuple(r) for r in events.collect()} == {("c", "lead", 5), ("c", "Good", 4), ("d", "lead", 0), ("d", "Good", 0)}
    campaigns = spark.createDataFrame([("c",), ("z",), (None,)], "campaign_id string")
    assert {tuple(r) for r in actions.counter(events, campaigns, "Good").collect()} == {("c", 4), ("z", 0), (None, 0)}
    assert tuple(actions.unreadable(frame).first()) == (9, 1, 2)
