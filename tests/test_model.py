"""Encoding, model, conversion events and streams."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadspark.config import Settings
from leadspark.operators import deciles as dec
from leadspark.operators import encode, events, features, model
from leadspark.sources.tables import read_table
from leadspark.streaming import jobs

AGE, PAY = "Qual a sua idade?", "Atualmente, qual a sua faixa salarial?"


def raw_leads(spark, n=400, seed=1):
    rng = np.random.default_rng(seed)
    ages = encode.ORDINALS[AGE]
    rows = []
    for i in range(n):
        a = int(rng.integers(0, 6))
        y = int(rng.random() < 0.1 + 0.13 * a)
        rows.append((
            f"r{i}", f"2025-10-{i % 28 + 1:02d} 10:00:00", f"Nome {i}" if i % 3 else "Nome", f"u{i}@x.co" if i % 5 else "bad", "11999887766" if i % 4 else "1",
            ages[a], encode.ORDINALS[PAY][int(rng.integers(0, 5))], "facebook-ads" if i % 2 else "fb", "ADV | Open", "ig" if i % 2 else None, "SIM" if i % 2 else "não", "x|1", "junk", y,
        ))
    names = ["row_id", "Data", "Nome Completo", "E-mail", "Telefone", AGE, PAY, "Source", "Medium", "Term", "Tem computador/notebook?", "Campaign", "Page URL"]
    return spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in names) + ", target int")


def test_features(spark):
    df = spark.createDataFrame([("2025-10-06", None, "a@b.co", None), ("x", "Ana B", None, "11999887766")], "`Data` string, `Nome Completo` string, `E-mail` string, Telefone string")
    got = [r.asDict() for r in features.derive_features(df).collect()]
    assert got[0] == {"dia_semana": 0, "nome_comprimento": 3, "nome_tem_sobrenome": False, "nome_valido": False, "email_valido": True, "telefone_valido": False, "telefone_comprimento": 4}
    assert (got[1]["dia_semana"], got[1]["nome_tem_sobrenome"], got[1]["telefone_comprimento"]) == (None, True, 11)
    plain = features.derive_features(df, legacy_null_lengths=False, keep_raw=True).first()
    assert plain["nome_comprimento"] is None and plain["Data"] == "2025-10-06"
    rates = {r["column"]: r["n"] for r in features.feature_summary(features.derive_features(df)).collect()}
    assert rates["email_valido"] == 1


def test_encoder(spark):
    df = spark.createDataFrame([("Menos de 18 anos", "a", 1, True, 5.5), ("Mais de 55 anos", "b!", 2, False, None), (None, None, 8, None, 1.0)],
                               f"`{AGE}` string, kind string, telefone_comprimento int, flag boolean, wide double").withColumn("target", F.lit(1))
    many = df.crossJoin(spark.range(30)).withColumn("wide", F.col("id") * 1.0).drop("id")
    fitted = encode.fit_encoder(many)
    assert fitted.contract == ["Qual_a_sua_idade", "wide", "kind_a", "kind_b", "telefone_comprimento_1", "telefone_comprimento_2", "flag_False", "flag_True"]
    out = fitted.transform(df, ("target",))
    rows = [tuple(r)[1:] for r in out.collect()]
    assert rows[0] == (0, 5.5, 1, 0, 1, 0, 0, 1) and rows[1] == (5, 0.0, 0, 1, 0, 1, 1, 0) and rows[2] == (0, 1.0, 0, 0, 0, 0, 0, 0)
    assert fitted.transform(df, fill=False).filter("wide IS NULL").count() == 1
    assert fitted.transform(df.drop("kind")).filter("kind_a = 0").count() == 3
    assert encode.Encoder.from_json(fitted.to_json()) == fitted
    assert encode.encoding_report(out, fitted.contract) == {"missing": [], "extra": ["target"]}
    assert len(encode.fit_encoder(spark.range(600).select(F.col("id").cast("string").alias("x"))).dummies) == 600
    few = spark.range(30).select((F.col("id") % 15).alias("n"))
    assert encode.fit_encoder(few, numeric_categories=10).numeric == ["n"] and len(encode.fit_encoder(few).dummies) == 15
    groups = encode.feature_categories(["Source_x", "Qual_a_sua_idade", "nome_valido_True", "zzz"])
    assert [len(groups[g]) for g in ("utm", "survey", "derived", "other")] == [1, 1, 1, 1]


@pytest.fixture(scope="module")
def scorer(spark):
    raw = raw_leads(spark)
    prepared = model.production_features(raw, ("row_id",))
    assert "Campaign" not in prepared.columns and "Page URL" not in prepared.columns
    encoder = encode.fit_encoder(prepared, ("row_id", "target"))
    encoded = encoder.transform(prepared, ("row_id", "target")).persist()
    made, scored = model.train_scorer(encoded.filter("row_id < 'r3'"), encoded.filter("row_id >= 'r3'"), encoder, params={"numTrees": 10, "maxDepth": 4})
    return made, scored, encoded


def test_train_and_evaluate(spark, scorer):
    made, scored, encoded = scorer
    metrics = model.evaluate(scored).first()
    assert 0.5 < metrics["auc"] <= 1.0 and 0 <= metrics["monotonicity"] <= 100
    assert scored.filter("lead_score < 0 OR lead_score > 1").count() == 0
    weights = model.with_class_weight(encoded).groupBy("target").agg(F.sum("_weight").alias("w")).collect()
    assert weights[0]["w"] == pytest.approx(weights[1]["w"])
    top = model.importance_table(spark, made.model, made.encoder.contract, 3)
    assert top.count() == 3 and top.first()["feature"] == "Qual_a_sua_idade"
    assert 0 <= model.utm_importance(made.model, made.encoder.contract) < 1
    assert made.info(spark).agg(F.sum("importance")).first()[0] == pytest.approx(1.0)


def test_duplicates_keep_their_ids(spark, scorer):
    made, _, _ = scorer
    raw = raw_leads(spark, 40, 2).drop("target")
    twice = raw.unionByName(raw.withColumn("row_id", F.concat(F.lit("copy"), "row_id")))
    out = made.score(twice).toPandas().set_index("row_id")
    assert len(out) == 80
    for i in range(40):
        assert out.loc[f"r{i}", "lead_score"] == out.loc[f"copyr{i}", "lead_score"]
    assert out["decile"].between(1, 10).all()


def test_save_load_and_csv(spark, scorer, tmp_path):
    made, scored, _ = scorer
    model.save_registry(spark, str(tmp_path / "m"), made, model.evaluate(scored), scored)
    again = model.LeadScorer.load(str(tmp_path / "m"))
    raw_leads(spark, 30, 3).drop("target").coalesce(1).write.option("header", True).csv(str(tmp_path / "in"))
    back = read_table(spark, str(tmp_path / "in"), "csv", provenance=False)
    a = {r["row_id"]: r["lead_score"] for r in made.score(back).collect()}
    assert a == {r["row_id"]: r["lead_score"] for r in again.score(back).collect()} and len(a) == 30
    assert spark.read.json(str(tmp_path / "m/thresholds")).count() <= 10
    from leadspark.sources.sinks import score_file

    raw = raw_leads(spark, 30, 3).drop("target", "row_id")
    raw.unionByName(raw).coalesce(1).write.option("header", True).csv(str(tmp_path / "file.csv"))
    out = score_file(spark, str(tmp_path / "file.csv"), made)
    assert out.count() == 60 and out.filter("lead_score IS NULL OR decile IS NULL").count() == 0
    assert {"E-mail", "Nome Completo"} <= set(out.columns)
    assert sorted(r["lead_score"] for r in out.collect())[::2] == sorted(a.values())


def test_tune(spark, scorer):
    made, _, encoded = scorer
    grid = {"numTrees": (3,), "maxDepth": (1, 3)}
    best, tried = model.tune(encoded.filter("row_id < 'r3'"), encoded.filter("row_id >= 'r3'"), made.encoder.contract, grid, baseline={"numTrees": 3, "maxDepth": 1})
    assert len(tried) == 2 and best["numTrees"] == 3
    alone = model.tune(encoded.filter("row_id < 'r3'"), encoded.filter("row_id >= 'r3'"), made.encoder.contract, grid, baseline={"numTrees": 3, "maxDepth": 1}, parallel=1)
    assert alone == (best, tried)
    assert [len([1 for _ in range(1)]) * len(v) for v in model.GRIDS["large"].values()] == [4, 4, 3, 2]


def test_tune_counts_equal_rows_without_sending_each_through_the_trees(spark, monkeypatch):
    rows = [(float(i % 23), float(i % 2), int(i * 7 % 10 < 2 + i % 23 // 4)) for i in range(3000)] + [(90.0, 0.0, 1)]
    df = spark.createDataFrame(rows, "a double, b double, target int")
    kinds = {(a, b, y): rows.count((a, b, y)) for a, b, y in set(rows)}
    fits, fit = [], model.fit_forest

    def seen(train, features, target, params, *more):
        fits.append((params["maxDepth"], train.count(), train.columns, train.groupBy("a", "b", "target").agg(F.sum("_rows")).collect() if "_rows" in train.columns else []))
        return fit(train, features, target, params, *more)

    monkeypatch.setattr(model, "fit_forest", seen)
    grid, base = {"numTrees": (5,), "maxDepth": (4, 6)}, {"numTrees": 5, "maxDepth": 4}
    _, tried = model.tune(df, df, ["a", "b"], grid, baseline=base, parts=16)
    assert sorted(f[0] for f in fits) == [4, 6]  # the baseline is one of the grid's settings
    for _, count, _, sums in fits:
        assert count == sum(min(n, 16) for n in kinds.values())
        assert {tuple(r)[:3]: round(r[3], 6) for r in sums} == kinds
    _, each = model.tune(df, df, ["a", "b"], grid, baseline=base, parts=None)
    assert fits[-1][1] == len(rows) and all(abs(x - y) < 0.03 for (_, x), (_, y) in zip(tried, each, strict=True))


def test_weights_and_auc_of_counted_rows(spark):
    rows = [(0.1 * (i % 7), int(i * 5 % 11 < 4)) for i in range(500)]
    df = spark.createDataFrame(rows, "lead_score double, target int")
    for parts in (1, 3):
        counted = model.alike(df, parts)
        weigh = lambda d, *r: {x[0]: round(x[1], 9) for x in model.with_class_weight(d, "target", *r).groupBy("target").agg(F.sum("_weight")).collect()}
        assert weigh(counted, "_rows") == weigh(df) and round(counted.agg(F.sum("_rows")).first()[0], 6) == 500
    assert dec.auc(model.alike(df), rows="_rows").first() == dec.auc(df).first()
    assert model.alike(df.limit(0), 3).count() == 0


def test_conversion_events(spark):
    leads = spark.createDataFrame([("a@x.co", "11999887766", "Ana Lima", 0.9, 10, "2025-01-01 00:00:00", "Feminino"), ("b@x.co", None, " ", 0.1, None, "bad", "")],
                                  "email string, phone string, name string, lead_score double, decile int, data string, genero string")
    captured = spark.createDataFrame([("b@x.co", "ev9", "Bea", None, "fb")], "email string, event_id string, first_name string, last_name string, fbp string")
    rich = events.enrich_with_captures(leads, captured, 99)
    out = {r["event"]["event_id"]: r["event"] for r in events.conversion_events(rich, ("genero",)).collect()}
    made = "lead_99_725e56191cbb9c10"  # by the hash of the e-mail
    assert set(out) == {f"qualified_{made}", f"hq_{made}", "qualified_ev9"}
    ana, bea = out[f"qualified_{made}"], out["qualified_ev9"]
    assert ana["custom_data"]["value"] == pytest.approx(69.102) and ana["event_time"] == 1735689600
    assert ana["custom_data"]["custom_properties"] == {"lead_score": "0.9", "decil": "D10", "taxa_conversao": "0.034551", "genero": "Feminino"}
    assert bea["custom_data"]["value"] == pytest.approx(7.672) and bea["event_time"] == 99 and "genero" not in bea["custom_data"]["custom_properties"]
    assert out[f"hq_{made}"]["custom_data"]["value"] is None and ana["user_data"]["ge"] == "f" and bea["user_data"]["country"] is None
    import hashlib

    assert bea["user_data"]["fn"] == hashlib.sha256(b"bea").hexdigest() and ana["user_data"]["ln"] == hashlib.sha256(b"lima").hexdigest()
    body = json.loads(events.payload(events.conversion_events(rich)).first()["payload"])
    assert body["action_source"] == "website"
    assert {r["event_name"]: r["events"] for r in events.event_counts(events.conversion_events(rich)).collect()} == {"LeadQualified": 2, "LeadQualifiedHighQuality": 1}
    daily = events.daily_events(leads.drop("decile"), captured, [(1, 0.0, 0.5), (10, 0.5, 1.0)], 99)
    assert daily.count() == 3
    sent = spark.createDataFrame([("a@x.co",)], "email string")
    assert events.already_sent(leads, sent).count() == 1 and events.not_sent(leads, sent).count() == 1


SCHEMA = "event_id string, created_at timestamp, email string, event_source_url string"


def test_intake_and_send_once(spark, tmp_path):
    def land(name, rows):
        (tmp_path / "in").mkdir(exist_ok=True)
        lines = [json.dumps(dict(zip(("event_id", "created_at", "email", "event_source_url"), r))) for r in rows]
        (tmp_path / "in" / name).write_text("\n".join(lines))

    source = lambda: jobs.read_stream(spark, str(tmp_path / "in"), SCHEMA, max_files=1)
    run = lambda q: (q.awaitTermination(), q.exception())[1]
    once = lambda: jobs.send_once(source(), str(tmp_path / "sent"), str(tmp_path / "once"), str(tmp_path / "c2"))
    intake = lambda: jobs.append_stream(jobs.capture_intake(source()), str(tmp_path / "out"), str(tmp_path / "c1"))
    land("a.json", [("e1", "2025-01-01 00:00:00", "a@x.co", "https://s/"), ("e1", "2025-01-01 00:00:00", "a@x.co", "https://s/"), ("e2", "2025-01-01 01:00:00", "b@x.co", "https://s/Parabens")])
    assert run(intake()) is None and run(once()) is None
    land("b.json", [("e3", "2025-01-01 02:00:00", "a@x.co", None), ("e4", "2025-01-01 02:00:00", "c@x.co", None)])
    assert run(intake()) is None and run(once()) is None
    assert {r["event_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"e1", "e3", "e4"}
    got = sorted((r["email"], r["event_id"]) for r in spark.read.parquet(str(tmp_path / "once")).collect())
    assert got == [("a@x.co", "e1"), ("b@x.co", "e2"), ("c@x.co", "e4")]


def test_stream_scores_equal_batch(spark, scorer, tmp_path):
    made, _, _ = scorer
    raw = raw_leads(spark, 50, 4).drop("target")
    raw.write.parquet(str(tmp_path / "raw"))
    stream = jobs.read_stream(spark, str(tmp_path / "raw"), raw.schema, "parquet")
    jobs.append_stream(jobs.score_stream(stream, made), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    batch = {tuple(r) for r in made.score(raw).collect()}
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == batch


def test_event_stream_and_trailing(spark, tmp_path):
    leads = spark.createDataFrame([("a@x.co", 0.9, dt.datetime(2025, 1, 6))], "email string, lead_score double, created_at timestamp")
    leads.write.parquet(str(tmp_path / "in"))
    captured = spark.createDataFrame([("a@x.co", "ev1")], "email string, event_id string")
    stream = jobs.read_stream(spark, str(tmp_path / "in"), leads.schema, "parquet")
    jobs.append_stream(jobs.event_stream(stream, captured, [(1, 0.0, 0.5), (10, 0.5, 1.0)], 5), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    counts = jobs.trailing_counts(spark.read.parquet(str(tmp_path / "in")), "created_at", 3)
    assert counts.count() == 3
    week = jobs.weekly_counts(spark.read.parquet(str(tmp_path / "in")), "created_at").first()
    assert week["week"]["start"] == dt.datetime(2025, 1, 6)


def test_stability_settings(spark):
    df = spark.createDataFrame([(k,) for k in (1, 2, 3, 10, 10, 10)], "decile int")
    row = dec.threshold_stability(df).first()
    assert (row["leads"], row["empty_deciles"], row["viable"]) == (6, 6, False)
    assert Settings().instalment_factor == pytest.approx(0.6211)
