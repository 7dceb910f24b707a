"""Readers, loaders and sinks on small invented files."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from leadspark.operators import columns as col
from leadspark.operators import profile
from leadspark.schemas import SALES, conform
from leadspark.sources import leads, reports, sales, sinks, tables


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_read_table_and_selection(spark, tmp_path):
    write(tmp_path / "Pesquisa" / "LF10.csv", "E-mail,x\n" + "a@b.co,1\n" * 3)
    write(tmp_path / "tmb vendas" / "LF10.csv", "E-mail,x\nc@d.co,1\n")
    write(tmp_path / "Lead Score" / "other.csv", "E-mail,x\nc@d.co,1\n")
    write(tmp_path / "misc" / "other.csv", "E-mail,x\n" + "c@d.co,1\n" * 5)
    df = tables.read_table(spark, [str(p) for p in tmp_path.rglob("*.csv")])
    assert df.dtypes[:2] == [("E-mail", "string"), ("x", "string")]
    report = tables.table_report(df, ["Pesquisa", "Vendas"], ["Lead Score"], 5, ["tmb", "guru"])
    kept = {r["aba_origem"] for r in report.filter("kept").collect()}
    assert kept == {"Pesquisa", "misc"}
    assert tables.select_tables(df, report).count() == 8
    duplicates = {r["aba_origem"]: r["removed"] for r in tables.duplicate_report(df).collect()}
    assert duplicates == {"Pesquisa": 2, "tmb vendas": 0, "Lead Score": 0, "misc": 4}
    with pytest.raises(ValueError):
        tables.read_table(spark, [])
    with pytest.raises(Exception):
        tables.read_table(spark, str(tmp_path / "missing.csv")).count()


def test_consolidate_and_order(spark):
    a = spark.createDataFrame([(1, 2)], "x int, y int")
    b = spark.createDataFrame([(3,)], "x int")
    out = tables.consolidate({("f1", "Pesquisa vendas"): a, ("f2", "pesquisa"): b, ("f3", "Vendas"): b, ("f4", "zzz"): b}, ["pesquisa"], ["vendas"])
    assert out["survey"].count() == 2 and out["sales"].count() == 1
    assert out["survey"].filter("y IS NULL").first()["arquivo_origem"] == "f2"
    assert tables.training_files(["b guru.csv", "[a] guru.csv", "c tmb.csv"], ("guru", "pesquisa", "lead")) == ["[a] guru.csv", "b guru.csv"]


SURVEY = """Data,Nome Completo,E-mail,Telefone,Campaign,Source,Medium,Term,Content,lead_score,Unnamed: 3
2025-11-01 10:00:00,Ana Silva, Ana@Mail.com ,11999887766.0,X|120220370119870390,facebook-ads,{{adset.name}},ig,c1,"0,31",z
03/11/2025,Bea,bea@mail.com,99887766,{{campaign}},google-ads,Open,fb,c2,bad,z
#ERROR!,No Mail,none,1,Y,fb,Open,fb,c3,0.9,z
"""


def test_survey_leads(spark, tmp_path):
    raw = tables.read_table(spark, write(tmp_path / "s.csv", SURVEY), provenance=False)
    rows = {r["email"]: r for r in leads.survey_leads(raw, [(1, 0.0, 0.3), (2, 0.3, 0.5), (10, 0.5, 1.0)]).collect()}
    assert set(rows) == {"ana@mail.com", "bea@mail.com"}
    ana, bea = rows["ana@mail.com"], rows["bea@mail.com"]
    assert (ana["phone"], ana["medium"], ana["lead_score"], ana["decile"]) == ("11999887766", None, 0.31, 2)
    assert ana["captured_at"] == dt.datetime(2025, 11, 1, 10) and bea["captured_at"] == dt.datetime(2025, 11, 3)
    assert bea["campaign"] is None and bea["lead_score"] is None and bea["decile"] is None
    faixa = raw.drop("lead_score").withColumn("Faixa", F.lit("D7"))
    assert {r["decile"] for r in leads.survey_leads(faixa).collect()} == {7}
    renamed = raw.withColumnRenamed("Data", "Data do Envio")
    assert leads.survey_leads(renamed).count() == 2
    with pytest.raises(ValueError, match="Campaign"):
        leads.survey_leads(raw.drop("Campaign"))
    assert leads.scorable(raw).count() == 3


def test_valid_scores(spark):
    df = spark.createDataFrame([("0,5",), ("0",), ("1",), ("1.2",), (None,), ("x",)], "lead_score string")
    kept, counts = leads.valid_scores(df)
    assert sorted(r["lead_score"] for r in kept.collect()) == [0.5, 1.0]
    assert tuple(counts.first()) == (2, 4)


def test_sales_of_both_vendors(spark, tmp_path):
    a = write(tmp_path / "a.csv", "status,email contato,nome contato,telefone contato,valor venda,data aprovacao,data pedido,nome produto\n"
              "Aprovada,A@x.co,A,11999887766,\"1.997,50\",05/11/2025,01/11/2025,P1\nAprovada,b@x.co,B,,100,,02/11/2025 10:00:00,P1\nCancelada,c@x.co,C,,1,05/11/2025,,P\nAprovada,d@x.co,D,,1,,,P\n")
    b = write(tmp_path / "b.csv", "Status,Cliente E-mail,Cliente Nome,Telefone,Ticket (R$),Data Efetivado,Criado Em,Produto\n"
              "Efetivado,a@x.co,A,11999887766,50,05/11/2025,,P1\nEfetivado,e@x.co,E,,60,,06/11/2025,P2\nPendente,f@x.co,F,,60,,06/11/2025,P2\n")
    va = sales.vendor_a_sales(tables.read_table(spark, a, provenance=False))
    vb = sales.vendor_b_sales(tables.read_table(spark, b, provenance=False))
    assert va.dtypes == spark.createDataFrame([], SALES).dtypes
    got = {(r["email"], r["sale_origin"], r["sale_value"], r["sale_date"].day) for r in sales.combine_sales(va, vb).collect()}
    assert got == {("a@x.co", "guru", 1997.5, 5), ("b@x.co", "guru", 100.0, 2), ("e@x.co", "tmb", 60.0, 6)}
    assert conform(va.drop("phone"), SALES).columns == SALES.names


def captures(spark):
    t = lambda d: dt.datetime(2025, 11, d)
    rows = [
        (1, "a@x.co", None, "e1", "n|120220370119870390", t(1), "fb1", None), (2, "a@x.co", "Ana", "e2", "n|120220370119870391", t(2), None, "c"),
        (3, "b@x.co", None, "e3", "plain", t(3), "", None), (4, "c@x.co", "Cid", "e4", "n|120220370119870392", t(9), "fb4", "c4"),
    ]
    return spark.createDataFrame(rows, "id long, email string, first_name string, event_id string, utm_campaign string, created_at timestamp_ntz, fbp string, fbc string")


def test_capture_lookups(spark):
    c = captures(spark)
    emails = spark.createDataFrame([("a@x.co",), ("b@x.co",)], "email string")
    assert {r["event_id"] for r in leads.latest_by_email(c).collect()} == {"e2", "e3", "e4"}
    assert leads.by_event_id(c, "e3").first()["id"] == 3
    assert leads.by_emails(c, emails).count() == 3
    assert [r["id"] for r in leads.most_recent(c, 2).collect()] == [4, 3]
    assert [r["id"] for r in leads.most_recent(c, 10, "2025-11-02", "2025-11-03").collect()] == [3, 2]
    assert leads.captures_of(c, emails, "2025-11-01", "2025-11-02").count() == 2
    assert {r["email"]: r["id"] for r in leads.best_captures(c).collect()} == {"a@x.co": 2, "b@x.co": 3, "c@x.co": 4}
    assert {r["email"]: r["campaign_id"] for r in leads.email_campaign_ids(c).collect()} == {"a@x.co": "120220370119870391", "c@x.co": "120220370119870392"}
    assert leads.last_seven_days(c, "2025-11-10").count() == 2
    gone = spark.createDataFrame([(1,), (2,)], "id long")
    assert leads.without_ids(c, gone).count() == 2
    many = spark.range(20_000).selectExpr("id", "timestamp_seconds(id) AS created_at")
    newest = leads.most_recent(many, 15_000)
    assert newest.count() == 15_000 and newest.agg({"id": "min"}).first()[0] == 5_000
    assert leads.without_ids(many, spark.range(6_000)).count() == 14_000
    stats = profile.capture_stats(c).first()
    assert (stats["total"], stats["distinct_email"], stats["with_fbp"], stats["with_fbc"], stats["with_all"]) == (4, 3, 2, 2, 1)


def test_combined_leads(spark):
    survey = spark.createDataFrame([("b@x.co", dt.datetime(2025, 11, 2)), ("b@x.co", dt.datetime(2025, 11, 2)), ("z@x.co", dt.datetime(2025, 12, 1))],
                                   "email string, captured_at timestamp_ntz").withColumn("campaign", F.lit("q"))
    caught = leads.captured_leads(captures(spark))
    out = leads.combined_leads(survey, caught, "2025-11-01", "2025-11-05")
    assert sorted((r["email"], r["source_type"]) for r in out.collect()) == [("a@x.co", "capi"), ("a@x.co", "capi"), ("b@x.co", "survey")]
    assert leads.source_counts(survey, caught, out, "2025-11-01", "2025-11-05").first().asDict() == {"survey_leads": 1, "capi_leads_extras": 2, "capi_leads_total": 1}


def test_reports(spark, tmp_path):
    head = "Nome da campanha,Identificação da campanha,Nome do conjunto de anúncios,Identificação do conjunto de anúncios,Valor usado (BRL),Orçamento do conjunto de anúncios,Leads,LeadQualified,Indicador de resultados,Início dos relatórios,Término dos relatórios"
    write(tmp_path / "Ads---My-Account-Conjuntos-de-anúncios-nov.csv",
          head + "\nC  one,120220370119870390,Set  A,s1,\"1,234.5\",50,10,4,x.LeadQualified,2025-11-01,2025-11-07\nC one,120220370119870390.0,Set B,s2,10,0,,,fb_pixel_lead,2025-10-01,2025-10-07\n")
    write(tmp_path / "Ads---My-Account-Campanhas-nov.csv", "Nome da campanha,Identificação da campanha,Orçamento da campanha,Valor usado (BRL)\nC one,120220370119870390,75,5\n")
    write(tmp_path / "Ads---My-Account-Anúncios-nov.csv", "Nome do anúncio,Identificação do anúncio,Identificação da campanha,Valor usado (BRL)\nDEV-AD0033-vid,1,120220370119870390,5\n")
    found = reports.scan_reports(spark, str(tmp_path))
    rows = {r["adset_name"]: r for r in found["adset"].collect()}
    a = rows["Set A"]
    assert (a["campaign_id"], a["campaign_name"], a["spend"], a["optimization_goal"], a["_account_name"]) == ("120220370119870", "C one", 1234.5, "LeadQualified", "My Account")
    assert (rows["Set B"]["leads_standard"], rows["Set B"]["faixa_a"], rows["Set B"]["optimization_goal"]) == (0.0, 0.0, "Lead")
    assert found["ad"].first()["ad_code"] == "AD0033" and found["campaign"].first()["budget"] == 75.0
    assert reports.in_period(found["adset"], "2025-11-05", "2025-11-20").count() == 1
    zeroed = {r["adset_name"]: (r["spend"], r["total_spend"]) for r in reports.zero_spend_outside(found["adset"], "2025-11-05", "2025-11-20").collect()}
    assert zeroed == {"Set A": (1234.5, 1234.5), "Set B": (0.0, 10.0)}
    edge = found["adset"].filter("adset_name = 'Set A'").withColumn("spend", F.lit(7.0))
    merged = {r["adset_name"]: (r["spend"], r["_is_edge_case"]) for r in reports.with_edge_cases(found["adset"], edge, "adset_id").collect()}
    assert merged == {"Set A": (7.0, True), "Set B": (10.0, False)}
    from leadspark.operators.costs import report_hierarchy

    total = report_hierarchy(found["campaign"], found["adset"], found["ad"]).first()
    assert (total["spend"], total["budget"], total["num_creatives"], total["optimization_goal"], total["leads"]) == (1244.5, 50.0, 1, "Lead, LeadQualified", 10.0)


def test_insights_and_logs(spark, tmp_path):
    path = write(tmp_path / "i.json", '{"campaign_id":"1","adset_id":"2","ad_id":"3","spend":"12.5","date_start":"2025-11-01","daily_budget":"5000","optimization_goal":"LEAD",'
                 '"promoted_object":{"custom_event_str":"LeadQualified"},"actions":[{"action_type":"lead","value":"3"},{"action_type":"offsite_conversion.fb_pixel_custom","value":"2"}]}\n')
    rows = reports.read_insights(spark, path)
    cost = reports.insight_costs(rows).first()
    assert (cost["spend"], cost["daily_budget"], cost["has_campaign_budget"], cost["optimization_goal"]) == (12.5, 50.0, True, "LeadQualified")
    from leadspark.operators.metrics import event_counts, with_event_counts

    adsets = spark.createDataFrame([("2", "LeadQualified")], "adset_id string, custom_event string")
    counts = event_counts(rows, adsets)
    assert counts.first().asDict() == {"campaign_id": "1", "lead": 3.0, "LeadQualified": 2.0, "LeadQualifiedHighQuality": 0.0}
    named = with_event_counts(spark.createDataFrame([("x|12345678901",)], "campaign string"), counts)
    assert named.first()["lead"] == 0.0
    lines = spark.read.text(write(tmp_path / "log.txt", "LeadQualified enviado: a@b.co (x)\nLeadQualified enviado: a@b.co (x)\nFaixa A enviado: q@b.co (x)\nnoise\n"))
    ids = spark.createDataFrame([("a@b.co", "77")], "email string, campaign_id string")
    got = reports.log_events_by_campaign(reports.log_events(lines), ids).first()
    assert (got["campaign_id"], got["LeadQualified"], got["Faixa A"]) == ("77", 2, 0)


def test_sinks(spark, tmp_path):
    c = captures(spark)
    sinks.snapshot(c, str(tmp_path / "snap"), 2)
    assert {r["id"] for r in spark.read.json(str(tmp_path / "snap")).collect()} == {3, 4}
    sinks.recent_view(c, "recent_captures", "2025-11-10")
    assert spark.sql("SELECT count(*) AS n FROM recent_captures").first()["n"] == 2
    table = sinks.export_categories(c, "email", str(tmp_path / "cats"))
    assert table.count() == 3 and spark.read.option("header", True).csv(str(tmp_path / "cats")).count() == 3
    scored = spark.createDataFrame([(1, 0.2, 1), (2, 0.9, 10), (3, None, None)], "lead_id int, lead_score double, decile int")
    sinks.write_scored(scored, str(tmp_path / "scored"), 1)
    assert spark.read.parquet(str(tmp_path / "scored/leads")).first()["lead_id"] == 2
    rows = spark.createDataFrame([("r1",), ("r1",), ("r2",)], "row_id string")
    scores = spark.createDataFrame([("r1", 0.5, 5)], "row_id string, lead_score double, decile int")
    assert sorted((r["row_id"], r["decile"]) for r in sinks.scores_to_rows(rows, scores).fillna(0).collect()) == [("r1", 5), ("r1", 5), ("r2", 0)]
    sinks.append_captures(c, str(tmp_path / "cap"))
    sinks.append_captures(c, str(tmp_path / "cap"))
    assert spark.read.parquet(str(tmp_path / "cap")).count() == 8
    sinks.write_report({"a": scored}, str(tmp_path / "report"))
    assert spark.read.parquet(str(tmp_path / "report/a")).count() == 3


def test_columns(spark):
    names = ["E-mail", "SCORE", "Unnamed: 3", "Campaign", " ", "ab", col.INVESTED, col.INVESTED + " ", "Page URL", "Source", "Source_x"]
    df = spark.createDataFrame([tuple(None if n == col.INVESTED else str(i) for i, n in enumerate(names))], ", ".join(f"`{n}` string" for n in names))
    assert "SCORE" not in col.clean_production_columns(df).columns and "Unnamed: 3" not in col.clean_production_columns(df).columns
    assert {"Campaign", " "} & set(col.drop_campaign_columns(df).columns) == set()
    assert "ab" not in col.drop_campaign_columns(df, short_names=True).columns
    assert "Page URL" not in col.drop_technical(df).columns
    assert {"Source", "Source_x"} & set(col.drop_utm_columns(df).columns) == set()
    assert col.similar_columns(names) == [(col.INVESTED, col.INVESTED + " ")]
    unified = col.unify_survey_columns(df)
    assert unified.first()["investiu_curso_online"] == "7" and col.INVESTED not in unified.columns
    assert "investiu_curso_online" in col.rename_long(df).columns
    assert col.column_report(df)[0] == (1, "E-mail", "string")
    assert col.schema_difference(["a", "b"], ["b", "c"]) == {"missing": ["c"], "extra": ["a"]}


def test_unify_sales_and_categories(spark):
    df = spark.createDataFrame([(None, "5", "a", None, "x", "y")], "`Ticket (R$)` string, `valor produtos` string, Produto string, utm_last_source string, utm_source string, keep string")
    out = col.unify_sales_columns(df)
    assert out.columns == ["keep", "valor", "produto"] and out.first()["valor"] == "5"
    survey = spark.createDataFrame(
        [(" SIM", "Sim, tenho", "Quero saber se é para mim!", "Mais de 55 anos.", "Sou autonomo"), ("não", "Não", "A aula com a recrutadora;", None, "Sou aposentado")],
        "`Tem computador/notebook?` string, `Você possui cartão de crédito?` string, `O que mais você quer ver no evento?` string, `Qual a sua idade?` string, `O que você faz atualmente?` string")
    got = [tuple(r) for r in col.unify_categories(survey).collect()]
    assert got == [("Sim", "Sim", "Quero saber se é para mim", "Mais de 55 anos", "Sou autônomo"), ("Não", "Não", "A aula com a recrutadora", None, "Sou aposentado")]
    report = {r["value"]: r["status"] for r in profile.unification_report(survey, col.unify_categories(survey), "O que você faz atualmente?").collect()}
    assert report == {"Sou autonomo": "removed", "Sou autônomo": "added", "Sou aposentado": "kept"}
    mapping = spark.createDataFrame([("Sim", "Yes")], "value string, category string")
    assert col.rename_values(survey.withColumn("c", F.lit("Sim")), "c", mapping).first()["c"] == "Yes"


def test_profiles(spark):
    df = spark.createDataFrame([("facebook-ads", "instagram"), ("google-ads", "facebook"), (None, "instagram"), ("google-ads", "outros")], "source string, term string")
    assert profile.inconsistent_utm(df).count() == 2
    exact = {r["column"]: (r["distinct"], r["nulls"]) for r in profile.column_profile(df).collect()}
    close = {r["column"]: (r["distinct"], r["nulls"]) for r in profile.column_profile(df, approximate=True).collect()}
    assert exact == close == {"source": (2, 1), "term": (3, 0)}
    assert profile.mean_missing_rate(df).first()[0] == 12.5
    shares = profile.category_shares(df, ["source"]).collect()
    assert sum(r["pct"] for r in shares) == pytest.approx(100.0)
    assert profile.dtype_counts(df) == {"string": 2}
    cube = {(r["source"], r["term"], r["level"]): r["n"] for r in profile.crosstab(df, "source", "term").collect()}
    assert cube[(None, None, 3)] == 4 and cube[("google-ads", None, 1)] == 2


def test_long_reports_are_several_files(spark, monkeypatch):
    from leadspark.plans import intake
    from leadspark.plans.bindings import Tables
    from leadspark.session import children
    from leadspark.sources import report_source

    monkeypatch.setattr(intake, "REPORT_ROWS", 50)
    folder = intake._folder(spark, "reports")
    tables = Tables(spark, "/root/testdata/sf0.001")
    intake._write_reports(tables, folder)
    assert len([n for n in children(spark, f"{folder}/reports/1") if "Conta-1" in n]) > 1
    assert report_source.read_reports(spark, f"{folder}/reports", "adset").count() == tables.adset_rows.count()
