"""Queries: loaders, row filters, cleaning steps, logs and sinks over raw columns as files bring them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..config import Settings
from ..functions import economics as eco
from ..functions import text as tx
from ..functions import utm as u
from ..functions.contact import gender_code
from ..functions.dates import epoch_seconds
from ..functions.deciles import decile_number
from ..operators import columns as col
from ..operators import compare, costs, metrics, profile
from ..operators import events as ev
from ..operators import utm as names
from ..session import checkpoint_dir
from ..sources import leads as src
from ..sources import reports, sales, sinks, tables
from .bindings import email_sql, phone_sql, sql
from .registry import query

c = F.col


def _folder(t, label: str) -> str:
    return f"{checkpoint_dir(t.spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


# -- sales of both vendors, with their status as the files have it ---------------------------

_BUYERS = f"""raw_sales AS (SELECT o_orderkey AS k, o_orderstatus AS st, o_totalprice AS price, DATE '2024-01-01' + CAST(o_orderkey % 60 AS INT) AS day,
    CASE WHEN o_orderkey % 11 = 0 THEN 'none' ELSE ' ' || c_name || '@Mail.com' END AS mail, '+55 (11) 9' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS tel, c_name, o_orderpriority
  FROM orders JOIN customer ON o_custkey = c_custkey),
read_sales AS (SELECT *, {email_sql('mail')} AS email, {phone_sql('tel')} AS phone, CASE WHEN k % 13 <> 0 THEN round(price, 2) END AS sale_value FROM raw_sales)"""


def _raw_sales(t):
    joined = t.read("orders").join(t.read("customer"), c("o_custkey") == c("c_custkey"))
    day = F.date_add(F.lit("2024-01-01").cast("date"), (c("o_orderkey") % 60).cast("int"))
    return joined.select(
        c("o_orderkey").alias("k"), c("o_orderstatus").alias("st"), F.round("o_totalprice", 2).cast("decimal(18,2)").alias("price"), day.alias("day"),
        F.when(c("o_orderkey") % 11 == 0, "none").otherwise(F.concat(F.lit(" "), "c_name", F.lit("@Mail.com"))).alias("mail"),
        F.concat(F.lit("+55 (11) 9"), F.lpad(c("c_custkey").cast("string"), 8, "0")).alias("tel"), "c_name", "o_orderpriority",
    )


_SALE = ("email", "name", "phone", "sale_value", "sale_date", "product", "sale_origin")


@query(
    "vendor_a_loaded",
    f"""WITH {_BUYERS} SELECT email, c_name AS name, phone, sale_value, CASE WHEN k % 7 = 0 THEN day ELSE day + 2 END::TIMESTAMP AS sale_date, o_orderpriority AS product, 'guru' AS sale_origin
FROM read_sales WHERE st = 'F' AND email IS NOT NULL""",
)
def vendor_a_loaded(t):
    """Approved sales by date of approval, else of order; prices written ``1.234,50``, some unreadable."""
    r = _raw_sales(t)
    price = F.translate(F.format_number("price", 2), ",.", ".,")
    raw = r.select(
        F.when(c("st") == "F", "Aprovada").when(c("st") == "O", "Cancelada").otherwise("Aguardando").alias("status"), c("mail").alias("email contato"), c("c_name").alias("nome contato"),
        c("tel").alias("telefone contato"), F.when(c("k") % 13 != 0, price).otherwise("a combinar").alias("valor venda"), c("o_orderpriority").alias("nome produto"),
        F.when(c("k") % 7 != 0, F.date_format(F.date_add("day", 2), "dd/MM/yyyy")).alias("data aprovacao"), c("day").cast("string").alias("data pedido"),
    )
    return sales.vendor_a_sales(raw).select(*_SALE)


@query(
    "vendor_b_loaded",
    f"""WITH {_BUYERS} SELECT email, c_name AS name, phone, sale_value, CASE WHEN k % 5 = 0 THEN day::TIMESTAMP ELSE day + TIME '10:30:00' END AS sale_date, o_orderpriority AS product, 'tmb' AS sale_origin
FROM read_sales WHERE st <> 'F' AND k % 3 <> 0 AND email IS NOT NULL""",
)
def vendor_b_loaded(t):
    """Effective sales by the date they took effect, else of creation."""
    r = _raw_sales(t).filter("st <> 'F'")
    raw = r.select(
        F.when(c("k") % 3 != 0, "Efetivado").otherwise("Cancelado").alias("Status"), c("mail").alias("Cliente E-mail"), c("c_name").alias("Cliente Nome"), c("tel").alias("Telefone"),
        F.when(c("k") % 13 != 0, F.translate(c("price").cast("string"), ".", ",")).alias("Ticket (R$)"), c("o_orderpriority").alias("Produto"),
        F.when(c("k") % 5 != 0, F.concat(F.date_format("day", "d/M/yyyy"), F.lit(" 10:30"))).alias("Data Efetivado"), F.date_format("day", "dd/MM/yyyy").alias("Criado Em"),
    )
    return sales.vendor_b_sales(raw).select(*_SALE)


# -- survey and captured leads ---------------------------------------------------------------

@query(
    "survey_loaded",
    sql("""SELECT lead_id::VARCHAR AS lead_id, email, phone, date_trunc('second', captured_at) AS captured_at, CASE WHEN lead_id % 6 <> 0 THEN campaign END AS campaign,
  CASE WHEN medium NOT LIKE '%{{%' THEN medium END AS medium, CASE WHEN lead_id % 9 <> 0 THEN round(lead_score, 4) END AS lead_score,
  CASE WHEN lead_id % 9 = 0 THEN NULL WHEN round(lead_score, 4) <= 0.3 THEN 1 WHEN round(lead_score, 4) <= 0.6 THEN 5 ELSE 10 END AS decile
FROM leads WHERE email IS NOT NULL"""),
)
def survey_loaded(t):
    """Survey rows under their own headings: dates day first or ISO, scores with a decimal comma, template campaigns."""
    i, at = c("lead_id"), c("captured_at")
    raw = t.leads.select(
        i, c("email_raw").alias("E-mail"), c("name").alias("Nome Completo"), c("phone_raw").alias("Telefone"),
        F.when(i % 2 == 0, F.date_format(at, "dd/MM/yyyy HH:mm:ss")).otherwise(F.date_format(at, "yyyy-MM-dd HH:mm:ss")).alias("Data do Envio"),
        F.when(i % 6 == 0, "{{campaign.name}}").otherwise(c("campaign")).alias("Campaign"), c("medium").alias("Medium"), c("term").alias("Term"),
        F.when(i % 9 != 0, F.translate(F.round("lead_score", 4).cast("string"), ".", ",")).otherwise("sem nota").alias("lead_score"),
    )
    out = src.survey_leads(raw, [(1, 0.0, 0.3), (5, 0.3, 0.6), (10, 0.6, 1.0)])
    return out.select("lead_id", "email", "phone", "captured_at", "campaign", "medium", "lead_score", "decile")


@query("captures_of_list", sql("""SELECT id, email, event_id FROM captures WHERE created_at >= DATE '2024-01-05' AND created_at < DATE '2024-01-21'
  AND email IN (SELECT email FROM leads WHERE email IS NOT NULL AND lead_id % 97 = 0)"""))
def captures_of_list(t):
    return src.captures_of(t.captures, t.leads.filter("lead_id % 97 = 0"), "2024-01-05", "2024-01-20").select("id", "email", "event_id")


@query("scorable_leads", sql("SELECT lead_id FROM leads WHERE email_raw IS NOT NULL AND lead_id % 8 NOT IN (0, 3)"))
def scorable_leads(t):
    name = F.when(c("lead_id") % 8 == 0, "  ").when(c("lead_id") % 8 != 3, c("name"))
    return src.scorable(t.leads.select("lead_id", name.alias("Nome Completo"), c("email_raw").alias("E-mail"))).select("lead_id")


_SCORES = "CASE WHEN lead_id % 10 = 0 THEN -lead_score WHEN lead_id % 10 = 1 THEN lead_score + 1 WHEN lead_id % 10 <> 2 THEN lead_score END"


def _scores(t):
    i, s = c("lead_id"), c("lead_score")
    text = F.when(i % 10 == 0, (-s).cast("string")).when(i % 10 == 1, (s + 1).cast("string")).when(i % 10 == 2, "n/d").when(i % 2 == 0, F.translate(s.cast("string"), ".", ",")).otherwise(s.cast("string"))
    return t.leads.select("lead_id", text.alias("lead_score"))


@query("valid_scores", sql(f"SELECT lead_id, s AS lead_score FROM (SELECT lead_id, {_SCORES} AS s FROM leads) WHERE s > 0 AND s <= 1"))
def valid_scores(t):
    return src.valid_scores(_scores(t))[0]


@query("valid_score_counts", sql(f"SELECT count(*) FILTER (coalesce(s > 0 AND s <= 1, false)) AS valid, count(*) FILTER (NOT coalesce(s > 0 AND s <= 1, false)) AS invalid FROM (SELECT {_SCORES} AS s FROM leads)"))
def valid_score_counts(t):
    return src.valid_scores(_scores(t))[1]


@query("without_listed_ids", sql("SELECT id, email FROM captures WHERE id % 37 <> 0"))
def without_listed_ids(t):
    return src.without_ids(t.captures.select("id", "email"), t.captures.filter("id % 37 = 0").select("id"))


@query("after_cutoff", sql("SELECT lead_id, email FROM leads WHERE captured_at >= DATE '2024-01-15'"))
def after_cutoff(t):
    return col.after_cutoff(t.leads.select("lead_id", "email", "captured_at"), "captured_at", "2024-01-15", ("captured_at",))


@query("rows_at_level", sql("SELECT adset_id, report_start, spend FROM adset_rows WHERE adset_name IN ('Set 1', 'Set 3')"))
def rows_at_level(t):
    allowed = t.adset_rows.filter("adset_name IN ('Set 1', 'Set 3')").select("adset_name")
    return compare.at_level(t.adset_rows, allowed, "adset_name").select("adset_id", "report_start", "spend")


@query("rows_of_arms", sql("""SELECT adset_id, report_start, CASE WHEN CAST(substr(campaign_id, 18) AS INT) % 2 = 0 THEN 'treated' ELSE 'control' END AS ml_type FROM adset_rows
WHERE CAST(substr(campaign_id, 18) AS INT) % 10 < 4"""))
def rows_of_arms(t):
    digit = F.substr("campaign_id", F.lit(18)).cast("int")
    arms = t.adset_rows.filter(digit % 10 < 4).select("campaign_id", F.when(digit % 2 == 0, "treated").otherwise("control").alias("arm"))
    return compare.label_arms(t.adset_rows.drop("ml_type"), arms).select("adset_id", "report_start", "ml_type")


@query("not_yet_sent", sql("SELECT id, email FROM captures WHERE email IS NOT NULL AND email NOT IN (SELECT email FROM captures WHERE email IS NOT NULL AND id % 101 = 0)"))
def not_yet_sent(t):
    known = t.captures.filter("email IS NOT NULL").select("id", "email")
    return ev.not_sent(known, known.filter("id % 101 = 0"))


# -- tables of many files ---------------------------------------------------------------------

_SHEETS = """sheets AS (SELECT CASE WHEN event_id % 5 = 0 THEN '[LF06] Pesquisa.xlsx' WHEN event_id % 5 = 1 THEN 'LF07 Vendas.xlsx' ELSE 'Base.xlsx' END AS arquivo_origem,
    CASE event_id % 7 WHEN 0 THEN 'Pesquisa' WHEN 1 THEN 'Vendas TMB' WHEN 2 THEN 'Resumo' WHEN 3 THEN 'Guru' ELSE 'Aba ' || event_type END AS aba_origem, user_id % 20 AS who, event_type FROM events)"""


def _sheets(t):
    e, i = t.read("events"), c("event_id")
    return e.select(
        F.when(i % 5 == 0, "[LF06] Pesquisa.xlsx").when(i % 5 == 1, "LF07 Vendas.xlsx").otherwise("Base.xlsx").alias("arquivo_origem"),
        F.when(i % 7 == 0, "Pesquisa").when(i % 7 == 1, "Vendas TMB").when(i % 7 == 2, "Resumo").when(i % 7 == 3, "Guru").otherwise(F.concat(F.lit("Aba "), "event_type")).alias("aba_origem"),
        (c("user_id") % 20).alias("who"), "event_type",
    )


_KEPT = """aba_origem <> 'Resumo' AND NOT (aba_origem IN ('Vendas TMB', 'Guru') AND arquivo_origem = 'LF07 Vendas.xlsx') AND (aba_origem = 'Pesquisa' OR "rows" >= 20)"""


@query("table_decisions", f"""WITH {_SHEETS} SELECT *, {_KEPT} AS kept FROM (SELECT arquivo_origem, aba_origem, count(*) AS "rows" FROM sheets GROUP BY ALL)""")
def table_decisions(t):
    return tables.table_report(_sheets(t), ["pesquisa"], ["resumo"], 20, ["tmb", "guru"])


@query("tables_selected", f"""WITH {_SHEETS}, per AS (SELECT arquivo_origem, aba_origem, count(*) AS "rows" FROM sheets GROUP BY ALL)
SELECT sheets.* FROM sheets JOIN per USING (arquivo_origem, aba_origem) WHERE {_KEPT}""")
def tables_selected(t):
    rows = _sheets(t)
    return tables.select_tables(rows, tables.table_report(rows, ["pesquisa"], ["resumo"], 20, ["tmb", "guru"]))


@query("duplicate_rows_report", f"""WITH {_SHEETS} SELECT arquivo_origem, aba_origem, count(*) AS rows_before, count(DISTINCT (who, event_type)) AS rows_after, count(*) - count(DISTINCT (who, event_type)) AS removed
FROM sheets GROUP BY ALL""")
def duplicate_rows_report(t):
    return tables.duplicate_report(_sheets(t))


@query("duplicate_rows_dropped", f"WITH {_SHEETS} SELECT DISTINCT * FROM sheets")
def duplicate_rows_dropped(t):
    return tables.drop_duplicate_rows(_sheets(t))


@query("sheets_consolidated", f"""WITH {_SHEETS} SELECT 'survey' AS kind, who, event_type, NULL AS price, 'a.xlsx' AS arquivo_origem, 'Pesquisa vendas' AS aba_origem FROM sheets WHERE aba_origem = 'Pesquisa'
UNION ALL SELECT 'sales', who, NULL, 2 * who, 'b.xlsx', 'Vendas' FROM sheets WHERE aba_origem = 'Guru' UNION ALL SELECT 'sales', who, event_type, NULL, 'c.xlsx', 'TMB' FROM sheets WHERE aba_origem = 'Vendas TMB'""")
def sheets_consolidated(t):
    """Sheets routed by keyword, the survey first, and stacked with the columns of all."""
    rows = _sheets(t)
    part = lambda sheet: rows.filter(c("aba_origem") == sheet)
    parts = {
        ("a.xlsx", "Pesquisa vendas"): part("Pesquisa").select("who", "event_type"), ("b.xlsx", "Vendas"): part("Guru").select("who", (2 * c("who")).alias("price")),
        ("c.xlsx", "TMB"): part("Vendas TMB").select("who", "event_type"), ("d.xlsx", "Resumo"): part("Resumo").select("who"),
    }
    routed = tables.consolidate(parts, ["pesquisa"], ["venda", "tmb"])
    return tables.union_all([df.withColumn("kind", F.lit(kind)) for kind, df in routed.items()]).select("kind", "who", "event_type", "price", "arquivo_origem", "aba_origem")


# -- UTM values and survey answers ------------------------------------------------------------

_UTM = """utm AS (SELECT event_id AS i, CASE event_id % 6 WHEN 0 THEN 'fb' WHEN 1 THEN 'facebook-ads' WHEN 2 THEN 'utm_source' WHEN 3 THEN 'teste' WHEN 4 THEN 'google-ads' END AS source,
    CASE event_id % 5 WHEN 0 THEN 'ig' WHEN 1 THEN 'facebook' WHEN 2 THEN user_id::VARCHAR WHEN 3 THEN 'kw--1--2' END AS term,
    CASE event_id % 4 WHEN 0 THEN 'ADV | Aberto' WHEN 1 THEN 'ABERTO' WHEN 2 THEN 'Lookalike 1%. | x' ELSE 'Outro ' || event_type END AS medium FROM events)"""


def _utm(t):
    i = c("event_id")
    return t.read("events").select(
        i.alias("i"), F.when(i % 6 == 0, "fb").when(i % 6 == 1, "facebook-ads").when(i % 6 == 2, "utm_source").when(i % 6 == 3, "teste").when(i % 6 == 4, "google-ads").alias("source"),
        F.when(i % 5 == 0, "ig").when(i % 5 == 1, "facebook").when(i % 5 == 2, c("user_id").cast("string")).when(i % 5 == 3, "kw--1--2").alias("term"),
        F.when(i % 4 == 0, "ADV | Aberto").when(i % 4 == 1, "ABERTO").when(i % 4 == 2, "Lookalike 1%. | x").otherwise(F.concat(F.lit("Outro "), "event_type")).alias("medium"),
    )


_TERM = "CASE WHEN term = 'ig' THEN 'instagram' WHEN term = 'facebook' THEN 'facebook' WHEN term = 'kw--1--2' THEN 'outros' ELSE term END AS term"


@query("sources_unified", f"WITH {_UTM} SELECT i, CASE WHEN source IN ('fb', 'teste') THEN 'outros' ELSE source END AS source, {_TERM} FROM utm")
def sources_unified(t):
    return names.unify_source_term(_utm(t)).select("i", "source", "term")


@query("sources_unified_training", f"WITH {_UTM} SELECT i, CASE WHEN source IN ('fb', 'teste', 'utm_source') THEN 'outros' ELSE source END AS source, {_TERM} FROM utm")
def sources_unified_training(t):
    return names.unify_source_term(_utm(t), training=True).select("i", "source", "term")


@query("mediums_unified", f"""WITH {_UTM} SELECT i, CASE i % 4 WHEN 2 THEN 'Lookalike' WHEN 3 THEN CASE WHEN medium IN ('Outro click', 'Outro view') THEN medium ELSE 'Outros' END ELSE 'Aberto' END AS medium FROM utm""")
def mediums_unified(t):
    """Audience of the medium, its most frequent spelling, and its category."""
    mapping = t.spark.createDataFrame([("Lookalike 1%.", "Lookalike")], "value string, category string")
    valid = t.spark.createDataFrame([("Aberto",), ("Outro click",), ("Outro view",)], "category string")
    return names.unify_medium(_utm(t), mapping, valid).select("i", "medium")


@query("utm_values_summary", f"""WITH {_UTM} SELECT 'source' AS "column", source AS value, count(*) AS n FROM utm GROUP BY source UNION ALL SELECT 'term', term, count(*) FROM utm GROUP BY term""")
def utm_values_summary(t):
    return profile.utm_summary(_utm(t), ["source", "term", "absent"])


@query("unification_before_after", f"""WITH {_UTM}, b AS (SELECT source AS value, count(*) AS n FROM utm WHERE source IS NOT NULL GROUP BY 1),
a AS (SELECT CASE WHEN source IN ('fb', 'teste') THEN 'outros' ELSE source END AS value, count(*) AS n FROM utm WHERE source IS NOT NULL GROUP BY 1)
SELECT value, coalesce(b.n, 0) AS n_before, coalesce(a.n, 0) AS n_after, CASE WHEN a.n IS NULL THEN 'removed' WHEN b.n IS NULL THEN 'added' ELSE 'kept' END AS status FROM b FULL JOIN a USING (value)""")
def unification_before_after(t):
    rows = _utm(t)
    return profile.unification_report(rows, names.unify_source(rows), "source")


_CARD, _AGE = "Você possui cartão de crédito?", "Qual a sua idade?"


@query("survey_columns_cleaned", f"""SELECT event_id AS i, CASE event_id % 3 WHEN 0 THEN 'Sim' WHEN 1 THEN 'Não' END AS "{_CARD}",
  CASE event_id % 4 WHEN 0 THEN 'Menos de 18 anos' WHEN 1 THEN 'Mais de 55 anos' WHEN 2 THEN '18 - 24 anos' END AS "{_AGE}", event_type AS "Nome" FROM events""")
def survey_columns_cleaned(t):
    """Unwanted columns dropped, invisible characters and dots cleaned, answers unified."""
    i = c("event_id")
    raw = t.read("events").select(
        i.alias("i"), F.when(i % 3 == 0, "Sim, tenho​").when(i % 3 == 1, "⁠Não ").alias(_CARD),
        F.when(i % 4 == 0, "Menos de 18 anos.").when(i % 4 == 1, "Mais de 55 anos").when(i % 4 == 2, " 18 - 24 anos").alias(_AGE), c("event_type").alias("Nome"),
        F.lit("x").alias("Unnamed: 3"), F.lit(1).alias("FAIXA"), F.lit(2).alias(" "), F.lit(3).alias("Remote IP"),
    )
    listed = col.drop_listed(raw, ("faixa",))
    return col.unify_categories(col.drop_technical(col.drop_campaign_columns(listed)))


# -- scalar steps -----------------------------------------------------------------------------

@query("scalar_cleaning", """SELECT event_id AS i, CASE event_id % 5 WHEN 0 THEN 'm' WHEN 1 THEN 'f' WHEN 2 THEN 'f' END AS gender, 'caf' || chr(233) || ' ' || user_id AS composed,
  CASE WHEN event_id % 3 = 0 THEN 1706659200 ELSE CAST(floor(epoch(ts)) AS BIGINT) END AS epoch, CASE event_id % 4 WHEN 0 THEN 10 WHEN 1 THEN 3 WHEN 2 THEN 7 END AS decile,
  CASE event_id % 6 WHEN 0 THEN 'LeadQualifiedHighQuality' WHEN 1 THEN 'LeadQualified' WHEN 2 THEN 'Faixa A' WHEN 3 THEN 'Lead' WHEN 4 THEN 'Lead' ELSE 'PURCHASE' END AS goal FROM events""")
def scalar_cleaning(t):
    """Gender, composed Unicode, epoch seconds, decile of a label, simplified goal."""
    i = c("event_id")
    gender = F.when(i % 5 == 0, " Masculino").when(i % 5 == 1, "F").when(i % 5 == 2, "Mulher ").when(i % 5 == 3, "x")
    when = F.when(i % 3 == 0, "ontem").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    label = F.when(i % 4 == 0, "D10").when(i % 4 == 1, "D03").when(i % 4 == 2, "D07")
    goal = F.when(i % 6 == 0, "offsite.LEAD_QUALIFIED_HIGH_QUALITY").when(i % 6 == 1, "x.LeadQualified").when(i % 6 == 2, "custom Faixa A").when(i % 6 == 3, "onsite leads").when(i % 6 == 5, "PURCHASE")
    return t.read("events").select(
        i.alias("i"), gender_code(gender).alias("gender"), tx.nfc(F.concat(F.lit("café "), c("user_id").cast("string"))).alias("composed"),
        epoch_seconds(when, F.lit(1706659200)).cast("long").alias("epoch"), decile_number(label).cast("int").alias("decile"), u.goal_name(goal).alias("goal"),
    )


@query("campaign_labels", sql("""SELECT lead_id, CASE WHEN lead_id % 3 = 0 THEN '[ML]       CAP/FRIO   2024-01-15' WHEN lead_id % 3 = 1 THEN '[FAIXA-A]  RET/MORNO' ELSE '[OUTRO]' END AS label,
  CASE lead_id % 3 WHEN 0 THEN 'Main' WHEN 1 THEN 'Second' ELSE 'act_9' END AS account FROM leads"""))
def campaign_labels(t):
    i = c("lead_id")
    name = F.when(i % 3 == 0, "X | MACHINE LEARNING | CAP | FRIO | 2024-01-15").when(i % 3 == 1, "Y | FAIXA A | RET | MORNO").otherwise("plain")
    account = F.when(i % 3 == 0, "act_1").when(i % 3 == 1, "Ads---Second-One.csv").otherwise("act_9")
    return t.leads.select("lead_id", u.short_label(name).alias("label"), u.account_label(account, {"act_1": "Main", "Second": "Second"}).alias("account"))


@query("confidence_levels", sql("""SELECT adset_id, CASE WHEN n < 7 * 3 THEN 'insuficiente' WHEN n < 7 * 10 THEN 'baixa' WHEN n < 7 * 20 THEN 'media' ELSE 'alta' END AS level FROM (SELECT adset_id, adset_id * 31 % 200 + count(*) % 7 AS n FROM ad_costs GROUP BY 1)"""))
def confidence_levels(t):
    counts = t.ad_costs.groupBy("adset_id").agg((F.first("adset_id") * 31 % 200 + F.count("*") % 7).alias("n"))
    return counts.select("adset_id", eco.confidence_level(c("n"), F.lit(7)).alias("level"))


@query("budgets_and_goals", sql("""SELECT adset_id, report_start, CASE WHEN adset_id % 4 = 0 THEN 12.5::DOUBLE WHEN adset_id % 4 = 1 THEN 0.0::DOUBLE END AS daily_budget, CASE WHEN adset_id % 4 = 2 THEN 300.0::DOUBLE END AS lifetime_budget,
  adset_id % 4 IN (0, 2) AS has_campaign_budget, CASE WHEN adset_id % 3 = 0 THEN 'LeadQualified' ELSE optimization_goal END AS goal FROM adset_rows"""))
def budgets_and_goals(t):
    """Budgets in cents, some unreadable; the promoted event before the optimisation goal."""
    i = c("adset_id")
    rows = t.adset_rows.select(
        "adset_id", "report_start", "optimization_goal", F.when(i % 4 == 0, "1250").when(i % 4 == 1, "0").when(i % 4 == 3, "-x").alias("daily_budget"),
        F.when(i % 4 == 2, "30000").alias("lifetime_budget"), F.when(i % 3 == 0, "LeadQualified").when(i % 3 == 1, "").alias("custom"))
    flagged = costs.with_budget_flag(rows)
    return flagged.select("adset_id", "report_start", "daily_budget", "lifetime_budget", "has_campaign_budget", costs.effective_goal(c("custom"), c("optimization_goal")).alias("goal"))


# -- event logs ---------------------------------------------------------------------------------

_LOG = """log AS (SELECT 'user' || user_id || '@mail.com' AS email, CASE event_id % 5 WHEN 0 THEN 'LeadQualified' WHEN 1 THEN 'LeadQualifiedHighQuality' WHEN 2 THEN 'Faixa A' END AS event
    FROM events WHERE event_id % 5 < 3)"""


def _log_lines(t):
    i = c("event_id")
    mail = F.concat(F.lit("User"), "user_id", F.lit("@Mail.com"))
    event = F.when(i % 5 == 0, "LeadQualified").when(i % 5 == 1, "LeadQualifiedHighQuality").when(i % 5 == 2, "Faixa A").otherwise("PageView")
    line = F.when(i % 5 == 4, F.concat(F.lit("INFO start "), mail)).otherwise(F.concat(F.lit("2024-01-02 INFO "), event, F.lit(" enviado: "), mail, F.lit(" (decil: D10)")))
    return t.read("events").select(line.alias("value"))


@query("log_events", f"WITH {_LOG} SELECT * FROM log")
def log_events(t):
    return reports.log_events(_log_lines(t))


@query("log_events_by_campaign", f"""WITH {_LOG} SELECT 'c' || (substr(split_part(email, '@', 1), 5)::INT % 9) AS campaign_id, count(*) FILTER (event = 'LeadQualifiedHighQuality') AS "LeadQualifiedHighQuality",
  count(*) FILTER (event = 'LeadQualified') AS "LeadQualified", count(*) FILTER (event = 'Faixa A') AS "Faixa A" FROM log WHERE substr(split_part(email, '@', 1), 5)::INT % 4 <> 0 GROUP BY 1""")
def log_events_by_campaign(t):
    users = t.read("events").select("user_id").distinct().filter("user_id % 4 <> 0")
    ids = users.select(F.concat(F.lit("user"), "user_id", F.lit("@mail.com")).alias("email"), F.concat(F.lit("c"), c("user_id") % 9).alias("campaign_id"))
    return reports.log_events_by_campaign(reports.log_events(_log_lines(t)), ids)


# -- sinks ----------------------------------------------------------------------------------------

@query("snapshot_reread", sql("SELECT id, email, event_id FROM captures ORDER BY created_at DESC, id DESC LIMIT 1000"))
def snapshot_reread(t):
    path = _folder(t, "snapshot")
    sinks.snapshot(t.captures.select("id", "email", "event_id", "created_at"), path)
    return t.spark.read.schema("id long, email string, event_id string").json(path)


@query("recent_captures_view", sql("SELECT id, email FROM captures WHERE created_at >= DATE '2024-01-18'"))
def recent_captures_view(t):
    name = f"recent_{uuid.uuid4().hex}"
    sinks.recent_view(t.captures, name, "2024-01-25")
    return t.spark.table(name).select("id", "email")


@query("categories_exported", """SELECT event_type AS value, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, event_type) AS INT) AS "rank", round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS pct FROM events GROUP BY 1""")
def categories_exported(t):
    path = _folder(t, "export")
    sinks.export_categories(t.read("events"), "event_type", path)
    return t.spark.read.option("header", True).csv(path).select("value", c("n").cast("long").alias("n"), c("rank").cast("int").alias("rank"), F.round(c("pct").cast("double"), 6).alias("pct"))


@query("scored_written", sql("SELECT lead_id, lead_score FROM leads ORDER BY lead_score DESC NULLS LAST, lead_id LIMIT 500"))
def scored_written(t):
    path = _folder(t, "scored")
    sinks.write_scored(t.scored.select("lead_id", "lead_score", "decile"), path, 500)
    return t.spark.read.parquet(f"{path}/leads").select("lead_id", "lead_score")


@query("captures_appended", sql("SELECT id, email, CAST(created_at AS DATE) AS day FROM captures"))
def captures_appended(t):
    path = _folder(t, "captures")
    rows = t.captures.select("id", "email", "created_at")
    for part in (rows.filter("id % 2 = 0"), rows.filter("id % 2 = 1")):
        sinks.append_captures(part, path)
    return t.spark.read.parquet(path).select("id", "email", "day")


@query("scores_at_rows", sql("SELECT lead_id AS row_id, email, CASE WHEN lead_id % 3 <> 0 THEN lead_score END AS lead_score, CASE WHEN lead_id % 3 <> 0 THEN decile END AS decile FROM scored"))
def scores_at_rows(t):
    scores = t.scored.filter("lead_id % 3 <> 0").select(c("lead_id").alias("row_id"), "lead_score", c("decile").cast("int").alias("decile"))
    return sinks.scores_to_rows(t.leads.select(c("lead_id").alias("row_id"), "email"), scores).select("row_id", "email", "lead_score", "decile")


# -- campaigns known by their id ------------------------------------------------------------------

@query("campaign_ids_named", sql("""SELECT lead_id, CASE WHEN lead_id % 3 = 0 THEN coalesce(n, right(campaign, 18)) ELSE campaign END AS campaign
FROM leads LEFT JOIN (SELECT campaign_id, min(campaign_name) AS n FROM ad_costs GROUP BY 1) d ON d.campaign_id = right(campaign, 18)"""))
def campaign_ids_named(t):
    """Bare campaign ids replaced by the campaign's name; all other texts stay."""
    bare = F.when(c("lead_id") % 3 == 0, F.concat(F.lit(" "), F.right("campaign", F.lit(18)))).otherwise(c("campaign"))
    out = names.name_ids(t.leads.select("lead_id", bare.alias("campaign")), t.ad_costs.select("campaign_id", "campaign_name").distinct())
    return out.select("lead_id", F.trim("campaign").alias("campaign"))


@query("leads_imputed", sql("""SELECT adset_id, CASE WHEN adset_id = 3 AND q > 0 THEN floor(q / r) ELSE n END AS leads FROM (
  SELECT adset_id, CAST(CASE WHEN adset_id = 3 THEN 0 ELSE count(*) END AS DOUBLE) AS n, CAST(count(*) FILTER (ad_id % 3 = 0) AS DOUBLE) AS q FROM ad_costs GROUP BY 1),
  (SELECT sum(q) / sum(n) AS r FROM (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (ad_id % 3 = 0) AS DOUBLE) AS q FROM ad_costs WHERE adset_id <> 3 GROUP BY adset_id) WHERE n > 0 AND q > 0)"""))
def leads_imputed(t):
    """A campaign whose lead event does not fire gets leads from the others' ratio of qualified leads."""
    stats = t.ad_costs.groupBy("adset_id").agg(F.count("*").cast("double").alias("n"), F.count_if(c("ad_id") % 3 == 0).cast("double").alias("lead_qualified"))
    named = F.concat(F.lit("Campaign | x |1"), F.lpad(c("adset_id").cast("string"), 14, "0"))
    stats = stats.select("adset_id", named.alias("campaign"), F.when(c("adset_id") != 3, c("n")).otherwise(0.0).alias("leads"), "lead_qualified")
    out = metrics.impute_leads(stats, Settings(impute_lead_ids=("1" + "3".rjust(14, "0"),)))
    return out.select("adset_id", c("leads").cast("double").alias("leads"))


@query("refined_groups", sql(f"""SELECT lead_id, CASE WHEN lead_id % 2 = 0 AND lead_id % 50 < 10 THEN 'Listed ' || (lead_id % 50) WHEN ml_type = 'SEM_ML' THEN '{compare.CONTROL}' ELSE '{compare.EVENTS}' END AS comparison_group FROM leads"""))
def refined_groups(t):
    """A lead's group by its captured campaign id, else by its class."""
    meta = F.when(c("lead_id") % 2 == 0, F.concat(F.lit("1"), F.lpad((c("lead_id") % 50).cast("string"), 14, "0"), F.lit("999")))
    leads = t.leads.select("lead_id", "campaign", u.campaign_class(c("campaign")).alias("ml_type"), meta.alias("campaign_id_meta"))
    groups = t.leads.filter("lead_id % 50 < 10").select((c("lead_id") % 50).alias("k")).distinct()
    groups = groups.select(F.concat(F.lit("1"), F.lpad(c("k").cast("string"), 14, "0")).alias("id15"), F.concat(F.lit("Listed "), "k").alias("comparison_group"))
    return compare.with_refined_group(leads, groups).select("lead_id", "comparison_group")
