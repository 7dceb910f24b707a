"""Queries: UTM cleaning and campaign names."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import utm as u
from ..operators import utm as ops
from .bindings import sql
from .registry import query

_MERGED = """aud AS (SELECT lead_id, CASE WHEN medium LIKE 'ADV |%' THEN trim(split_part(medium, '|', 2)) ELSE trim(medium) END AS m FROM leads),
cnt AS (SELECT m, regexp_replace(regexp_replace(lower(m), '\\s+', ' ', 'g'), '\\.+$', '') AS form, count(*) AS n FROM aud GROUP BY m),
rep AS (SELECT form, arg_min(m, (-n, m)) AS best FROM cnt GROUP BY form),
merged AS (SELECT aud.lead_id, CASE WHEN best = 'ABERTO' THEN 'Aberto' ELSE best END AS medium
  FROM aud JOIN cnt ON aud.m = cnt.m JOIN rep ON cnt.form = rep.form)"""
_TERM = """CASE WHEN term IN ('ig', 'instagram') THEN 'instagram' WHEN term IN ('fb', 'facebook') THEN 'facebook'
  WHEN regexp_full_match(term, '[0-9]{1,10}') THEN term WHEN term IS NOT NULL THEN 'outros' END"""


@query(
    "utm_cleaned",
    sql(f"""SELECT l.lead_id, {_TERM} AS term, m.medium,
  CASE m.medium WHEN '{{{{adset.name}}}}' THEN 'Outros' WHEN 'Aberto' THEN 'Aberto' ELSE 'Outros' END AS category
FROM leads l JOIN merged m ON l.lead_id = m.lead_id""".replace("{{", "{").replace("{adset.name}}}}", "{{adset.name}}"), _MERGED),
)
def utm_cleaned(t):
    df = ops.unify_term(ops.extract_audience(t.leads)).withColumn("category", F.col("medium"))
    mapping = t.spark.createDataFrame([("{{adset.name}}", "Outros"), ("paid", "Outros")], "value string, category string")
    valid = t.spark.createDataFrame([("Aberto",), ("Outros",)], "category string")
    return ops.map_categories(df, "category", mapping, valid).select("lead_id", "term", "medium", "category")


@query(
    "campaign_parsed",
    sql("""SELECT lead_id, right(campaign, 18) AS campaign_id, regexp_replace(campaign, '\\|[0-9]{18}$', '') AS base,
  right(campaign, 18) AS utm_id, substr(right(campaign, 18), 1, 15) AS id15, ml_type,
  concat(split_part(campaign, ' | ', 5), ' | 2024-01-01') AS adset,
  CASE WHEN medium LIKE '%{{%' THEN NULL ELSE medium END AS medium_valid, medium NOT LIKE '%{{%' AS valid,
  regexp_extract(term, '^(kw[0-9]+)--', 1) AS keyword, false AS bare_id
FROM leads""".replace("concat(split_part(campaign, ' | ', 5), ' | 2024-01-01')", "split_part(campaign, ' | ', 5)")),
)
def campaign_parsed(t):
    c = F.col("campaign")
    return t.leads.select(
        "lead_id", u.campaign_id(c).alias("campaign_id"), u.campaign_base(c).alias("base"), u.utm_id(c).alias("utm_id"),
        u.id_suffix(c).alias("id15"), u.campaign_class(c).alias("ml_type"), u.adset_from_campaign(c).alias("adset"),
        u.null_templates(F.col("medium")).alias("medium_valid"), u.valid_utm(F.col("medium")).alias("valid"),
        F.coalesce(u.keyword(F.col("term")), F.when(F.col("term").isNotNull(), "")).alias("keyword"),
        u.is_numeric_id(c).alias("bare_id"),
    )


@query(
    "url_source_term",
    """SELECT page_id, nullif(regexp_extract(url, 'utm_source=([^&#]+)', 1), '') AS source,
  nullif(regexp_extract(url, '\\b([0-9]{11,12})\\b', 1), '') AS utm_id, trim(split_part(url, '--', 1)) AS keyword FROM pages""",
)
def url_source_term(t):
    url = F.col("url")
    found = F.regexp_extract(url, "utm_source=([^&#]+)", 1)
    return t.read("pages").select(
        "page_id", F.when(found != "", found).alias("source"), u.utm_id(url).alias("utm_id"), u.keyword(url).alias("keyword")
    )


_NAMES = """v AS (SELECT lead_id, CASE WHEN lead_id % 10 = 3 THEN regexp_replace(campaign, '\\|[0-9]{18}$', '') ELSE campaign END AS campaign FROM leads),
n AS (SELECT DISTINCT campaign AS name, nullif(regexp_extract(campaign, '\\|([0-9]{18})$', 1), '') AS id, regexp_replace(campaign, '\\|[0-9]{18}$', '') AS base FROM v),
by_id AS (SELECT id, arg_min(name, (-length(name), name)) AS best FROM n WHERE id IS NOT NULL GROUP BY id),
by_base AS (SELECT n.base, arg_min(best, (-length(best), best)) AS best FROM n JOIN by_id ON n.id = by_id.id GROUP BY n.base)"""


@query(
    "name_consolidation",
    sql("""SELECT v.lead_id, coalesce(by_id.best, by_base.best, v.campaign) AS campaign_consolidated
FROM v JOIN n ON v.campaign = n.name LEFT JOIN by_id ON n.id = by_id.id LEFT JOIN by_base ON n.base = by_base.base""", _NAMES),
)
def name_consolidation(t):
    cut = F.when(F.col("lead_id") % 10 == 3, F.regexp_replace("campaign", r"\|[0-9]{18}$", "")).otherwise(F.col("campaign"))
    df = ops.consolidate_campaigns(t.leads.withColumn("campaign", cut))
    return df.select("lead_id", "campaign_consolidated")


@query(
    "class_counts",
    sql("""SELECT count(*) AS kept, 0 AS excluded, count(*) FILTER (ml_type = 'COM_ML') AS com_ml, count(*) FILTER (ml_type = 'SEM_ML') AS sem_ml,
  round(count(*) FILTER (ml_type = 'COM_ML') * 100.0 / count(*), 6) AS com_ml_pct,
  round(count(*) FILTER (ml_type = 'SEM_ML') * 100.0 / count(*), 6) AS sem_ml_pct FROM leads"""),
)
def class_counts(t):
    out = ops.class_counts(t.leads)
    return out.withColumns({c: F.round(c, 6) for c in ("com_ml_pct", "sem_ml_pct")})


@query("event_class", sql("""SELECT capi_type, count(*) AS n FROM (
  SELECT CASE WHEN optimization_goal = 'LeadQualified' THEN 'COM_CAPI' ELSE 'SEM_CAPI' END AS capi_type FROM adset_rows) GROUP BY capi_type"""))
def event_class(t):
    return ops.with_event_class(t.adset_rows).groupBy("capi_type").agg(F.count("*").alias("n"))


@query("campaign_list", sql("SELECT DISTINCT campaign FROM leads WHERE ml_type = 'COM_ML'"))
def campaign_list(t):
    return ops.campaign_list(ops.classify(t.leads), "COM_ML")
