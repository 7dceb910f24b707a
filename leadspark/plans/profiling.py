"""Queries: profiles, drift, leakage, splits, periods, sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as d
from ..operators import components as comp
from ..operators import drift as dr
from ..operators import profile as pr
from ..operators import splits as sp
from ..sources import leads as src
from ..sources import sales as sal
from .bindings import sql
from .registry import query

SURVEY = ("lang", "source", "n_chars", "quality", "toxic", "split")
FEATURES = ["lang", "source", "quality", "toxic"]


def _r(df, digits=9):
    return df.withColumns({c: F.round(c, digits) for c, k in df.dtypes if k == "double"})


_LONG = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value FROM survey" for c in SURVEY)


@query(
    "column_profile",
    sql(f"""SELECT "column", count(DISTINCT value) AS "distinct", count(*) - count(value) AS nulls,
  round((count(*) - count(value)) * 100.0 / count(*), 9) AS null_pct FROM ({_LONG}) GROUP BY "column\""""),
)
def column_profile(t):
    return _r(pr.column_profile(t.survey, list(SURVEY)))


@query("missing_rates", sql(f'SELECT "column", round((count(*) - count(value)) * 100.0 / count(*), 9) AS missing_pct FROM ({_LONG}) GROUP BY "column"'))
def missing_rates(t):
    return _r(pr.missing_rates(t.survey, list(SURVEY)))


@query(
    "category_shares",
    sql(f"""SELECT "column", value, count(*) AS n, row_number() OVER (PARTITION BY "column" ORDER BY count(*) DESC, value NULLS FIRST) AS rank,
  round(count(*) * 100.0 / (SELECT count(*) FROM survey), 9) AS pct FROM ({_LONG}) WHERE "column" IN ('lang', 'source', 'quality', 'toxic') GROUP BY "column", value"""),
)
def category_shares(t):
    return _r(pr.category_shares(t.survey, FEATURES))


@query("crosstab_margins", sql("SELECT lang, source, count(*) AS n, grouping(lang, source) AS level FROM survey GROUP BY CUBE (lang, source)"))
def crosstab_margins(t):
    return pr.crosstab(t.survey, "lang", "source")


_DRIFT = f"""long AS (SELECT split, "column" AS feature, value AS category FROM ({" UNION ALL ".join(f"SELECT split, '{c}' AS " + '"column"' + f", CAST({c} AS VARCHAR) AS value FROM survey" for c in FEATURES)}) WHERE value IS NOT NULL),
counts AS (SELECT feature, category, count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'prod') AS n_prod FROM long GROUP BY 1, 2),
pcts AS (SELECT *, CASE WHEN n_train > 0 THEN round(n_train * 100.0 / sum(n_train) OVER (PARTITION BY feature), 2) END AS a,
   CASE WHEN n_prod > 0 THEN round(n_prod * 100.0 / sum(n_prod) OVER (PARTITION BY feature), 2) END AS b FROM counts),
shares AS (SELECT feature, category, n_train, n_prod, coalesce(a, 0.0) AS train_pct, coalesce(b, 0.0) AS prod_pct, coalesce(round(b - a, 2), 0.0) AS diff_pp,
   abs(coalesce(round(b - a, 2), 0.0)) AS abs_diff_pp FROM pcts)"""


def _shares(t):
    return dr.drift_shares(t.survey.filter("split = 'train'"), t.survey.filter("split = 'prod'"), FEATURES)


@query("drift_shares", sql("SELECT * FROM shares", _DRIFT))
def drift_shares(t):
    return _shares(t)


@query(
    "drift_kl",
    sql("""SELECT feature, round(sum(p / sp * ln((p / sp) / (q / sq))), 9) AS kl FROM (
  SELECT *, sum(p) OVER (PARTITION BY feature) AS sp, sum(q) OVER (PARTITION BY feature) AS sq FROM (
    SELECT feature, n_train::DOUBLE / sum(n_train) OVER (PARTITION BY feature) + 1e-10 AS p, n_prod::DOUBLE / sum(n_prod) OVER (PARTITION BY feature) + 1e-10 AS q FROM counts))
GROUP BY feature""", _DRIFT),
)
def drift_kl(t):
    return _r(dr.drift_kl(_shares(t)))


@query(
    "drift_summary",
    sql("""SELECT feature, max(abs_diff_pp) AS max_drift, round(avg(abs_diff_pp), 9) AS mean_drift, arg_max(category, (abs_diff_pp, category)) AS worst_category,
  arg_max(diff_pp, (abs_diff_pp, category)) AS worst_diff_pp, CASE WHEN max(abs_diff_pp) > 5 THEN 'high' WHEN max(abs_diff_pp) > 2 THEN 'moderate' ELSE 'stable' END AS status
FROM shares GROUP BY feature""", _DRIFT),
)
def drift_summary(t):
    return dr.drift_summary(_shares(t)).withColumn("mean_drift", F.round("mean_drift", 9))


@query(
    "weekly_top_decile",
    sql("""SELECT CAST(date_trunc('week', captured_at) AS DATE) AS week, count(*) AS total_leads, count(*) FILTER (decile = 10) AS top_leads, min(captured_at) AS first_lead,
  round(count(*) FILTER (decile = 10) * 100.0 / count(*), 2) AS top_pct, round(round(count(*) FILTER (decile = 10) * 100.0 / count(*), 2) - 10.5, 2) AS diff_vs_training
FROM scored GROUP BY 1"""),
)
def weekly_top_decile(t):
    return dr.weekly_top_share(t.scored, 10.5)


_SPLIT = """ordered AS (SELECT *, row_number() OVER (ORDER BY captured_at, lead_id) AS rn, count(*) OVER () AS n FROM leads),
halves AS (SELECT *, CASE WHEN rn <= CAST(floor(n * 0.7) AS BIGINT) THEN 'train' ELSE 'test' END AS split FROM ordered)"""


@query("temporal_split", sql("SELECT lead_id, split FROM halves", _SPLIT))
def temporal_split(t):
    return sp.split_by_leads(t.leads).select("lead_id", "split")


@query(
    "temporal_split_days",
    sql("""SELECT lead_id, CASE WHEN captured_at <= (SELECT min(captured_at) + CAST(floor(datediff('microsecond', min(captured_at), max(captured_at)) // 86400000000 * 0.7) AS INT) * INTERVAL 1 DAY FROM leads)
  THEN 'train' ELSE 'test' END AS split FROM leads"""),
)
def temporal_split_days(t):
    return sp.split_by_days(t.leads).select("lead_id", "split")


@query(
    "leakage",
    sql("""SELECT "by", count(*) FILTER (te) AS test_persons, count(*) FILTER (te AND tr) AS in_both, round(count(*) FILTER (te AND tr) * 100.0 / count(*) FILTER (te), 9) AS leakage_pct
FROM (SELECT "by", person, bool_or(split = 'train') AS tr, bool_or(split = 'test') AS te FROM (
    SELECT 'email' AS "by", email AS person, split FROM halves UNION ALL SELECT 'phone', phone, split FROM halves
    UNION ALL SELECT 'both', concat_ws(',', 'e:' || email, 't:' || phone), split FROM halves) WHERE person IS NOT NULL AND person <> '' GROUP BY 1, 2) GROUP BY 1""", _SPLIT),
)
def leakage(t):
    s = sp.split_by_leads(t.leads)
    return _r(dr.leakage(s.filter("split = 'train'"), s.filter("split = 'test'"), dr.person_keys()))


@query(
    "launch_periods",
    """SELECT CAST(s AS DATE) AS start, CAST(s AS DATE) AS capture_start, CAST(s AS DATE) + 6 AS capture_end, CAST(s AS DATE) + 7 AS nurture_start, CAST(s AS DATE) + 12 AS nurture_end,
  CAST(s AS DATE) + 13 AS sales_start, CAST(s AS DATE) + 19 AS sales_end, isodow(s) = 2 AS capture_starts_tuesday, isodow(s + INTERVAL 13 DAY) = 1 AS sales_start_monday,
  true AS capture_length_ok, true AS sales_length_ok, true AS gap_ok, isodow(s) = 2 AND isodow(s + INTERVAL 13 DAY) = 1 AS all_ok
FROM (SELECT DISTINCT o_orderdate AS s FROM orders)""",
)
def launch_periods(t):
    starts = t.read("orders").select(F.col("o_orderdate").cast("date").alias("start")).distinct()
    out = starts.withColumns(d.launch_periods(F.col("start")))
    c = F.col
    return out.withColumns(d.period_flags(c("capture_start"), c("capture_end"), c("sales_start"), c("sales_end")))


@query(
    "sales_combined",
    sql("""SELECT email, sale_date, sale_origin, sale_value FROM (
  SELECT *, row_number() OVER (PARTITION BY email, sale_date ORDER BY CASE sale_origin WHEN 'guru' THEN 0 ELSE 1 END, sale_value DESC NULLS LAST) AS rn
  FROM (SELECT * REPLACE (CASE WHEN sale_id % 4 <> 1 THEN sale_value END AS sale_value) FROM sales)) WHERE rn = 1"""),
)
def sales_combined(t):
    """Every fourth sale or so has an unreadable price."""
    sales = t.sales.withColumn("sale_value", F.when(F.col("sale_id") % 4 != 1, F.col("sale_value")))
    a, b = sales.filter("sale_origin = 'guru'"), sales.filter("sale_origin = 'tmb'")
    return sal.combine_sales(a, b).select("email", "sale_date", "sale_origin", "sale_value")


_COMBINED = """own AS (SELECT DISTINCT email, captured_at FROM leads WHERE email IS NOT NULL AND medium = 'ABERTO' AND captured_at >= DATE '2024-01-05' AND captured_at < DATE '2024-01-16'),
extra AS (SELECT email, captured_at, substr(right(campaign, 18), 1, 15) AS campaign_id_meta FROM leads
  WHERE email IS NOT NULL AND captured_at >= DATE '2024-01-05' AND captured_at < DATE '2024-01-16' AND email NOT IN (SELECT email FROM own)),
both_sources AS (SELECT email, captured_at, NULL AS campaign_id_meta, 'survey' AS source_type FROM own UNION ALL SELECT email, captured_at, campaign_id_meta, 'capi' FROM extra)"""


def _sources(t):
    survey = t.leads.filter("medium = 'ABERTO' AND email IS NOT NULL").select("email", "phone", "captured_at", "campaign", "medium", "term", "lead_score")
    return survey, src.captured_leads(t.captures)


@query("leads_combined", sql("SELECT email, captured_at, campaign_id_meta, source_type FROM both_sources", _COMBINED))
def leads_combined(t):
    return src.combined_leads(*_sources(t), "2024-01-05", "2024-01-15").select("email", "captured_at", "campaign_id_meta", "source_type")


@query(
    "leads_combined_counts",
    sql("""SELECT count(*) FILTER (source_type = 'survey') AS survey_leads, count(*) FILTER (source_type = 'capi') AS capi_leads_extras,
  (SELECT count(DISTINCT email) FROM leads WHERE captured_at >= DATE '2024-01-05' AND captured_at < DATE '2024-01-16') AS capi_leads_total FROM both_sources""", _COMBINED),
)
def leads_combined_counts(t):
    survey, captures = _sources(t)
    period = ("2024-01-05", "2024-01-15")
    return src.source_counts(survey, captures, src.combined_leads(survey, captures, *period), *period)


@query(
    "capture_fill_rates",
    sql("""SELECT count(*) AS total, count(DISTINCT email) AS distinct_email, count(fbp) AS with_fbp, count(fbc) AS with_fbc, count(*) FILTER (fbp IS NOT NULL AND fbc IS NOT NULL) AS with_all,
  round(count(fbp) * 100.0 / count(*), 9) AS fbp_pct, round(count(fbc) * 100.0 / count(*), 9) AS fbc_pct FROM captures"""),
)
def capture_fill_rates(t):
    return _r(pr.capture_stats(t.captures))


@query("table_stats", sql("SELECT count(*) AS \"rows\", count(DISTINCT email) AS distinct_keys, min(created_at) AS first_time, max(created_at) AS last_time FROM captures"))
def table_stats(t):
    return pr.table_stats(t.captures)


@query(
    "phone_validity",
    sql("""SELECT ml_type, count(*) AS "rows", count(phone) AS valid, round(count(phone) * 100.0 / count(*), 9) AS valid_pct FROM leads GROUP BY ml_type"""),
)
def phone_validity(t):
    from ..operators.utm import with_class

    return _r(pr.phone_validity(with_class(t.leads), "ml_type"))


@query(
    "latest_captures",
    sql("SELECT email, arg_max(event_id, (created_at, id)) AS event_id FROM captures WHERE email IS NOT NULL GROUP BY email"),
)
def latest_captures(t):
    return src.latest_by_email(t.captures.filter("email IS NOT NULL")).select("email", "event_id")


@query("recent_captures", sql("SELECT id, email, created_at FROM captures WHERE created_at >= DATE '2024-01-10' AND created_at < DATE '2024-01-21' ORDER BY created_at DESC, id DESC LIMIT 500"))
def recent_captures(t):
    return src.most_recent(t.captures, 500, "2024-01-10", "2024-01-20").select("id", "email", "created_at")


@query("email_campaign_ids", sql("SELECT email, arg_max(right(utm_campaign, 18), (created_at, id)) AS campaign_id FROM captures WHERE email IS NOT NULL GROUP BY email"))
def email_campaign_ids(t):
    return src.email_campaign_ids(t.captures)


@query("utm_fill", sql("""SELECT count(*) AS leads, 100.0 AS utm_campaign_pct, 100.0 AS utm_medium_pct, round(count(utm_term) * 100.0 / count(*), 9) AS utm_term_pct FROM captures"""))
def utm_fill(t):
    return _r(src.utm_fill(t.captures, ("utm_campaign", "utm_medium", "utm_term")))


_EDGES = """edges_all AS (SELECT lead_id, email, phone FROM leads),
nodes AS (SELECT DISTINCT email AS e, phone AS p FROM leads WHERE email IS NOT NULL AND phone IS NOT NULL)"""


@query(
    "person_components",
    # every e-mail of the bound leads goes with one phone and back, so pairs are components
    sql("""SELECT lead_id, min(lead_id) OVER (PARTITION BY coalesce(n.e, l.email, p.e, l.phone, CAST(lead_id AS VARCHAR))) AS first_lead
FROM leads l LEFT JOIN nodes n ON l.email = n.e LEFT JOIN nodes p ON l.phone = p.p""", _EDGES),
)
def person_components(t):
    labelled = comp.person_components(t.leads)
    first = labelled.groupBy("person").agg(F.min("lead_id").alias("first_lead"))
    return labelled.join(first, "person").select("lead_id", "first_lead")


@query(
    "component_sizes",
    sql("""SELECT size, count(*) AS persons, sum(size) AS leads FROM (SELECT count(*) AS size FROM leads l LEFT JOIN nodes n ON l.email = n.e LEFT JOIN nodes p ON l.phone = p.p
  GROUP BY coalesce(n.e, l.email, p.e, l.phone, CAST(lead_id AS VARCHAR))) GROUP BY size""", _EDGES),
)
def component_sizes(t):
    return comp.component_sizes(comp.person_components(t.leads))
