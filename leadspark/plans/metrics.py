"""Queries: campaign, decile, arm and overall metrics; adset and ad comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import CORRECTED_RATES, DECILES, Settings
from ..operators import compare as cmp
from ..operators import controls as ctl
from ..operators import metrics as ops
from ..operators import utm as names
from ..session import stored
from .bindings import sql
from .costs import _COSTS, _campaign_costs
from .registry import query

FACTOR = (0.5605 + 0.6817) / 2
_ADJ = f"CASE WHEN sale_origin = 'tmb' THEN sale_value * {FACTOR!r}::DOUBLE ELSE sale_value END"

_CAMPAIGNS = _COSTS + f""", best AS (SELECT right(campaign, 18) AS id, arg_min(campaign, (-length(campaign), campaign)) AS name FROM leads GROUP BY 1),
stats AS (SELECT m.ml_type, b.name AS campaign, b.id, count(m.email) AS responses, sum(sale_value) AS total_revenue,
    count(DISTINCT m.email) FILTER (converted) AS conversions, coalesce(sum({_ADJ}) FILTER (converted), 0.0) AS total_revenue_adjusted
  FROM matched m JOIN best b ON right(m.campaign, 18) = b.id GROUP BY 1, 2, 3),
cut_ids AS (SELECT substr(campaign_id, 1, 15) AS k, arg_min(spend, campaign_id) AS spend, arg_min(leads, campaign_id) AS leads,
    arg_min(lead_qualified, campaign_id) AS lead_qualified, arg_min(optimization_goal, campaign_id) AS optimization_goal FROM costs GROUP BY 1),
found AS (SELECT s.*, coalesce(c.spend, p.spend) AS spend, coalesce(c.leads, p.leads) AS leads, coalesce(c.lead_qualified, p.lead_qualified) AS lead_qualified,
    coalesce(c.optimization_goal, p.optimization_goal) AS optimization_goal, c.budget, c.num_creatives, c.account_id
  FROM stats s LEFT JOIN costs c ON s.id = c.campaign_id LEFT JOIN cut_ids p ON substr(s.id, 1, 15) = p.k),
campaign_metrics AS (
  SELECT s.ml_type, s.campaign, s.responses, s.conversions, round(s.total_revenue, 2) AS total_revenue, round(s.total_revenue_adjusted, 2) AS total_revenue_adjusted,
    coalesce(s.spend, 0) AS spend, coalesce(s.leads, 0) AS leads, coalesce(s.lead_qualified, 0) AS lead_qualified, coalesce(s.budget, 0) AS budget,
    coalesce(s.num_creatives, 0) AS num_creatives, s.account_id, coalesce(s.optimization_goal, '') AS optimization_goal,
    round(CASE WHEN s.leads > 0 THEN s.responses / s.leads * 100 ELSE 0 END, 2) AS response_rate,
    round(CASE WHEN s.leads > 0 THEN s.conversions / s.leads * 100 ELSE 0 END, 2) AS conversion_rate,
    round(CASE WHEN s.leads > 0 THEN s.spend / s.leads ELSE 0 END, 2) AS cpl, round(CASE WHEN s.spend > 0 THEN s.total_revenue / s.spend ELSE 0 END, 2) AS roas,
    round(s.total_revenue - coalesce(s.spend, 0), 2) AS contribution_margin,
    round(CASE WHEN s.spend > 0 THEN s.total_revenue_adjusted / s.spend ELSE 0 END, 2) AS roas_adjusted,
    round(CASE WHEN s.spend > 0 THEN round(s.total_revenue - s.spend, 2) / s.spend * 100 ELSE 0 END, 2) AS margin_percent
  FROM found s WHERE coalesce(s.spend, 0) > 0 OR coalesce(s.leads, 0) > 0 OR s.conversions > 0)"""


def _metrics(t):
    return ops.campaign_metrics(t.matched, _campaign_costs(t))


@query("campaign_metrics", sql("SELECT * FROM campaign_metrics", _CAMPAIGNS))
def campaign_metrics(t):
    return _metrics(t).withColumns({c: F.round(c, 2) for c in ("total_revenue", "total_revenue_adjusted")})


@query("top_campaigns", sql("SELECT campaign, ml_type, contribution_margin FROM campaign_metrics ORDER BY contribution_margin DESC, campaign, ml_type LIMIT 15", _CAMPAIGNS))
def top_campaigns(t):
    return ops.top_campaigns(_metrics(t)).select("campaign", "ml_type", "contribution_margin")


@query(
    "adjusted_metrics",
    sql(f"""SELECT count(*) AS conversions, count(*) FILTER (sale_origin = 'tmb') AS conversions_tmb, count(*) FILTER (sale_origin = 'guru') AS conversions_guru,
  round(sum(sale_value), 2) AS revenue, round(sum({_ADJ}), 2) AS revenue_adjusted, round(sum(sale_value) FILTER (sale_origin = 'tmb'), 2) AS revenue_tmb,
  round(sum({_ADJ}) FILTER (sale_origin = 'tmb'), 2) AS revenue_tmb_adjusted, round(sum(sale_value) FILTER (sale_origin = 'guru'), 2) AS revenue_guru,
  round(sum(sale_value) - sum({_ADJ}), 2) AS adjustment, round(sum(sale_value) / (SELECT sum(spend) FROM ad_costs), 2) AS roas,
  round(sum({_ADJ}) / (SELECT sum(spend) FROM ad_costs), 2) AS roas_adjusted, {FACTOR!r}::DOUBLE AS factor FROM matched WHERE converted"""),
)
def adjusted_metrics(t):
    return ops.adjusted_overall(t.matched, t.ad_costs)


_MEASURES = ("leads", "conversions", "total_revenue", "spend", "total_revenue_adjusted", "conversion_rate", "cpl", "roas", "margin", "roas_adjusted", "margin_adjusted")
_ARMS = """arm AS (SELECT ml_type, sum(leads) AS leads, sum(conversions) AS conversions, round(sum(total_revenue), 2) AS total_revenue, sum(spend) AS spend,
  round(sum(total_revenue_adjusted), 2) AS total_revenue_adjusted, round(sum(conversions) / sum(leads) * 100, 2) AS conversion_rate, round(sum(spend) / sum(leads), 2) AS cpl,
  round(sum(total_revenue) / sum(spend), 2) AS roas, round(sum(total_revenue) - sum(spend), 2) AS margin,
  round(sum(total_revenue_adjusted) / sum(spend), 2) AS roas_adjusted, round(sum(total_revenue_adjusted) - sum(spend), 2) AS margin_adjusted FROM campaign_metrics GROUP BY ml_type)"""
_ARM_SQL = ", ".join(
    f"t.{m} AS treated_{m}, c.{m} AS control_{m}, round(CASE WHEN c.{m} = 0 THEN 0 ELSE (t.{m} - c.{m}) / c.{m} * 100 END, 2) AS diff_{m}" for m in _MEASURES
)


@query("ml_vs_control", sql(f"SELECT {_ARM_SQL} FROM arm t, arm c WHERE t.ml_type = 'COM_ML' AND c.ml_type = 'SEM_ML'", _CAMPAIGNS + ", " + _ARMS))
def ml_vs_control(t):
    return ops.compare_arms(_metrics(t))


@query(
    "overall_stats",
    sql("""SELECT (SELECT count(*) FROM matched) AS total_leads, (SELECT count(*) FROM matched WHERE converted) AS matched_conversions,
  (SELECT count(*) FROM matched WHERE converted AND sale_origin = 'guru') AS conversions_guru_matched,
  (SELECT count(*) FROM matched WHERE converted AND sale_origin = 'tmb') AS conversions_tmb_matched,
  count(*) AS total_conversions, round(sum(sale_value), 2) AS total_revenue, count(*) FILTER (sale_origin = 'guru') AS conversions_guru_total,
  count(*) FILTER (sale_origin = 'tmb') AS conversions_tmb_total, (SELECT sum(spend) FROM campaign_metrics) AS total_spend,
  (SELECT sum(leads) FROM campaign_metrics) AS total_leads_meta, 0 AS excluded_leads, (SELECT count(*) FROM matched) AS total_leads_including_excluded,
  round(count(*) * 100.0 / (SELECT count(*) FROM matched), 2) AS conversion_rate, round(sum(sale_value) / (SELECT sum(spend) FROM campaign_metrics), 2) AS roas,
  round(sum(sale_value) - (SELECT sum(spend) FROM campaign_metrics), 2) AS margin FROM sales""", _CAMPAIGNS),
)
def overall_stats(t):
    return ops.overall_stats(t.matched, _metrics(t), t.sales)


_RATE = " ".join(f"WHEN {k} THEN {r}::DOUBLE" for k, r in zip(DECILES, CORRECTED_RATES))


@query(
    "decile_performance",
    sql("SELECT decile, leads, conversions_guru, conversions_total, round(x, 2) AS expected_conversion_rate, " + ", ".join(
        f"round(conversions_{k} * 100.0 / leads, 2) AS conversion_rate_{k}, round(conversions_{k} * 100.0 / leads / x, 2) AS performance_ratio_{k}, conversions_{k} * 2000.0 AS revenue_{k}"
        for k in ("guru", "total")) + f""" FROM (SELECT decile, count(*) AS leads, count(*) FILTER (converted AND sale_origin = 'guru') AS conversions_guru,
  count(*) FILTER (converted) AS conversions_total, CASE decile {_RATE} END * 100.0 AS x FROM matched GROUP BY decile)"""),
)
def decile_performance(t):
    return ops.decile_performance(t.matched)


@query(
    "group_metrics",
    sql("""SELECT g.comparison_group, leads, conversions, round(revenue, 2) AS total_revenue, spend, round(conversions * 100.0 / leads, 2) AS conversion_rate,
  round(spend / leads, 2) AS cpl, round(CASE WHEN spend > 0 THEN revenue / spend ELSE 0 END, 2) AS roas, round(revenue - spend, 2) AS margin FROM
 (SELECT comparison_group, count(*) AS leads, count(DISTINCT email) FILTER (converted) AS conversions, coalesce(sum(sale_value) FILTER (converted), 0) AS revenue FROM leads_arms GROUP BY 1) g
 LEFT JOIN (SELECT comparison_group, sum(spend) AS spend FROM (SELECT DISTINCT comparison_group, campaign FROM leads_arms)
   JOIN (SELECT campaign, max(spend) AS spend FROM campaign_metrics GROUP BY campaign) USING (campaign) GROUP BY 1) s ON g.comparison_group = s.comparison_group""", _CAMPAIGNS),
)
def group_metrics(t):
    return ops.group_metrics(t.leads_arms, _metrics(t))


_PAIRS = """pairs AS (SELECT adset_name FROM (SELECT adset_name, ml_type, sum(spend) AS s FROM adset_rows GROUP BY 1, 2) WHERE s >= 200
  GROUP BY adset_name HAVING count(DISTINCT ml_type) = 2),
ad_pairs AS (SELECT ad_code FROM (SELECT ad_code, ml_type, sum(spend) AS s FROM ad_rows GROUP BY 1, 2) WHERE s >= 200 GROUP BY ad_code HAVING count(DISTINCT ml_type) = 2)"""


@query("matched_pairs", sql("SELECT campaign_id, adset_id, adset_name, report_start, spend, leads_standard AS leads FROM adset_rows WHERE adset_name IN (SELECT adset_name FROM pairs)", _PAIRS))
def matched_pairs(t):
    return cmp.matched_adsets(t.adset_rows).select("campaign_id", "adset_id", "adset_name", "report_start", "spend", "leads")


@query("matched_ad_pairs", sql("SELECT campaign_id, adset_id, ad_id, ad_code, spend FROM ad_rows WHERE ad_code IN (SELECT ad_code FROM ad_pairs)", _PAIRS))
def matched_ad_pairs(t):
    return cmp.matched_ads(t.ad_rows).select("campaign_id", "adset_id", "ad_id", "ad_code", "spend")


_SETS = _PAIRS + f""", lead_sets AS (SELECT campaign_id, regexp_replace(medium, '\\s+', ' ', 'g') AS medium, count(DISTINCT email) FILTER (converted) AS conversions,
    coalesce(sum(sale_value) FILTER (converted), 0.0) AS revenue, coalesce(sum({_ADJ}) FILTER (converted), 0.0) AS revenue_adjusted FROM leads_arms GROUP BY 1, 2),
by15 AS (SELECT substr(campaign_id, 1, 15) AS c15, regexp_replace(medium, '\\s+', ' ', 'g') AS medium, count(DISTINCT email) FILTER (converted) AS conversions,
    coalesce(sum(sale_value) FILTER (converted), 0.0) AS revenue, coalesce(sum({_ADJ}) FILTER (converted), 0.0) AS revenue_adjusted FROM leads_arms GROUP BY 1, 2),
fix AS (SELECT a.c15, a.adset_name, max(b.conversions) AS conversions FROM (SELECT DISTINCT substr(campaign_id, 1, 15) AS c15, adset_name FROM adset_rows) a
  JOIN by15 b ON a.c15 = b.c15 AND lower(a.adset_name) = lower(b.medium)
  WHERE b.conversions > 0 AND NOT EXISTS (SELECT 1 FROM adset_rows x WHERE substr(x.campaign_id, 1, 15) = b.c15 AND x.adset_name = b.medium) GROUP BY 1, 2),
sets AS (SELECT a.campaign_id, a.adset_id, a.ml_type, a.adset_name, a.spend, a.leads, coalesce(f.conversions, b.conversions, 0) AS conversions,
    coalesce(b.revenue, 0.0) AS revenue, coalesce(b.revenue_adjusted, 0.0) AS revenue_adjusted
  FROM (SELECT campaign_id, adset_id, min(ml_type) AS ml_type, min(adset_name) AS adset_name, sum(spend) AS spend, sum(leads_standard) AS leads FROM adset_rows GROUP BY 1, 2) a
  LEFT JOIN by15 b ON substr(a.campaign_id, 1, 15) = b.c15 AND a.adset_name = b.medium
  LEFT JOIN fix f ON substr(a.campaign_id, 1, 15) = f.c15 AND a.adset_name = f.adset_name)"""


def _unit(c: str) -> str:
    return f"CASE WHEN {c} = 0 THEN 1.0 ELSE {c} END"


_UNITS = {
    "cpl": f"spend / {_unit('leads')}", "cpa": f"spend / {_unit('conversions')}", "conversion_rate": f"conversions / {_unit('leads')} * 100",
    "roas": f"revenue / {_unit('spend')}", "margin": "revenue - spend", "margin_pct": f"(revenue - spend) / {_unit('revenue')} * 100",
}


@query(
    "adset_comparison",
    sql(f"""SELECT ml_type, count(DISTINCT adset_name) AS names, sum(spend) AS spend, sum(leads) AS leads, sum(conversions) AS conversions,
  round(sum(revenue), 2) AS revenue, round(sum(revenue_adjusted), 2) AS revenue_adjusted, round(sum(revenue - spend), 2) AS margin,
  {", ".join(f"round(avg({_UNITS[k]}), 4) AS mean_{k}" for k in ("cpl", "cpa", "conversion_rate", "roas", "margin_pct"))},
  round(sum(revenue) / sum(spend), 4) AS roas, round(sum(revenue_adjusted) / sum(spend), 4) AS roas_adjusted,
  round(sum(revenue_adjusted) - sum(spend), 2) AS margin_adjusted FROM sets GROUP BY ml_type""", _SETS),
)
def adset_comparison(t):
    out = cmp.compare_adsets(t.adset_rows.drop("report_start", "report_end", "budget"), t.leads_arms)["aggregated"]
    money = ("revenue", "revenue_adjusted", "margin", "margin_adjusted")
    return out.withColumns({c: F.round(c, 2 if c in money else 4) for c, k in out.dtypes if k == "double"})


@query(
    "adset_comparison_detail",
    sql(f"""SELECT campaign_id, adset_id, adset_name, CASE ml_type WHEN 'COM_ML' THEN 'Eventos ML' ELSE 'Controle' END AS comparison_group,
  spend, leads, conversions, round(revenue, 2) AS revenue, {", ".join(f"round({v}, 4) AS {k}" for k, v in _UNITS.items())} FROM sets""", _SETS),
)
def adset_comparison_detail(t):
    out = cmp.compare_adsets(t.adset_rows.drop("report_start", "report_end", "budget"), t.leads_arms)["detailed"]
    return out.select(
        "campaign_id", "adset_id", "adset_name", "comparison_group", "spend", "leads", "conversions", F.round("revenue", 2).alias("revenue"),
        *[F.round(k, 4).alias(k) for k in _UNITS],
    )


@query(
    "all_adsets_comparison",
    sql(f"""SELECT comparison_group, sum(leads) AS leads, sum(conversions) AS conversions, sum(spend) AS spend, round(sum(revenue), 2) AS revenue,
  round(sum(revenue_adjusted), 2) AS revenue_adjusted, round(sum(revenue) - sum(spend), 2) AS margin, round(sum(conversions) / sum(leads), 6) AS conversion_rate,
  round(sum(spend) / sum(leads), 6) AS cpl, round(sum(revenue) / sum(spend), 6) AS roas, round(sum(revenue_adjusted) / sum(spend), 6) AS roas_adjusted,
  round(sum(revenue_adjusted) - sum(spend), 2) AS margin_adjusted
FROM (SELECT substr(campaign_id, 1, 15) AS c15, adset_name, sum(spend) AS spend, sum(leads_standard) AS leads FROM adset_rows GROUP BY 1, 2) a
JOIN (SELECT substr(campaign_id, 1, 15) AS c15, regexp_replace(medium, '\\s+', ' ', 'g') AS medium, comparison_group, count(DISTINCT email) FILTER (converted) AS conversions,
    coalesce(sum(sale_value) FILTER (converted), 0.0) AS revenue, coalesce(sum({_ADJ}) FILTER (converted), 0.0) AS revenue_adjusted FROM leads_arms GROUP BY 1, 2, 3) b
  ON a.c15 = b.c15 AND a.adset_name = b.medium GROUP BY comparison_group"""),
)
def all_adsets_comparison(t):
    out = cmp.compare_all_adsets(t.adset_rows, t.leads_arms)
    money = ("revenue", "revenue_adjusted", "margin", "margin_adjusted")
    return out.withColumns({c: F.round(c, 2 if c in money else 6) for c, k in out.dtypes if k == "double"})


_ADS = _PAIRS + """, lead_ads AS (SELECT substr(campaign_id, 1, 15) AS c15, ad_code, count(*) AS leads, count(DISTINCT email) FILTER (converted) AS conversions,
    coalesce(sum(sale_value) FILTER (converted), 0.0) AS revenue FROM leads_arms GROUP BY 1, 2),
ads_full AS (SELECT a.*, coalesce(l.leads, 0) AS leads, coalesce(l.conversions, 0) AS conversions, coalesce(l.revenue, 0.0) AS revenue,
    CASE ml_type WHEN 'COM_ML' THEN 'Eventos ML' ELSE 'Controle' END AS comparison_group
  FROM (SELECT substr(campaign_id, 1, 15) AS c15, ad_code, ml_type, sum(spend) AS spend FROM {rows} GROUP BY 1, 2, 3) a
  LEFT JOIN lead_ads l ON a.c15 = l.c15 AND a.ad_code = l.ad_code)"""
_AD_SQL = f"""SELECT comparison_group, count(DISTINCT ad_code) AS ad_codes, sum(spend) AS spend, sum(leads) AS leads, sum(conversions) AS conversions,
  round(sum(revenue - spend), 2) AS margin, {", ".join(f"round(avg({_UNITS[k]}), 4) AS {k}" for k in ("cpl", "cpa", "conversion_rate", "roas", "margin_pct"))}
FROM ads_full GROUP BY comparison_group"""


def _ad_table(out):
    return out.withColumns({c: F.round(c, 2 if c == "margin" else 4) for c, k in out.dtypes if k == "double"})


@query("ad_comparison", sql(_AD_SQL, _ADS.replace("{rows}", "ad_rows")))
def ad_comparison(t):
    return _ad_table(cmp.compare_ads(t.ad_rows, t.leads_arms)["aggregated"])


@query(
    "ad_comparison_matched",
    sql(_AD_SQL, _ADS.replace("{rows}", "(SELECT * FROM ad_rows WHERE adset_name IN (SELECT adset_name FROM pairs) AND ad_code IN "
        "(SELECT ad_code FROM ad_rows WHERE adset_name IN (SELECT adset_name FROM pairs) GROUP BY ad_code HAVING count(DISTINCT ml_type) = 2))")),
)
def ad_comparison_matched(t):
    sets = cmp.names_in_both_arms(t.adset_rows, "adset_name")
    # the codes of both arms and the ads themselves are taken from one written table
    ads = cmp.ads_in_matched_adsets(stored(t.ad_rows, "ad-rows"), sets, both_arms=True)
    return _ad_table(cmp.compare_ads(ads, t.leads_arms)["aggregated"])


@query(
    "refined_groups",
    sql("""SELECT substr(campaign_id, 1, 15) AS id15, CASE WHEN max(ml_type) = 'SEM_ML' THEN 'Controle' WHEN max(CASE WHEN optimization_goal LIKE '%LeadQualified%' THEN 1 ELSE 0 END) = 1
  THEN 'Eventos ML' ELSE 'Otimização ML' END AS comparison_group FROM adset_rows GROUP BY 1"""),
)
def refined_groups(t):
    arms = t.adset_rows.select("campaign_id", F.col("ml_type").alias("arm")).distinct()
    return cmp.refined_groups(t.adset_rows, arms)


@query(
    "comparison_groups",
    sql("""SELECT lead_id, CASE WHEN ml_type = 'COM_ML' AND g.goal = 'LeadQualified' THEN 'Eventos ML' WHEN ml_type = 'COM_ML' THEN 'Otimização ML'
  WHEN regexp_replace(campaign, '\\|[0-9]+$', '') LIKE '%MACHINERY%' THEN 'Controle' ELSE 'Outro' END AS comparison_group
FROM leads l LEFT JOIN (SELECT campaign_id, max(CASE WHEN optimization_goal = 'LeadQualified' THEN 'LeadQualified' END) AS goal FROM adset_rows GROUP BY 1) g
  ON right(l.campaign, 18) = g.campaign_id"""),
)
def comparison_groups(t):
    leads = names.with_class(t.leads)
    fair = leads.filter("campaign LIKE '%MACHINERY%'").select(F.regexp_replace("campaign", r"\|[0-9]+$", "").alias("campaign_name"))
    return cmp.with_comparison_group(leads, fair, cmp.campaign_goal(t.adset_rows)).select("lead_id", "comparison_group")


@query(
    "legacy_arm",
    sql("""SELECT e.comparison_group, e.leads, e.spend, coalesce(s.conversions, 0) AS conversions, round(coalesce(s.revenue, 0), 2) AS revenue FROM
 (SELECT CASE ml_type WHEN 'COM_ML' THEN 'Eventos ML' ELSE 'Faixa A' END AS comparison_group, sum(leads_standard) AS leads, sum(spend) AS spend
  FROM adset_rows WHERE adset_name IN (SELECT adset_name FROM shared) GROUP BY 1) e
 LEFT JOIN (SELECT CASE WHEN CAST(right(campaign, 2) AS INT) % 2 = 0 THEN 'Eventos ML' ELSE 'Faixa A' END AS comparison_group, count(DISTINCT email) AS conversions, sum(sale_value) AS revenue
  FROM leads_arms WHERE converted AND regexp_replace(medium, '\\s+', ' ', 'g') IN (SELECT adset_name FROM shared)
    AND campaign_id IN (SELECT campaign_id FROM adset_rows) GROUP BY 1) s ON e.comparison_group = s.comparison_group""",
        "shared AS (SELECT DISTINCT adset_name FROM adset_rows WHERE ml_type = 'SEM_ML' AND adset_name < 'Set 3')"),
)
def legacy_arm(t):
    long_ids = lambda df: df.withColumn("campaign_id", _long_id(F.col("campaign_id")))
    rows = long_ids(t.adset_rows)
    mapping = rows.filter("ml_type = 'SEM_ML'").select("adset_name", "campaign_id", (F.col("adset_name") < "Set 3").cast("int").alias("in_events")).distinct()
    events = rows.filter("ml_type = 'COM_ML'").select("campaign_id").distinct()
    named = F.concat(F.regexp_replace("campaign", r"\|[0-9]+$", "|"), _long_id(F.substring_index("campaign", "|", -1)))
    leads = t.leads_arms.withColumn("campaign", named)
    out = cmp.legacy_adset_comparison(rows, mapping, events, leads)
    return out.select("comparison_group", "leads", "spend", "conversions", F.round("revenue", 2).alias("revenue"))


def _long_id(c):
    """The two digits that tell nations apart, moved into the first fifteen."""
    return F.concat(F.lit("1202"), F.substr(c, F.lit(17), F.lit(2)), F.lit("000000000000"))


_CREATIVES = """meta AS (SELECT s_nationkey AS k, s_nationkey % 2 = 0 AS treated, sum(l_quantity) AS budget FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1),
owned AS (SELECT DISTINCT s_nationkey AS k, l_partkey % 97 AS creative FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
sizes AS (SELECT k, count(*) AS n FROM owned GROUP BY k)"""


@query(
    "fair_controls",
    sql("""SELECT campaign_id, control_id, overlap, round(fraction * 100, 6) AS overlap_pct, round((1 - gap) * fraction, 9) AS score FROM (
  SELECT t.k AS campaign_id, c.k AS control_id, abs(t.budget - c.budget) / t.budget AS gap, o.overlap, o.overlap / greatest(st.n, sc.n) AS fraction
  FROM meta t JOIN meta c ON t.treated AND NOT c.treated JOIN sizes st ON t.k = st.k JOIN sizes sc ON c.k = sc.k
  JOIN (SELECT a.k AS x, b.k AS y, count(*) AS overlap FROM owned a JOIN owned b ON a.creative = b.creative GROUP BY 1, 2) o ON o.x = t.k AND o.y = c.k)
WHERE gap <= 0.3 AND fraction >= 0.8""", _CREATIVES),
)
def fair_controls(t):
    rows = t.read("lineitem").join(t.read("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    meta = rows.groupBy(F.col("s_nationkey").alias("campaign_id")).agg(F.sum("l_quantity").alias("budget"))
    owned = ctl.creative_sets(rows.select(F.col("s_nationkey").alias("campaign_id"), (F.col("l_partkey") % 97).alias("creative_id")))
    treated, controls = meta.filter("campaign_id % 2 = 0"), meta.filter("campaign_id % 2 = 1")
    out = ctl.fair_controls(treated, controls, owned, Settings())
    return out.withColumn("overlap_pct", F.round("overlap_pct", 6)).withColumn("score", F.round("score", 9))


_SUPPLIER_CREATIVES = """meta AS (SELECT l_suppkey AS k, sum(l_quantity) AS budget FROM lineitem GROUP BY 1),
owned AS (SELECT DISTINCT l_suppkey AS k, l_partkey % 41 AS creative FROM lineitem),
sizes AS (SELECT k, count(*) AS n FROM owned GROUP BY 1)"""


@query(
    "best_controls",
    sql("""SELECT campaign_id, control_id, overlap, round(fraction * 100, 6) AS overlap_pct, round(score, 9) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY campaign_id ORDER BY score DESC, control_id) AS rank FROM (
    SELECT *, (1 - gap) * fraction AS score FROM (
      SELECT t.k AS campaign_id, c.k AS control_id, abs(t.budget - c.budget) / t.budget AS gap, o.overlap, o.overlap / greatest(st.n, sc.n) AS fraction
      FROM meta t JOIN meta c ON t.k % 2 = 0 AND c.k % 2 = 1 JOIN sizes st ON t.k = st.k JOIN sizes sc ON c.k = sc.k
      JOIN (SELECT a.k AS x, b.k AS y, count(*) AS overlap FROM owned a JOIN owned b ON a.creative = b.creative GROUP BY 1, 2) o ON o.x = t.k AND o.y = c.k)
    WHERE gap <= 0.3 AND fraction >= 0.8)) WHERE rank <= 3""", _SUPPLIER_CREATIVES),
)
def best_controls(t):
    """The three best controls of each supplier with an even key, among those with an odd one."""
    rows = t.read("lineitem")
    meta = rows.groupBy(F.col("l_suppkey").alias("campaign_id")).agg(F.sum("l_quantity").alias("budget"))
    owned = ctl.creative_sets(rows.select(F.col("l_suppkey").alias("campaign_id"), (F.col("l_partkey") % 41).alias("creative_id")))
    out = ctl.best_controls(meta.filter("campaign_id % 2 = 0"), meta.filter("campaign_id % 2 = 1"), owned, 3, Settings())
    return out.withColumn("overlap_pct", F.round("overlap_pct", 6)).withColumn("score", F.round("score", 9))


@query(
    "budget_metadata",
    sql("""SELECT campaign_id, min(campaign_name) AS campaign_name, sum(spend) AS spend,
  CASE WHEN CAST(substr(campaign_id, 18) AS INT) % 3 = 0 THEN 40.0 WHEN CAST(substr(campaign_id, 18) AS INT) % 3 = 1 THEN 900.0
       ELSE sum(budget) END AS budget FROM adset_rows GROUP BY campaign_id"""),
)
def budget_metadata(t):
    last = F.substr("campaign_id", F.lit(18)).cast("int") % 3
    rows = t.adset_rows.withColumn("daily_budget", F.when(last == 0, 40.0)).withColumn("lifetime_budget", F.when(last == 1, 900.0))
    adsets = t.adset_rows.withColumn("daily_budget", F.col("budget")).withColumn("lifetime_budget", F.lit(None).cast("double"))
    return ctl.campaign_metadata(rows, adsets)
