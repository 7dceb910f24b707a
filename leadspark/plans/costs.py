"""Queries: ad costs, look-ups and UTM economics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import CORRECTED_RATES, DECILES, DEFAULTS
from ..operators import costs as ops
from ..operators import utm_report as rep
from ..session import stored
from ..sources import reports as src
from .bindings import sql
from .registry import query

AS_OF = "2024-01-31"


@query(
    "cost_rollup",
    sql("""SELECT campaign_id, adset_id, ad_id, sum(spend) AS spend, count(*) AS "rows", grouping(campaign_id, adset_id, ad_id) AS level
FROM ad_costs GROUP BY ROLLUP (campaign_id, adset_id, ad_id)"""),
)
def cost_rollup(t):
    return ops.roll_up(t.ad_costs)


_LEVELS = " UNION ALL ".join(
    f"SELECT {{p}}'{level}' AS level, '{by}' AS by, CAST({level}_{by} AS VARCHAR) AS value, sum(spend) AS spend FROM {{src}} GROUP BY {{g}}{level}_{by}"
    for level in ops.LEVELS for by in ("id", "name")
)


@query("cost_by_level", sql('SELECT level, "by", value, spend FROM (' + _LEVELS.format(p="", src="ads", g="") + ") x"))
def cost_by_level(t):
    return ops.spend_by_level(t.ads)


_TIMED = """timed AS (SELECT a.*, d.period_days FROM ads a JOIN (VALUES (1), (3), (7)) d(period_days)
  ON a.day >= DATE '2024-01-31' - d.period_days AND a.day < DATE '2024-01-31'),
timed_leads AS (SELECT l.*, d.period_days FROM leads_utm l JOIN (VALUES (1), (3), (7)) d(period_days)
  ON l.captured_at >= DATE '2024-01-31' - d.period_days AND l.captured_at < DATE '2024-01-31')"""


@query(
    "cost_periods",
    sql('SELECT period_days, level, "by", value, spend FROM (' + _LEVELS.format(p="period_days, ", src="timed", g="period_days, ") + ") x", _TIMED),
)
def cost_periods(t):
    return ops.spend_periods(t.ads, AS_OF)


def _campaign_costs(t):
    rows = stored(t.adset_rows, "adset-rows")
    return ops.report_hierarchy(rows.groupBy("campaign_name").agg(F.lit(75.0).alias("budget")), rows, t.ad_rows)


_COSTS = """costs AS (SELECT campaign_id, min(campaign_name) AS campaign_name, min(account_name) AS account_id, sum(spend) AS spend,
  CASE WHEN sum(budget) = 0 THEN 75.0 ELSE sum(budget) END AS budget, sum(leads_standard) AS leads, sum(lead_qualified) AS lead_qualified,
  string_agg(DISTINCT optimization_goal, ', ' ORDER BY optimization_goal) AS optimization_goal, count(DISTINCT adset_id) AS num_adsets,
  (SELECT count(*) FROM ad_rows r WHERE r.campaign_id = a.campaign_id) AS num_creatives
  FROM adset_rows a GROUP BY campaign_id)"""
_MIXED = """asked AS (SELECT DISTINCT campaign FROM (
  SELECT campaign FROM leads UNION ALL SELECT upper(campaign_name) FROM costs UNION ALL SELECT concat(campaign_name, ' x') FROM costs
  UNION ALL SELECT concat('cut|', substr(campaign_id, 1, 15)) FROM costs))"""


@query(
    "report_hierarchy",
    sql("""SELECT campaign_id, campaign_name, account_id, spend, budget, leads, leads AS leads_standard, lead_qualified,
  optimization_goal, num_adsets, num_creatives FROM costs""", _COSTS),
)
def report_hierarchy(t):
    return _campaign_costs(t)


@query(
    "cost_lookup_cascade",
    sql("""SELECT q.campaign, coalesce(i.spend, p.spend, n.spend) AS spend, coalesce(i.num_creatives, p.num_creatives, n.num_creatives) AS num_creatives,
  CASE WHEN i.campaign_id IS NOT NULL THEN 'id' WHEN p.k IS NOT NULL THEN 'prefix' WHEN n.k IS NOT NULL THEN 'name' END AS matched_by
FROM (SELECT campaign, nullif(regexp_extract(campaign, '\\|([0-9]{11,})$', 1), '') AS id FROM asked) q
LEFT JOIN costs i ON q.id = i.campaign_id
LEFT JOIN (SELECT substr(campaign_id, 1, 15) AS k, arg_min(spend, campaign_id) AS spend, arg_min(num_creatives, campaign_id) AS num_creatives FROM costs GROUP BY 1) p ON substr(q.id, 1, 15) = p.k
LEFT JOIN (SELECT lower(campaign_name) AS k, arg_min(spend, campaign_id) AS spend, arg_min(num_creatives, campaign_id) AS num_creatives FROM costs GROUP BY 1) n
  ON lower(trim(CASE WHEN q.id IS NULL THEN q.campaign ELSE regexp_replace(q.campaign, '\\|[^|]*$', '') END)) = n.k""", _COSTS + ", " + _MIXED),
)
def cost_lookup_cascade(t):
    costs = _campaign_costs(t)
    asked = (
        t.leads.select("campaign").union(costs.select(F.upper("campaign_name")))
        .union(costs.select(F.concat("campaign_name", F.lit(" x"))))
        .union(costs.select(F.concat(F.lit("cut|"), F.substr("campaign_id", F.lit(1), F.lit(15))))).distinct()
    )
    return ops.lookup_campaign(asked, costs, ("spend", "num_creatives"))


@query(
    "cost_goals",
    sql("""SELECT campaign_id, string_agg(DISTINCT g, ', ' ORDER BY g) AS optimization_goal FROM (
  SELECT campaign_id, CASE WHEN optimization_goal = 'OFFSITE_CONVERSIONS' THEN 'Lead' ELSE optimization_goal END AS g FROM adset_rows) GROUP BY campaign_id"""),
)
def cost_goals(t):
    return ops.goals_by_campaign(t.adset_rows)


_SHARES = ", ".join(f"count(*) FILTER (decile = {k}) * 100.0 / count(*) AS pct_d{k}" for k in DECILES)
_SHARES6 = ", ".join(f"round(pct_d{k}, 9) AS pct_d{k}" for k in DECILES)


_DIGITS = {"projected_rate": 12, **{f"pct_d{k}": 9 for k in DECILES}}


def _rounded(df):
    return df.withColumns({c: F.round(c, _DIGITS.get(c, 6)) for c, k in df.dtypes if k == "double"})


@query(
    "utm_decile_shares",
    sql(f"SELECT period_days, value, leads, {_SHARES6} FROM (SELECT period_days, right(campaign, 18) AS value, count(lead_score) AS leads, {_SHARES} FROM timed_leads GROUP BY 1, 2)", _TIMED),
)
def utm_decile_shares(t):
    from ..functions.utm import utm_id

    leads = ops.trailing(t.leads_utm, "captured_at", AS_OF)
    return _rounded(rep.decile_distribution(leads, utm_id(F.col("campaign")), ("period_days",)))


def _economics(base: str, dimension: str, has: str, keep: str) -> str:
    """SQL twin of the economics columns over ``base`` (value, leads, spend, shares)."""
    rate = " + ".join(f"pct_d{k} / 100.0 * {r}::DOUBLE" for k, r in zip(DECILES, CORRECTED_RATES))
    on_off = dimension == "ad"
    off = "'Remover'" if on_off else "'Reduzir 100%'"
    weak = "'Remover (ROAS < 1.0)'" if on_off else "'Reduzir 100%'"
    no_budget = {"campaign": "'ABO'", "medium": "CASE WHEN margin < 0 OR projected_roas < 2.5 THEN 'CBO - Pausar / Alterar' ELSE 'CBO - Manter' END"}.get(dimension, "'N/A'")
    pct = "CAST(CAST(abs(change) AS DECIMAL(10,1)) AS VARCHAR) || '%'"
    idle = "'Manter (ROAS baixo)'" if dimension in ("campaign", "medium") else "'Manter'"
    act = "CASE WHEN margin >= 0 THEN 'Manter' ELSE 'Remover' END" if on_off else (
        f"CASE WHEN change > 0 THEN 'Aumentar ' || {pct} WHEN change < 0 THEN 'Reduzir ' || {pct} ELSE {idle} END")
    return f"""SELECT {keep}, leads, spend, {_SHARES6}, round(cpl, 6) AS cpl, round(projected_rate, 12) AS projected_rate,
  round(projected_revenue, 6) AS projected_revenue, round(margin, 6) AS margin, round(projected_roas, 6) AS projected_roas, action,
  spend AS budget_current, round(CASE WHEN action IN ('Remover', 'Reduzir 100%') THEN 0.0
    WHEN action LIKE 'Aumentar%' OR action LIKE 'Reduzir%' THEN spend * (1.0 + change / 100.0) ELSE spend END, 6) AS budget_target
FROM (SELECT *, CASE WHEN leads = 0 AND spend > 100 THEN {off}
    WHEN leads < period_days * 3 AND spend > 100 AND projected_roas < 1.0 THEN {weak}
    WHEN leads < period_days * 3 THEN CASE WHEN period_days * 3 - leads = 1 THEN 'Aguardar dados (falta 1 lead)'
      ELSE 'Aguardar dados (faltam ' || CAST(period_days * 3 - leads AS VARCHAR) || ' leads)' END
    WHEN NOT {has} THEN {no_budget} ELSE {act} END AS action
  FROM (SELECT *, CASE WHEN spend = 0 THEN 0.0 WHEN margin > 0 THEN round(least(margin / spend * 100.0, 100.0) * sure *
        (CASE WHEN projected_roas < 2.5 THEN 0.0 WHEN projected_roas >= 8.0 THEN 1.0 ELSE 0.5 + 0.5 * (projected_roas - 2.5) / 5.5 END), 1)
      ELSE round(greatest(margin / spend * 100.0 * sure, -100.0), 1) END AS change
    FROM (SELECT *, projected_revenue - spend AS margin, CASE WHEN cpl = 0 THEN 0.0 ELSE 2000.0::DOUBLE * projected_rate / cpl END AS projected_roas,
        1.0 / (1.0 + exp(-0.15::DOUBLE * (leads / period_days::DOUBLE - 15.0))) AS sure
      FROM (SELECT *, leads * projected_rate * 2000.0::DOUBLE AS projected_revenue
        FROM (SELECT *, CASE WHEN leads = 0 THEN 0.0 ELSE spend / leads END AS cpl, {rate} AS projected_rate FROM ({base}))))))"""


_CAMPAIGN = f"""SELECT g.*, c.spend, c.has_campaign_budget, coalesce(c.campaign_name, g.id) AS value FROM
  (SELECT period_days, right(campaign, 18) AS id, count(lead_score) AS leads, {_SHARES} FROM timed_leads GROUP BY 1, 2) g
  JOIN (SELECT period_days, campaign_id, min(campaign_name) AS campaign_name, sum(spend) AS spend, min(has_campaign_budget) AS has_campaign_budget
        FROM timed GROUP BY 1, 2) c ON g.period_days = c.period_days AND g.id = c.campaign_id WHERE c.spend > 0"""


@query(
    "utm_economics_1d_3d_7d",
    sql(_economics(_CAMPAIGN, "campaign", "has_campaign_budget", "period_days, value, has_campaign_budget"), _TIMED),
)
def utm_economics(t):
    return _rounded(rep.utm_economics(t.leads_utm, t.ads, AS_OF, dimensions=("campaign",))["campaign"])


_ADSET = f"""SELECT g.*, c.spend, c.has_adset_budget, c.adset_name AS value FROM
  (SELECT l.period_days, a.adset_id, min(a.campaign_name) AS campaign_name, count(lead_score) AS leads, {_SHARES}
   FROM timed_leads l JOIN (SELECT campaign_id, adset_name, min(CAST(adset_id AS VARCHAR)) AS adset_id, min(campaign_name) AS campaign_name FROM timed GROUP BY 1, 2) a
     ON right(l.campaign, 18) = a.campaign_id AND l.medium = a.adset_name WHERE l.medium NOT LIKE '%{{{{%' GROUP BY 1, 2) g
  JOIN (SELECT period_days, CAST(adset_id AS VARCHAR) AS adset_id, min(adset_name) AS adset_name, sum(spend) AS spend, min(has_adset_budget) AS has_adset_budget
        FROM timed GROUP BY 1, 2) c ON g.period_days = c.period_days AND g.adset_id = c.adset_id WHERE c.spend > 0"""


@query(
    "utm_economics_adset",
    sql(_economics(_ADSET, "medium", "has_adset_budget", "period_days, value, has_adset_budget, campaign_name"), _TIMED),
)
def utm_economics_adset(t):
    return _rounded(rep.utm_economics(t.leads_utm, t.ads, AS_OF, dimensions=("medium",))["medium"])


# Every 23rd lead names its ad with " v2" after it; such a name is similar if it is long enough.
_AD = f"""SELECT g.*, n.spend FROM
  (SELECT period_days, CASE WHEN lead_id % 23 = 0 THEN content || ' v2' ELSE content END AS value, min(campaign_name) AS campaign_name, min(adset_fixed) AS adset_name, count(lead_score) AS leads, {_SHARES}
   FROM (SELECT l.*, c.campaign_name, CASE WHEN l.medium = 'paid' THEN f.adset_name ELSE l.medium END AS adset_fixed
         FROM timed_leads l LEFT JOIN (SELECT campaign_id, min(campaign_name) AS campaign_name FROM timed GROUP BY 1) c ON right(l.campaign, 18) = c.campaign_id
         LEFT JOIN (SELECT lower(ad_name) AS k, arg_min(adset_name, (campaign_id, adset_id, ad_id)) AS adset_name FROM timed GROUP BY 1) f ON lower(l.content) = f.k AND l.lead_id % 23 <> 0
         WHERE l.content IS NOT NULL)
   WHERE adset_fixed IS NOT NULL GROUP BY 1, 2) g
  JOIN (SELECT period_days, lower(ad_name) AS k, arg_min(spend, (campaign_id, adset_id, ad_id)) AS spend FROM
        (SELECT period_days, campaign_id, adset_id, ad_id, min(ad_name) AS ad_name, sum(spend) AS spend FROM timed GROUP BY 1, 2, 3, 4) GROUP BY 1, 2) n
    ON g.period_days = n.period_days AND (lower(g.value) = n.k OR lower(g.value) = n.k || ' v2' AND 2.0 * length(n.k) / (2 * length(n.k) + 3) >= {DEFAULTS.ad_similarity}) WHERE n.spend > 0"""


@query("utm_economics_ad", sql(_economics(_AD, "ad", "true", "period_days, value, campaign_name, adset_name"), _TIMED))
def utm_economics_ad(t):
    """Ad names as they are, in other case, and misspelt."""
    content = F.when(F.col("lead_id") % 23 == 0, F.concat("content", F.lit(" v2"))).otherwise(F.col("content"))
    return _rounded(rep.utm_economics(t.leads_utm.withColumn("content", content), t.ads, AS_OF, dimensions=("ad",))["ad"])


_WORDS = f"""SELECT period_days, nullif(split_part(term, '--', 1), '') AS value, count(lead_score) AS leads, 0.0 AS spend, {_SHARES}
FROM timed_leads WHERE source = 'google-ads' AND term NOT IN ('fb', 'ig') GROUP BY 1, 2"""


@query("utm_economics_keywords", sql(_economics(_WORDS, "google_ads", "true", "period_days, value"), _TIMED))
def utm_economics_keywords(t):
    return _rounded(rep.utm_economics(t.leads_utm, t.ads, AS_OF, dimensions=("google_ads",))["google_ads"])


@query(
    "utm_window_totals",
    sql("""SELECT period_days, min(captured_at) AS first_lead, max(captured_at) AS last_lead, count(*) AS total_leads,
  count(*) FILTER (source = 'facebook-ads') AS meta_leads, count(*) FILTER (source = 'google-ads') AS google_leads
FROM timed_leads GROUP BY period_days""", _TIMED),
)
def utm_window_totals(t):
    return rep.window_totals(ops.trailing(t.leads_utm, "captured_at", AS_OF))


# A name with " v2" shares all its characters with its origin: the ratio is 2 n / (2 n + 3).
_RESIDUE = f"""per_ad AS (SELECT campaign_id, adset_id, ad_id, min(ad_name) AS ad_name, sum(spend) AS spend FROM ads GROUP BY 1, 2, 3),
names AS (SELECT ad_name, arg_min(spend, (campaign_id, adset_id, ad_id)) AS spend, 2.0 * length(ad_name) / (2 * length(ad_name) + 3) >= {DEFAULTS.ad_similarity} AS near FROM per_ad GROUP BY 1),
altered AS (SELECT DISTINCT ad_name, ad_id % 3 AS kind FROM ads)"""


@query(
    "fuzzy_residue",
    sql("""SELECT CASE kind WHEN 0 THEN ad_name WHEN 1 THEN ad_name || ' v2' ELSE reverse(ad_name) END AS value,
  CASE WHEN kind = 0 OR kind = 1 AND near THEN spend ELSE 0.0 END AS spend, CASE WHEN kind = 0 THEN 'name' WHEN kind = 1 AND near THEN 'similar' END AS matched_by
FROM altered JOIN names USING (ad_name)""", _RESIDUE),
)
def fuzzy_residue(t):
    """Spend of altered ad names: some equal, some only similar, some unknown."""
    ads = stored(t.ads.select("campaign_id", "adset_id", "adset_name", "ad_id", "ad_name", "spend"), "ads")
    key = F.col("ad_id")
    altered = F.when(key % 3 == 0, F.col("ad_name")).when(key % 3 == 1, F.concat("ad_name", F.lit(" v2"))).otherwise(F.reverse("ad_name"))
    values = ads.select(altered.alias("value")).distinct()
    return ops.spend_of_ad_values(values, ads, DEFAULTS.ad_similarity).select("value", "spend", "matched_by")


_NAMED = """per_name AS (SELECT campaign_id, ad_name, sum(spend) AS spend, (length(ad_name) + CAST(right(campaign_id, 2) AS INT)) % 3 AS kind FROM ads GROUP BY 1, 2),
per_campaign AS (SELECT campaign_id, sum(spend) AS total, bool_and(has_campaign_budget) AS has_campaign_budget FROM ads GROUP BY 1)"""


@query(
    "fuzzy_campaign_values",
    sql("""SELECT 'DEMO | CAP | FRIO | FASE 01 | ' || CASE kind WHEN 0 THEN upper(ad_name) WHEN 1 THEN ad_name || 's' ELSE reverse(ad_name) END || ' | PG2 | 2024-01-15|' || campaign_id AS value,
  CASE WHEN kind < 2 THEN spend ELSE total END AS spend, has_campaign_budget, CASE WHEN kind < 2 THEN 'adset' ELSE 'campaign' END AS matched_by
FROM per_name JOIN per_campaign USING (campaign_id)""", _NAMED),
)
def fuzzy_campaign_values(t):
    """Campaign UTM values to the adset they name, exactly or similarly, else the campaign.

    Part names stand for adset names; a third of the values is spelt differently, a third backwards."""
    ads = stored(t.ads.select("campaign_id", "campaign_name", "ad_id", "ad_name", "spend", "has_campaign_budget"), "ads")
    ads = ads.withColumn("adset_name", F.col("ad_name")).withColumn("adset_id", F.col("ad_name"))
    kind = (F.length("ad_name") + F.right("campaign_id", F.lit(2)).cast("int")) % 3
    named = F.when(kind == 0, F.upper("ad_name")).when(kind == 1, F.concat("ad_name", F.lit("s"))).otherwise(F.reverse("ad_name"))
    text = F.concat(F.lit("DEMO | CAP | FRIO | FASE 01 | "), named, F.lit(" | PG2 | 2024-01-15|"), "campaign_id")
    return ops.spend_of_campaign_values(ads.select(text.alias("value")).distinct(), ads)


@query(
    "fuzzy_name_values",
    sql("""SELECT campaign_name || '|42' AS value, sum(spend) AS spend, 'similar' AS matched_by FROM ads GROUP BY campaign_name
UNION ALL SELECT campaign_name, sum(spend), 'name' FROM ads GROUP BY campaign_name"""),
)
def fuzzy_name_values(t):
    """Spend of campaign-level values by id, by name, by similar name."""
    ads = stored(t.ads.select("campaign_id", "campaign_name", "spend"), "ads")
    nations = ads.select(F.concat("campaign_name", F.lit("|42")).alias("value")).union(ads.select("campaign_name")).distinct()
    return ops.spend_of_values(nations, ads, "campaign")


@query(
    "period_overlap",
    sql("""SELECT campaign_id, adset_id, report_start, spend FROM adset_rows
WHERE report_start <= DATE '1997-03-10' AND report_end >= DATE '1997-01-20'"""),
)
def period_overlap(t):
    return src.in_period(t.adset_rows, "1997-01-20", "1997-03-10").select("campaign_id", "adset_id", "report_start", "spend")


@query(
    "spend_zeroed",
    sql("""SELECT campaign_id, adset_id, report_start, spend AS total_spend,
  CASE WHEN report_end < DATE '1997-01-20' OR report_start > DATE '1997-03-10' THEN 0.0 ELSE spend END AS spend FROM adset_rows"""),
)
def spend_zeroed(t):
    out = src.zero_spend_outside(t.adset_rows, "1997-01-20", "1997-03-10")
    return out.select("campaign_id", "adset_id", "report_start", "total_spend", "spend")
