"""Queries: contact keys, linking, attribution."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import contact
from ..operators import link
from ..operators import deciles as dec
from .bindings import email_sql, national_sql, phone_sql, sql
from .registry import query

_STATE_SQL = "CASE WHEN substr({n}, 1, 2) = '11' THEN 'SP' WHEN substr({n}, 1, 2) = '21' THEN 'RJ' END".format(
    n=f"({national_sql('phone_raw')})"
)


@query(
    "conversion_by_decile",
    sql("""
SELECT d.decile, coalesce(x.total_leads, 0) AS total_leads, coalesce(x.conversions, 0) AS conversions,
       coalesce(round(x.conversions * 100.0 / x.total_leads, 2), 0) AS conversion_rate
FROM (SELECT CAST(unnest(range(1, 11)) AS INT) AS decile) d LEFT JOIN
     (SELECT decile, count(*) AS total_leads, count(*) FILTER (converted) AS conversions FROM matched GROUP BY decile) x
  ON d.decile = x.decile"""),
)
def conversion_by_decile(t):
    return dec.conversion_by_decile(t.matched)


@query(
    "contacts_normalized",
    sql(f"""
SELECT lead_id, email, phone, length({national_sql('phone_raw')}) AS phone_digits,
       coalesce(regexp_matches(lower(trim(email_raw)), '^[a-z0-9._%+-]+@[a-z0-9.-]+\\.[a-z]{{2,}}$'), false) AS email_valid,
       true AS name_valid, sha256(lower(trim(email_raw))) AS email_hash, {_STATE_SQL} AS state
FROM leads"""),
)
def contacts_normalized(t):
    raw = F.col("phone_raw")
    return t.leads.select(
        "lead_id", "email", "phone",
        F.length(contact.national_digits(raw)).alias("phone_digits"),
        contact.email_is_valid(F.col("email_raw")).alias("email_valid"),
        contact.name_is_valid(F.col("name")).alias("name_valid"),
        contact.hashed(F.col("email_raw")).alias("email_hash"),
        contact.phone_state(raw).alias("state"),
    )


_VARIANTS_SQL = f"""v AS (
  SELECT lead_id, phone AS n FROM leads WHERE phone IS NOT NULL),
variants AS (
  SELECT lead_id, n AS variant FROM v
  UNION SELECT lead_id, substr(n, 4) FROM v WHERE length(n) = 11
  UNION SELECT lead_id, substr(n, 1, 2) || substr(n, 4) FROM v WHERE length(n) = 11 AND substr(n, 3, 1) = '9'
  UNION SELECT lead_id, substr(n, 3) FROM v WHERE length(n) = 10
  UNION SELECT lead_id, substr(n, 1, 2) || '9' || substr(n, 3) FROM v WHERE length(n) = 10 AND substr(n, 3, 1) IN ('8', '9'))"""


@query("phone_variants", sql("SELECT lead_id, variant FROM variants", _VARIANTS_SQL))
def phone_variants(t):
    return t.leads.select("lead_id", F.explode(contact.phone_variants(F.col("phone_raw"))).alias("variant"))


@query(
    "target_email_only",
    sql("SELECT lead_id, CAST(coalesce(email IN (SELECT k FROM first_by_email), false) AS INT) AS target FROM leads"),
)
def target_email_only(t):
    return link.target_by_email(t.leads, t.sales).select("lead_id", "target")


@query("target_email_phone", sql("SELECT lead_id, target FROM target_leads"))
def target_email_phone(t):
    return t.targeted.select("lead_id", "target")


@query(
    "target_any",
    sql("""SELECT lead_id, CAST(coalesce(email IN (SELECT k FROM first_by_email), false)
      OR coalesce(phone IN (SELECT k FROM first_by_phone), false) AS INT) AS target FROM leads"""),
)
def target_any(t):
    return link.target_by_email_or_phone(t.leads, t.sales, None).select("lead_id", "target")


@query(
    "target_variants",
    sql(
        """SELECT lead_id, CAST(coalesce(email IN (SELECT k FROM first_by_email), false)
      OR lead_id IN (SELECT lead_id FROM variants WHERE variant IN (SELECT variant FROM sale_variants)) AS INT) AS target
FROM leads""",
        _VARIANTS_SQL
        + """, sale_variants AS (
  SELECT phone AS variant FROM sales UNION SELECT substr(phone, 4) FROM sales
  UNION SELECT substr(phone, 1, 2) || substr(phone, 4) FROM sales WHERE substr(phone, 3, 1) = '9')""",
    ),
)
def target_variants(t):
    return link.target_by_variants(t.leads, t.sales).select("lead_id", "target")


def _students(t):
    """Customers of one market segment stand for the student list."""
    c = t.read("customer").filter("c_mktsegment = 'BUILDING'")
    return c.select(contact.email_key(F.concat(F.lower("c_name"), F.lit("@mail.com"))).alias("email"))


def _products(t):
    """Priorities of the orders that start with 1 or 2 stand for the listed products."""
    return t.read("orders").select(F.col("o_orderpriority").alias("product")).distinct().filter("product < '3'")


@query(
    "target_validated",
    sql("""SELECT lead_id, coalesce(email IN (SELECT k FROM first_by_email), false) AS "primary",
       false AS confirmed, CAST(coalesce(email IN (SELECT k FROM first_by_email), false) AS INT) AS target FROM leads"""),
)
def target_validated(t):
    out = link.target_validated(t.leads, t.sales, _students(t), _products(t))
    return out.select("lead_id", "primary", "confirmed", "target")


_RETARGET = """r AS (
  SELECT lead_id, target AS was, coalesce(email IN (SELECT email FROM sales WHERE product < '3'), false) AS e,
         coalesce(phone IN (SELECT phone FROM sales WHERE product < '3'), false) AS p, email, phone FROM target_leads)"""


@query(
    "retarget_products",
    sql(
        """SELECT lead_id, CAST(was = 1 AND (e OR p) AS INT) AS target,
       CASE WHEN was = 1 AND e AND p THEN 'both' WHEN was = 1 AND e THEN 'email' WHEN was = 1 AND p THEN 'phone' END AS "by"
FROM r""",
        _RETARGET,
    ),
)
def retarget_products(t):
    return link.retarget(t.targeted, t.sales, _products(t)).select("lead_id", "target", "by")


@query(
    "retarget_discarded_products",
    sql(
        """SELECT product, count(DISTINCT lead_id) AS leads FROM (
  SELECT r.lead_id, s.product FROM r JOIN sales s ON r.email = s.email WHERE was = 1 AND NOT (e OR p)
  UNION ALL SELECT r.lead_id, s.product FROM r JOIN sales s ON r.phone = s.phone WHERE was = 1 AND NOT (e OR p))
GROUP BY product""",
        _RETARGET,
    ),
)
def retarget_discarded_products(t):
    return link.discarded_products(t.targeted, t.sales, _products(t))


@query(
    "conversion_window",
    sql("""SELECT lead_id, target FROM target_leads
WHERE captured_at <= (SELECT max(sale_date) - INTERVAL 45 DAY FROM sales) OR target = 1"""),
)
def conversion_window(t):
    return link.within_conversion_window(t.targeted, t.sales, 45).select("lead_id", "target")


_MATCH = ["lead_id", "converted", "match_method", "sale_value", "sale_date", "sale_origin"]


@query("attribution_first_sale", sql(f"SELECT {', '.join(_MATCH)} FROM matched"))
def attribution_first_sale(t):
    return link.attribute_sales(t.leads, t.sales).select(*_MATCH)


@query(
    "attribution_temporal",
    sql(
        """SELECT l.lead_id, coalesce(e.k, p.k) IS NOT NULL AS converted,
       CASE WHEN e.k IS NOT NULL THEN 'email' WHEN p.k IS NOT NULL THEN 'telefone' END AS match_method,
       coalesce(CASE WHEN e.k IS NOT NULL THEN e.sale_value ELSE p.sale_value END, 0.0) AS sale_value,
       CASE WHEN e.k IS NOT NULL THEN e.sale_date ELSE p.sale_date END AS sale_date,
       CASE WHEN e.k IS NOT NULL THEN e.sale_origin ELSE p.sale_origin END AS sale_origin
FROM leads l LEFT JOIN te e ON l.lead_id = e.lead_id AND e.rn = 1 LEFT JOIN tp p ON l.lead_id = p.lead_id AND p.rn = 1""",
        """te AS (SELECT l.lead_id, s.email AS k, s.sale_value, s.sale_date, s.sale_origin,
    row_number() OVER (PARTITION BY l.lead_id ORDER BY s.sale_date, s.sale_value, s.sale_origin) AS rn
  FROM leads l JOIN sales s ON l.email = s.email AND s.sale_date >= l.captured_at),
tp AS (SELECT l.lead_id, s.phone AS k, s.sale_value, s.sale_date, s.sale_origin,
    row_number() OVER (PARTITION BY l.lead_id ORDER BY s.sale_date, s.sale_value, s.sale_origin) AS rn
  FROM leads l JOIN sales s ON l.phone = s.phone AND s.sale_date >= l.captured_at)""",
    ),
)
def attribution_temporal(t):
    return link.attribute_sales(t.leads, t.sales, temporal=True).select(*_MATCH)


@query(
    "conversions_dedup",
    sql("""SELECT lead_id, converted, sale_value, sale_date FROM (
  SELECT *, row_number() OVER (PARTITION BY converted, coalesce(email, phone), sale_date, sale_value
                               ORDER BY captured_at, lead_id) AS rn
  FROM matched WHERE NOT converted OR (captured_at >= DATE '2024-01-03' AND captured_at < DATE '2024-01-26'))
WHERE rn = 1 OR NOT converted"""),
)
def conversions_dedup(t):
    kept = link.drop_outside_conversions(link.attribute_sales(t.leads, t.sales), "2024-01-03", "2024-01-25")
    return link.dedupe_conversions(kept).select("lead_id", "converted", "sale_value", "sale_date")


@query(
    "matching_stats",
    sql("""SELECT count(*) AS total_leads, count(*) FILTER (converted) AS total_conversions,
  count(*) FILTER (match_method = 'email') AS matched_by_email,
  count(*) FILTER (match_method = 'telefone') AS matched_by_phone,
  round(sum(sale_value), 2) AS total_revenue,
  count(*) FILTER (sale_origin = 'guru') AS conversions_guru, count(*) FILTER (sale_origin = 'tmb') AS conversions_tmb,
  (SELECT count(*) FROM sales) AS total_sales,
  round(count(*) FILTER (converted) * 100.0 / (SELECT count(*) FROM sales), 2) AS tracking_rate,
  round(count(*) FILTER (converted) * 100.0 / count(*), 2) AS conversion_rate,
  round(count(*) FILTER (match_method = 'email') * 100.0 / count(*) FILTER (converted), 2) AS match_rate_email,
  round(count(*) FILTER (match_method = 'telefone') * 100.0 / count(*) FILTER (converted), 2) AS match_rate_phone,
  round(sum(sale_value) / count(*) FILTER (converted), 2) AS avg_ticket
FROM matched"""),
)
def matching_stats(t):
    return link.matching_stats(link.attribute_sales(t.leads, t.sales), t.sales)


@query(
    "buyers_tracked",
    sql("""SELECT email, sale_id, sale_value, sale_date, campaign, campaign IS NOT NULL AS tracked FROM (
  SELECT s.*, coalesce(ce.campaign, cp.campaign) AS campaign,
    row_number() OVER (PARTITION BY s.email ORDER BY s.sale_date, s.sale_value, s.sale_origin) AS rn
  FROM sales s
  LEFT JOIN (SELECT email, arg_min(campaign, (captured_at, lead_id)) AS campaign FROM matched WHERE converted AND email IS NOT NULL GROUP BY email) ce ON s.email = ce.email
  LEFT JOIN (SELECT phone, arg_min(campaign, (captured_at, lead_id)) AS campaign FROM matched WHERE converted AND phone IS NOT NULL GROUP BY phone) cp ON s.phone = cp.phone)
WHERE rn = 1"""),
)
def buyers_tracked(t):
    out = link.tracked_buyers(link.attribute_sales(t.leads, t.sales), t.sales)
    return out.select("email", "sale_id", "sale_value", "sale_date", "campaign", "tracked")


@query(
    "recall_correction",
    sql("""SELECT sales, conversions, conversions * 1.0 / sales AS recall, sales * 1.0 / conversions AS factor FROM
  (SELECT count(*) AS sales FROM (SELECT DISTINCT email, sale_date, sale_value FROM sales WHERE product < '3' AND sale_date >= DATE '2024-01-10')),
  (SELECT count(*) FILTER (target = 1) AS conversions FROM target_leads)"""),
)
def recall_correction(t):
    return link.recall(t.targeted, t.sales, _products(t), "2024-01-10")


@query(
    "product_coverage",
    sql("""SELECT product, count(*) AS sales, CASE WHEN product < '3' THEN 'counted' ELSE 'unlisted' END AS kind
FROM sales GROUP BY product"""),
)
def product_coverage(t):
    parts = link.product_coverage(t.sales, _products(t))
    counted = parts["counted"].withColumn("kind", F.lit("counted"))
    missing = parts["missing"].select("product", F.lit(0).cast("long").alias("sales"), F.lit("missing").alias("kind"))
    return counted.unionByName(missing).unionByName(parts["unlisted"].withColumn("kind", F.lit("unlisted")))
