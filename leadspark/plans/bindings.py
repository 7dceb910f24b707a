"""The driver tables seen as leads, sales, ad costs and survey rows.

``Tables`` builds each view with the DataFrame API; ``sql(body)`` puts the same views,
as common table expressions, before a SQL text.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.contact import email_key, phone_key
from ..functions.utm import campaign_class
from ..operators import deciles as dec
from ..operators import link


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def leads(self) -> DataFrame:
        e, c = self.read("events"), self.read("customer")
        key = F.lpad(F.col("c_custkey").cast("string"), 8, "0")
        event = F.col("event_id")
        email = (
            F.when(event % 17 == 0, None)
            .when(event % 5 == 0, F.concat(F.lit("  "), F.upper("c_name"), F.lit("@MAIL.COM ")))
            .otherwise(F.concat(F.lower("c_name"), F.lit("@mail.com")))
        )
        phone = (
            F.when(event % 13 == 0, None)
            .when(event % 3 == 0, F.concat(F.lit("+55 (11) 9"), key))
            .otherwise(F.concat(F.lit("119"), key))
        )
        strategy = F.when(F.col("event_type").isin("purchase", "signup"), " | ML | ").otherwise(" | SCORE | ")
        campaign = F.concat(
            F.lit("DEMO | CAP | FRIO | "), F.col("c_mktsegment"), strategy,
            F.lit("2024-01-01|1202"), F.lpad(F.col("c_nationkey").cast("string"), 14, "0"),
        )
        medium = (
            F.when(F.col("event_type") == "click", "ADV | Audience A")
            .when(F.col("event_type") == "view", "audience  a.")
            .when(F.col("event_type") == "error", "{{adset.name}}")
            .otherwise("ABERTO")
        )
        term = (
            F.when(event % 4 == 0, "ig").when(event % 4 == 1, "fb")
            .when(event % 4 == 2, F.concat(F.lit("kw"), F.col("user_id").cast("string"), F.lit("--1--2")))
        )
        score = F.when(F.col("value") < 500, F.col("value") / 500).otherwise(F.lit(1.0))
        return (
            e.join(c, F.col("user_id") == F.col("c_custkey"))
            .select(
                event.alias("lead_id"), email.alias("email_raw"), phone.alias("phone_raw"),
                F.col("ts").alias("captured_at"), campaign.alias("campaign"), medium.alias("medium"),
                term.alias("term"), score.alias("lead_score"), F.col("c_name").alias("name"),
            )
            .withColumn("email", email_key(F.col("email_raw")))
            .withColumn("phone", phone_key(F.col("phone_raw")))
        )

    @cached_property
    def sales(self) -> DataFrame:
        # pending orders are no sales; customers of small balance buy under contacts of their own
        o = self.read("orders").filter("o_orderstatus <> 'P'")
        c = self.read("customer")
        own = F.col("c_acctbal") >= 5500
        day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("o_orderkey") % 60).cast("int"))
        return (
            o.join(c, F.col("o_custkey") == F.col("c_custkey"))
            .select(
                F.col("o_orderkey").alias("sale_id"),
                F.when(own, F.concat(F.lower("c_name"), F.lit("@mail.com"))).otherwise(F.concat(F.lit("buyer"), "c_custkey", F.lit("@shop.com"))).alias("email_raw"),
                F.concat(F.when(own, "119").otherwise("219"), F.lpad(F.col("c_custkey").cast("string"), 8, "0")).alias("phone_raw"),
                F.col("o_totalprice").alias("sale_value"), day.alias("sale_date"),
                F.when(F.col("o_orderstatus") == "F", "guru").otherwise("tmb").alias("sale_origin"),
                F.col("o_orderpriority").alias("product"),
            )
            .withColumn("email", email_key(F.col("email_raw")))
            .withColumn("phone", phone_key(F.col("phone_raw")))
        )

    @cached_property
    def ad_costs(self) -> DataFrame:
        joined = (
            self.read("lineitem").join(self.read("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
            .join(self.read("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        )
        month = F.date_trunc("month", "l_shipdate").cast("timestamp_ntz")
        nation = F.lpad(F.col("s_nationkey").cast("string"), 14, "0")
        return joined.groupBy(
            F.concat(F.lit("1202"), nation).alias("campaign_id"), F.col("n_name").alias("campaign_name"),
            F.col("s_suppkey").alias("adset_id"), F.col("s_name").alias("adset_name"),
            F.col("l_partkey").alias("ad_id"), month.alias("report_month"),
        ).agg(F.sum("l_quantity").alias("spend"), F.count("*").alias("results"))

    @cached_property
    def survey(self) -> DataFrame:
        split = F.when(F.col("doc_id") % 10 < 7, "train").otherwise("prod")
        return (
            self.read("documents").select("doc_id", "lang", "source", "n_chars")
            .join(self.read("labels"), "doc_id", "left").withColumn("split", split)
        )

    @cached_property
    def scored(self) -> DataFrame:
        """Leads with their quantile decile."""
        return dec.with_qcut(self.leads, "lead_score")

    @cached_property
    def matched(self) -> DataFrame:
        """Leads with decile, campaign class and first sale."""
        leads = self.scored.withColumn("ml_type", campaign_class(F.col("campaign")))
        return link.attribute_sales(leads, self.sales)

    @cached_property
    def leads_utm(self) -> DataFrame:
        """Scored leads whose UTM values name the suppliers and parts of the cost rows."""
        s = self.read("supplier").select("s_suppkey", "s_name", "s_nationkey")
        p = self.read("part").select("p_partkey", "p_name")
        sizes = s.agg(F.count("*").alias("n_s")).crossJoin(p.agg(F.count("*").alias("n_p")))  # one row
        lead = F.col("lead_id")
        nation = F.lpad(F.col("s_nationkey").cast("string"), 14, "0")
        medium = F.when(lead % 7 == 0, "paid").when(lead % 11 == 0, "{{adset.name}}").otherwise(F.col("s_name"))
        content = F.when(lead % 19 == 0, None).when(lead % 3 == 0, F.upper("p_name")).otherwise(F.col("p_name"))
        return (
            self.scored.crossJoin(F.broadcast(sizes)).withColumn("_s", lead % F.col("n_s")).withColumn("_p", lead % F.col("n_p"))
            .join(s, F.col("_s") == F.col("s_suppkey")).join(p, F.col("_p") == F.col("p_partkey"))
            .withColumn("campaign", F.concat(F.lit("DEMO | CAP | FRIO | FASE 01 | "), F.col("s_name"), F.lit(" | PG2 | 2024-01-15|1202"), nation))
            .withColumn("medium", medium).withColumn("content", content)
            .withColumn("source", F.when(lead % 4 == 2, "google-ads").otherwise("facebook-ads"))
            .drop("_s", "_p", "n_s", "n_p", "s_suppkey", "s_name", "s_nationkey", "p_partkey", "p_name")
        )

    @cached_property
    def ads(self) -> DataFrame:
        """Daily ad costs with names and budget flags."""
        joined = (
            self.read("lineitem").join(self.read("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
            .join(self.read("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
            .join(self.read("part"), F.col("l_partkey") == F.col("p_partkey"))
        )
        day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("l_orderkey") % 30).cast("int"))
        nation = F.lpad(F.col("s_nationkey").cast("string"), 14, "0")
        return joined.groupBy(
            F.concat(F.lit("1202"), nation).alias("campaign_id"), F.col("n_name").alias("campaign_name"),
            F.col("s_suppkey").alias("adset_id"), F.col("s_name").alias("adset_name"),
            F.col("l_partkey").alias("ad_id"), F.col("p_name").alias("ad_name"), day.alias("day"),
            (F.col("s_nationkey") % 2 == 0).alias("has_campaign_budget"), (F.col("s_suppkey") % 3 == 0).alias("has_adset_budget"),
        ).agg(F.sum("l_quantity").alias("spend"), F.count("*").alias("results"))

    @cached_property
    def adset_rows(self) -> DataFrame:
        """Adset report rows: one per adset and month, arms by parity of the nation."""
        c = self.ad_costs
        goal = F.when(F.col("adset_id") % 4 == 0, "LeadQualified").otherwise("OFFSITE_CONVERSIONS")
        return c.groupBy("campaign_id", "campaign_name", "adset_id", F.col("report_month").cast("date").alias("report_start")).agg(
            F.sum("spend").alias("spend"), F.sum("results").cast("double").alias("leads_standard"),
            F.sum(F.when(F.col("ad_id") % 2 == 0, F.col("results")).otherwise(0)).cast("double").alias("lead_qualified"),
        ).select(
            "*", F.concat(F.lit("Set "), F.col("adset_id") % 5).alias("adset_name"), F.last_day("report_start").alias("report_end"),
            F.when(F.col("adset_id") % 2 == 0, F.lit(50.0)).otherwise(0.0).alias("budget"), goal.alias("optimization_goal"),
            F.when(F.substr("campaign_id", F.lit(18)).cast("int") % 2 == 0, "COM_ML").otherwise("SEM_ML").alias("ml_type"),
            F.concat(F.lit("account "), F.substr("campaign_id", F.lit(18))).alias("_account_name"),
        )

    @cached_property
    def ad_rows(self) -> DataFrame:
        """Ad report rows: one per ad, with a code shared between arms."""
        # summed by the narrow keys; names come to the sums, as a supplier has one campaign
        sums = self.read("lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("spend"))
        named = sums.join(self.read("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(self.read("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        c = named.select(
            F.concat(F.lit("1202"), F.lpad(F.col("s_nationkey").cast("string"), 14, "0")).alias("campaign_id"), F.col("n_name").alias("campaign_name"),
            F.col("s_suppkey").alias("adset_id"), F.col("l_partkey").alias("ad_id"), "spend",
        )
        return c.select(
            "*", F.concat(F.lit("Set "), F.col("adset_id") % 5).alias("adset_name"),
            F.concat(F.lit("DEV-AD0"), F.col("ad_id") % 40, F.lit("-vid")).alias("ad_name"),
            F.concat(F.lit("AD0"), F.col("ad_id") % 40).alias("ad_code"),
            F.when(F.substr("campaign_id", F.lit(18)).cast("int") % 2 == 0, "COM_ML").otherwise("SEM_ML").alias("ml_type"),
        )

    @cached_property
    def leads_arms(self) -> DataFrame:
        """Matched leads with medium and content that occur in the adset and ad rows."""
        lead = F.col("lead_id")
        named = F.when(lead % 9 == 0, F.concat(F.lit("set  "), lead % 5)).otherwise(F.concat(F.lit("Set "), lead % 5))
        group = F.when(F.substring_index("campaign", "|", -1).cast("decimal(20,0)") % 2 == 0, "Eventos ML").otherwise("Controle")
        return (
            self.matched.withColumn("medium", named).withColumn("content", F.concat(F.lit("DEV-AD0"), lead % 40, F.lit("-vid")))
            .withColumn("comparison_group", group)
        )

    @cached_property
    def captures(self) -> DataFrame:
        """Captured web leads seen in the events table."""
        e = F.col("lead_id")
        return self.leads.select(
            e.alias("id"), "email", F.when(e % 4 != 0, F.lower("name")).alias("name"),
            F.when(e % 2 == 0, F.concat(F.lit("Ana"), e % 7)).alias("first_name"), F.when(e % 4 == 0, "Silva").alias("last_name"),
            "phone", F.when(e % 3 != 0, F.concat(F.lit("fb.1."), e)).alias("fbp"), F.when(e % 5 == 0, F.concat(F.lit("fb.2."), e)).alias("fbc"),
            F.concat(F.lit("ev"), e).alias("event_id"), F.col("captured_at").alias("created_at"),
            F.col("campaign").alias("utm_campaign"), F.col("medium").alias("utm_medium"), F.col("term").alias("utm_term"),
        )

    @cached_property
    def targeted(self) -> DataFrame:
        return link.target_by_email_or_phone(self.leads, self.sales)


_EMAIL = """CASE WHEN lower(trim({c})) LIKE '%@%' AND length(trim({c})) > 5 THEN lower(trim({c})) END"""
_DIGITS = "regexp_replace({c}, '[^0-9]', '', 'g')"
_NATIONAL = (
    "CASE WHEN starts_with({d}, '55') AND length({d}) > 10 THEN substr({d}, 3) ELSE {d} END"
).format(d=_DIGITS)
_PHONE = "CASE WHEN length({n}) BETWEEN 8 AND 11 THEN {n} END"


def email_sql(c: str) -> str:
    return _EMAIL.format(c=c)


def national_sql(c: str) -> str:
    return _NATIONAL.format(c=c)


def phone_sql(c: str) -> str:
    return _PHONE.format(n=f"({national_sql(c)})")


PROBS_SQL = "[" + ", ".join(str(k / 10) for k in range(1, 10)) + "]"


def decile_sql(score: str = "lead_score", edges: str = "e") -> str:
    arms = " ".join(f"WHEN {score} <= {edges}[{k}] THEN {k}" for k in range(1, 10))
    return f"CASE WHEN {score} IS NULL THEN NULL {arms} ELSE 10 END"


_CTES = f"""
leads_raw AS (
  SELECT e.event_id AS lead_id,
         CASE WHEN e.event_id % 17 = 0 THEN NULL
              WHEN e.event_id % 5 = 0 THEN concat('  ', upper(c.c_name), '@MAIL.COM ')
              ELSE concat(lower(c.c_name), '@mail.com') END AS email_raw,
         CASE WHEN e.event_id % 13 = 0 THEN NULL
              WHEN e.event_id % 3 = 0 THEN concat('+55 (11) 9', lpad(CAST(c.c_custkey AS VARCHAR), 8, '0'))
              ELSE concat('119', lpad(CAST(c.c_custkey AS VARCHAR), 8, '0')) END AS phone_raw,
         e.ts AS captured_at,
         concat('DEMO | CAP | FRIO | ', c.c_mktsegment,
                CASE WHEN e.event_type IN ('purchase', 'signup') THEN ' | ML | ' ELSE ' | SCORE | ' END,
                '2024-01-01|1202', lpad(CAST(c.c_nationkey AS VARCHAR), 14, '0')) AS campaign,
         CASE WHEN e.event_type = 'click' THEN 'ADV | Audience A'
              WHEN e.event_type = 'view' THEN 'audience  a.'
              WHEN e.event_type = 'error' THEN '{{{{adset.name}}}}'
              ELSE 'ABERTO' END AS medium,
         CASE WHEN e.event_id % 4 = 0 THEN 'ig' WHEN e.event_id % 4 = 1 THEN 'fb'
              WHEN e.event_id % 4 = 2 THEN concat('kw', CAST(e.user_id AS VARCHAR), '--1--2') ELSE NULL END AS term,
         CASE WHEN e.value < 500 THEN e.value / 500 ELSE 1.0E0 END AS lead_score, c.c_name AS name
  FROM events e JOIN customer c ON e.user_id = c.c_custkey),
leads AS (SELECT *, {email_sql('email_raw')} AS email, {phone_sql('phone_raw')} AS phone,
                 CASE WHEN campaign LIKE '%| ML |%' THEN 'COM_ML' ELSE 'SEM_ML' END AS ml_type FROM leads_raw),
sales_raw AS (
  SELECT o.o_orderkey AS sale_id,
         CASE WHEN c.c_acctbal >= 5500 THEN concat(lower(c.c_name), '@mail.com') ELSE concat('buyer', c.c_custkey, '@shop.com') END AS email_raw,
         concat(CASE WHEN c.c_acctbal >= 5500 THEN '119' ELSE '219' END, lpad(CAST(c.c_custkey AS VARCHAR), 8, '0')) AS phone_raw,
         o.o_totalprice AS sale_value, DATE '2024-01-01' + CAST(o.o_orderkey % 60 AS INT) AS sale_date,
         CASE WHEN o.o_orderstatus = 'F' THEN 'guru' ELSE 'tmb' END AS sale_origin,
         o.o_orderpriority AS product
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  WHERE o.o_orderstatus <> 'P'),
sales AS (SELECT *, {email_sql('email_raw')} AS email, {phone_sql('phone_raw')} AS phone FROM sales_raw),
ad_costs AS (
  SELECT concat('1202', lpad(CAST(s.s_nationkey AS VARCHAR), 14, '0')) AS campaign_id,
         n.n_name AS campaign_name, s.s_suppkey AS adset_id, s.s_name AS adset_name,
         l.l_partkey AS ad_id, date_trunc('month', l.l_shipdate) AS report_month,
         sum(l.l_quantity) AS spend, count(*) AS results
  FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN nation n ON s.s_nationkey = n.n_nationkey
  GROUP BY s.s_nationkey, n.n_name, s.s_suppkey, s.s_name, l.l_partkey, date_trunc('month', l.l_shipdate)),
survey AS (
  SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic,
         CASE WHEN d.doc_id % 10 < 7 THEN 'train' ELSE 'prod' END AS split
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
ads AS (
  SELECT concat('1202', lpad(CAST(s.s_nationkey AS VARCHAR), 14, '0')) AS campaign_id, n.n_name AS campaign_name,
         s.s_suppkey AS adset_id, s.s_name AS adset_name, l.l_partkey AS ad_id, p.p_name AS ad_name,
         DATE '2024-01-01' + CAST(l.l_orderkey % 30 AS INT) AS day, s.s_nationkey % 2 = 0 AS has_campaign_budget,
         s.s_suppkey % 3 = 0 AS has_adset_budget, sum(l.l_quantity) AS spend, count(*) AS results
  FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey
  JOIN part p ON l.l_partkey = p.p_partkey GROUP BY ALL),
adset_rows AS (
  SELECT campaign_id, campaign_name, adset_id, CAST(report_month AS DATE) AS report_start, last_day(report_month) AS report_end,
         sum(spend) AS spend, CAST(sum(results) AS DOUBLE) AS leads_standard,
         CAST(sum(CASE WHEN ad_id % 2 = 0 THEN results ELSE 0 END) AS DOUBLE) AS lead_qualified,
         concat('Set ', adset_id % 5) AS adset_name, CASE WHEN adset_id % 2 = 0 THEN 50.0 ELSE 0.0 END AS budget,
         CASE WHEN adset_id % 4 = 0 THEN 'LeadQualified' ELSE 'OFFSITE_CONVERSIONS' END AS optimization_goal,
         CASE WHEN CAST(substr(campaign_id, 18) AS INT) % 2 = 0 THEN 'COM_ML' ELSE 'SEM_ML' END AS ml_type,
         concat('account ', substr(campaign_id, 18)) AS account_name
  FROM ad_costs GROUP BY ALL),
ad_rows AS (
  SELECT campaign_id, campaign_name, adset_id, ad_id, sum(spend) AS spend, concat('Set ', adset_id % 5) AS adset_name,
         concat('AD0', ad_id % 40) AS ad_code,
         CASE WHEN CAST(substr(campaign_id, 18) AS INT) % 2 = 0 THEN 'COM_ML' ELSE 'SEM_ML' END AS ml_type
  FROM ad_costs GROUP BY ALL),
edges AS (SELECT quantile_cont(lead_score, {PROBS_SQL}) AS e FROM leads),
scored AS (SELECT leads.*, {decile_sql()} AS decile FROM leads, edges),
first_by_email AS (
  SELECT email AS k, sale_value, sale_date, sale_origin FROM (
    SELECT *, row_number() OVER (PARTITION BY email ORDER BY sale_date, sale_value, sale_origin) AS rn
    FROM sales WHERE email IS NOT NULL) WHERE rn = 1),
first_by_phone AS (
  SELECT phone AS k, sale_value, sale_date, sale_origin FROM (
    SELECT *, row_number() OVER (PARTITION BY phone ORDER BY sale_date, sale_value, sale_origin) AS rn
    FROM sales WHERE phone IS NOT NULL) WHERE rn = 1),
matched AS (
  SELECT s.*, coalesce(e.k, p.k) IS NOT NULL AS converted,
         CASE WHEN e.k IS NOT NULL THEN 'email' WHEN p.k IS NOT NULL THEN 'telefone' END AS match_method,
         coalesce(CASE WHEN e.k IS NOT NULL THEN e.sale_value ELSE p.sale_value END, 0.0) AS sale_value,
         CASE WHEN e.k IS NOT NULL THEN e.sale_date ELSE p.sale_date END AS sale_date,
         CASE WHEN e.k IS NOT NULL THEN e.sale_origin ELSE p.sale_origin END AS sale_origin
  FROM scored s LEFT JOIN first_by_email e ON s.email = e.k LEFT JOIN first_by_phone p ON s.phone = p.k),
leads_utm AS (
  SELECT c.* EXCLUDE (campaign, medium), p.p_name AS part_name,
         concat('DEMO | CAP | FRIO | FASE 01 | ', s.s_name, ' | PG2 | 2024-01-15|1202', lpad(CAST(s.s_nationkey AS VARCHAR), 14, '0')) AS campaign,
         CASE WHEN lead_id % 7 = 0 THEN 'paid' WHEN lead_id % 11 = 0 THEN '{{{{adset.name}}}}' ELSE s.s_name END AS medium,
         CASE WHEN lead_id % 19 = 0 THEN NULL WHEN lead_id % 3 = 0 THEN upper(p.p_name) ELSE p.p_name END AS content,
         CASE WHEN lead_id % 4 = 2 THEN 'google-ads' ELSE 'facebook-ads' END AS source
  FROM scored c JOIN supplier s ON c.lead_id % (SELECT count(*) FROM supplier) = s.s_suppkey
  JOIN part p ON c.lead_id % (SELECT count(*) FROM part) = p.p_partkey),
leads_arms AS (
  SELECT * EXCLUDE (medium), CASE WHEN lead_id % 9 = 0 THEN concat('set  ', lead_id % 5) ELSE concat('Set ', lead_id % 5) END AS medium,
         concat('AD0', lead_id % 40) AS ad_code, right(campaign, 18) AS campaign_id,
         CASE WHEN CAST(right(campaign, 2) AS INT) % 2 = 0 THEN 'Eventos ML' ELSE 'Controle' END AS comparison_group
  FROM matched),
captures AS (
  SELECT lead_id AS id, email, CASE WHEN lead_id % 4 <> 0 THEN lower(name) END AS name,
         CASE WHEN lead_id % 2 = 0 THEN concat('Ana', lead_id % 7) END AS first_name, CASE WHEN lead_id % 4 = 0 THEN 'Silva' END AS last_name,
         phone, CASE WHEN lead_id % 3 <> 0 THEN concat('fb.1.', lead_id) END AS fbp, CASE WHEN lead_id % 5 = 0 THEN concat('fb.2.', lead_id) END AS fbc,
         concat('ev', lead_id) AS event_id, captured_at AS created_at, campaign AS utm_campaign, medium AS utm_medium, term AS utm_term
  FROM leads),
targeted AS (
  SELECT l.*, CAST(l.email IN (SELECT k FROM first_by_email) OR
      coalesce(length(l.phone) >= 10 AND l.phone IN (SELECT k FROM first_by_phone WHERE length(k) >= 10), false) AS INT) AS t
  FROM leads l),
target_leads AS (SELECT * EXCLUDE (t), coalesce(t, 0) AS target FROM targeted)
"""


def sql(body: str, extra: str = "") -> str:
    """SQL text over the bound views; ``extra`` adds further ``name AS (...)`` items."""
    return f"WITH {_CTES.strip()}{', ' + extra if extra else ''}\n{body}"
