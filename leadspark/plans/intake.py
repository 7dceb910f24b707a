"""Queries: report files, tables that are updated in place, nested action rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import actions
from ..session import checkpoint_dir, children, remove, rename, stored
from ..sources import report_source, upsert
from .bindings import sql
from .registry import query


def _folder(spark, label: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


#: Rows of a report file; longer reports are several files, each with its headings.
REPORT_ROWS = 500_000


def _write_reports(t, folder: str) -> None:
    """Adset rows in files of three different headings, and ad rows in those of one, named as the platform names them.

    A report is as many files as there are tasks that write it, so no task holds a whole report.
    """
    group = F.substr("campaign_id", F.lit(18)).cast("int") % 3
    rows, c = stored(t.adset_rows.withColumn("_g", group), "report-rows"), F.col
    split = c("adset_id") % 2 == 0
    layouts = [
        {"Nome da campanha": c("campaign_name"), "Identificação da campanha": c("campaign_id"), "Nome do conjunto de anúncios": F.concat(F.lit(" "), F.regexp_replace("adset_name", " ", "  ")),
         "Identificação do conjunto de anúncios": c("adset_id"), "Valor usado (BRL)": c("spend"), "Orçamento da campanha": c("budget"), "Leads": c("leads_standard"),
         "Início dos relatórios": c("report_start"), "Término dos relatórios": c("report_end")},
        {"Término dos relatórios": c("report_end"), "Início dos relatórios": c("report_start"), "Impressões": F.lit("1,000"), "Valor usado (BRL)": F.format_number(c("spend").cast("double"), 2),
         "Identificação do conjunto de anúncios": F.concat(c("adset_id").cast("string"), F.lit(".0")), "Nome do conjunto de anúncios": c("adset_name"),
         "Orçamento do conjunto de anúncios": c("budget"), "Nome da campanha": c("campaign_name"), "Identificação da campanha": c("campaign_id")},
        {"spend": c("spend"), "adset_id": c("adset_id"), "adset_name": c("adset_name"), "campaign_id": c("campaign_id"), "campaign_name": c("campaign_name"),
         "Orçamento da campanha": F.when(split, c("budget")), "Orçamento do conjunto de anúncios": F.when(~split, c("budget")),
         "Leads": F.when(split, c("leads_standard").cast("string")).otherwise("n/d"), "report_start": c("report_start"), "report_end": c("report_end"), "Nota": F.lit("a,\n\"b\"")},
    ]
    parts = [(rows.filter(c("_g") == k).select(*(v.alias(n) for n, v in layout.items())), f"Ads---Conta-{k}-Conjuntos-de-anúncios-jan.csv") for k, layout in enumerate(layouts)]
    parts.append((t.ad_rows.select(c("ad_name").alias("Nome do anúncio"), c("ad_id").alias("Identificação do anúncio"), c("spend").alias("Valor usado (BRL)")), "Ads---Conta-0-Anúncios-jan"))
    for k, (part, name) in enumerate(parts):
        part.write.option("header", True).option("escape", '"').option("maxRecordsPerFile", REPORT_ROWS).csv(f"{folder}/parts/{k}")
        written = [n for n in children(t.spark, f"{folder}/parts/{k}") if n.endswith(".csv")]
        for number, one in enumerate(written):
            rename(t.spark, f"{folder}/parts/{k}/{one}", f"{folder}/reports/{k % 2}/{name}-{number}.csv")
    remove(t.spark, f"{folder}/parts")


@query(
    "report_intake",
    sql("""SELECT CAST(adset_id AS VARCHAR) AS adset_id, left(campaign_id, 15) AS campaign_id, campaign_name, adset_name, 'Conta ' || (CAST(substr(campaign_id, 18) AS INT) % 3) AS account,
  CAST(spend AS DOUBLE) AS spend, CAST(budget AS DOUBLE) AS budget, report_start, report_end,
  CASE CAST(substr(campaign_id, 18) AS INT) % 3 WHEN 0 THEN leads_standard WHEN 2 THEN CASE WHEN adset_id % 2 = 0 THEN leads_standard ELSE 0.0 END ELSE 0.0 END AS leads_standard
FROM adset_rows"""),
)
def report_intake(t):
    """Files of three headings, written and read back through the data source."""
    folder = _folder(t.spark, "reports")
    _write_reports(t, folder)
    rows = report_source.read_reports(t.spark, f"{folder}/reports", "adset")
    return rows.select(
        "adset_id", "campaign_id", "campaign_name", "adset_name", F.col("_account_name").alias("account"), F.col("spend").cast("double").alias("spend"),
        F.col("budget").cast("double").alias("budget"), "report_start", "report_end", "leads_standard",
    )


@query(
    "report_accounts",
    sql("""SELECT 'Conta ' || (CAST(substr(campaign_id, 18) AS INT) % 3) AS account, count(*) AS report_rows, round(CAST(sum(spend) AS DOUBLE), 2) AS spend
FROM adset_rows WHERE CAST(substr(campaign_id, 18) AS INT) % 3 <> 1 GROUP BY ALL"""),
)
def report_accounts(t):
    """Spend of two accounts; the files of the others are not opened."""
    folder = _folder(t.spark, "reports")
    _write_reports(t, folder)
    rows = report_source.read_reports(t.spark, f"{folder}/reports", "adset", ["Conta 0", "Conta 2"])
    return rows.groupBy(F.col("_account_name").alias("account")).agg(F.count("*").alias("report_rows"), F.round(F.sum(F.col("spend").cast("double")), 2).alias("spend"))


@query(
    "upsert_edge_cases",
    sql("""SELECT adset_id, report_start, CAST(spend AS DOUBLE) AS spend FROM adset_rows WHERE adset_id % 10 NOT IN (3, 7)
UNION ALL SELECT adset_id, DATE '2024-02-01', 2.0 * CAST(sum(spend) AS DOUBLE) FROM adset_rows WHERE adset_id % 10 = 3 GROUP BY adset_id
UNION ALL SELECT adset_id, report_start, CAST(spend AS DOUBLE) + 1.0 FROM adset_rows WHERE adset_id % 10 = 7 AND adset_id % 20 <> 7
UNION ALL SELECT adset_id, report_start, CAST(spend AS DOUBLE) + 2.0 FROM adset_rows WHERE adset_id % 20 = 7"""),
)
def upsert_edge_cases(t):
    """Report rows replaced by their separately exported ones: a repeated batch, and one published after a failure."""
    path = f"{_folder(t.spark, 'upsert')}/table"
    rows = t.adset_rows.select("adset_id", "report_start", F.col("spend").cast("double").alias("spend"))
    upsert.create(rows, path, ["adset_id"])
    edge = rows.filter("adset_id % 10 = 3").groupBy("adset_id").agg(F.lit("2024-02-01").cast("date").alias("report_start"), (2 * F.sum("spend")).alias("spend"))
    for _ in range(2):
        upsert.upsert(edge, path, ["adset_id"], "edge-1")
    seven = rows.filter("adset_id % 10 = 7")
    upsert.upsert(seven.withColumn("spend", F.col("spend") + 1), path, ["adset_id"], "edge-2", publish=False)
    # the next call publishes what was staged
    upsert.upsert(seven.filter("adset_id % 20 = 7").withColumn("spend", F.col("spend") + 2), path, ["adset_id"], "edge-3")
    return upsert.read(t.spark, path).drop("bucket")


@query(
    "upsert_scores",
    sql("SELECT lead_id, email, CASE WHEN lead_id % 2 = 0 THEN lead_score END AS lead_score, CASE WHEN lead_id % 2 = 0 THEN decile END AS decile FROM scored"),
)
def upsert_scores(t):
    """Scores written back to the rows that they belong to; all other columns and rows stay."""
    path = f"{_folder(t.spark, 'upsert')}/table"
    upsert.create(t.leads.select("lead_id", "email", F.lit(None).cast("double").alias("lead_score"), F.lit(None).cast("int").alias("decile")), path, ["lead_id"])
    upsert.upsert(t.scored.filter("lead_id % 2 = 0").select("lead_id", "lead_score", F.col("decile").cast("int").alias("decile")), path, ["lead_id"], "scores", replace_all=False)
    return upsert.read(t.spark, path).drop("bucket")


_NAMES = ("lead", "LeadQualified", "LeadQualifiedHighQuality", "Faixa A")
_ACTION_ROWS = """raw AS (SELECT event_id AS i, CAST(json_extract(props, '$.k') AS BIGINT) AS k, 'c' || (user_id % 12) AS campaign_id, user_id % 40 AS adset FROM events
    WHERE event_id % 23 <> 0 AND event_id % 19 <> 0 AND event_id % 17 <> 0 AND user_id % 12 <> 11),
acts AS (SELECT campaign_id, 'lead' AS event, k AS n FROM raw
    UNION ALL SELECT campaign_id, CASE adset % 5 WHEN 0 THEN 'LeadQualified' WHEN 1 THEN 'LeadQualifiedHighQuality' WHEN 2 THEN 'Faixa A' WHEN 3 THEN 'Other' END, k + 1 FROM raw WHERE i % 3 <> 0),
names(event) AS (VALUES ('lead'), ('LeadQualified'), ('LeadQualifiedHighQuality'), ('Faixa A'))"""


def _payloads(t):
    """Insights as JSON text with the events' own numbers: some null, some cut off, some without actions."""
    i, k = F.col("event_id"), F.get_json_object("props", "$.k")
    custom = F.when(i % 3 != 0, F.concat(F.lit(',{"action_type":"offsite_conversion.fb_pixel_custom","value":'), (k.cast("long") + 1).cast("string"), F.lit("}"))).otherwise(
        F.lit(',{"action_type":"offsite_conversion.fb_pixel_custom","value":"many"},{"action_type":"video_view","value":7}'))
    body = F.concat(F.lit(',"actions":[{"action_type":"lead","value":"'), k, F.lit('"}'), custom, F.lit("]"))
    text = F.concat(F.lit('{"campaign_id":"c'), F.col("user_id") % 12, F.lit('","adset_id":'), F.col("user_id") % 40, F.when(i % 17 == 0, "").otherwise(body), F.lit("}"))
    text = F.when(i % 23 == 0, None).when(i % 19 == 0, F.substr(text, F.lit(1), F.length(text) - 3)).otherwise(text)
    # one campaign has no payload with a campaign id
    text = F.when(F.col("user_id") % 12 == 11, F.regexp_replace(text, "campaign_id", "campaign")).otherwise(text)
    return t.read("events").select(text.alias("payload"))


def _adsets(t):
    event = F.element_at(F.array(*map(F.lit, ("LeadQualified", "LeadQualifiedHighQuality", "Faixa A", "Other", None))), (F.col("adset_id") % 5 + 1).cast("int"))
    return t.read("events").select((F.col("user_id") % 40).alias("adset_id")).distinct().select(F.col("adset_id").cast("string").alias("adset_id"), event.alias("custom_event"))


@query(
    "nested_action_counts",
    f"""WITH {_ACTION_ROWS} SELECT c.campaign_id, names.event, CAST(coalesce(sum(n), 0) AS BIGINT) AS n
FROM (SELECT DISTINCT campaign_id FROM acts) c CROSS JOIN names LEFT JOIN acts ON acts.campaign_id = c.campaign_id AND acts.event = names.event GROUP BY ALL""",
)
def nested_action_counts(t):
    names = t.spark.createDataFrame([(n,) for n in _NAMES], "event string")
    return actions.campaign_events(actions.shredded(_payloads(t)), _adsets(t), names)


@query(
    "missing_event_counters",
    f"""WITH {_ACTION_ROWS}, per AS (SELECT campaign_id, sum(n) AS n FROM acts WHERE event = 'Faixa A' GROUP BY 1)
SELECT 'c' || k AS campaign_id, CAST(coalesce(n, 0) AS BIGINT) AS events FROM (SELECT DISTINCT user_id % 14 AS k FROM events) LEFT JOIN per ON per.campaign_id = 'c' || k""",
)
def missing_event_counters(t):
    """A counter by name for campaigns with and without events."""
    names = t.spark.createDataFrame([(n,) for n in _NAMES], "event string")
    events = actions.campaign_events(actions.shredded(_payloads(t)), _adsets(t), names)
    campaigns = t.read("events").select(F.concat(F.lit("c"), F.col("user_id") % 14).alias("campaign_id")).distinct()
    return actions.counter(events, campaigns, "Faixa A")


@query(
    "unreadable_payloads",
    """SELECT count(*) AS insights, count(*) FILTER (event_id % 23 = 0) AS missing, count(*) FILTER (event_id % 23 <> 0 AND event_id % 19 = 0) AS malformed FROM events""",
)
def unreadable_payloads(t):
    return actions.unreadable(_payloads(t))
