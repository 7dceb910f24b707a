"""Ad-platform reports and insight rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import utm as u
from ..functions.dates import overlaps
from ..functions.text import collapse_spaces, nfc, thousands
from ..operators.costs import effective_goal, with_budget_flag
from ..operators.joins import left_lookup
from ..schemas import INSIGHTS
from .tables import list_files, read_table

# Report headings and their names here. The first present one counts.
HEADINGS = {
    "campaign_name": ("Nome da campanha",),
    "spend": ("Valor usado (BRL)",),
    "results": ("Resultados",),
    "optimization_goal_indicator": ("Indicador de resultados",),
    "campaign_id": ("Identificação da campanha",),
    "budget": ("Orçamento da campanha", "Orçamento do conjunto de anúncios"),
    "budget_type": ("Tipo de orçamento do conjunto de anúncios", "Tipo de orçamento da campanha"),
    "adset_name": ("Nome do conjunto de anúncios",),
    "adset_id": ("Identificação do conjunto de anúncios",),
    "ad_name": ("Nome do anúncio",),
    "ad_id": ("Identificação do anúncio",),
    "leads_standard": ("Leads",),
    "lead_qualified": ("LeadQualified",),
    "lead_qualified_hq": ("LeadQualifiedHighQuality",),
    "faixa_a": ("Faixa A",),
    "report_start": ("Início dos relatórios",),
    "report_end": ("Término dos relatórios",),
}
NAMES = ("campaign_name", "adset_name", "ad_name")
IDS = ("campaign_id", "adset_id", "ad_id")
EVENTS = ("leads_standard", "lead_qualified", "lead_qualified_hq", "faixa_a")
REPORT_KINDS = ("campaign", "adset", "ad")


def report_kind(file_name: Column) -> Column:
    """``campaign``, ``adset`` or ``ad`` from a file name (composed Unicode)."""
    name = nfc(file_name)
    plain = F.lower(F.translate(name, "ú", "u"))
    adsets = plain.contains("conjuntos")
    return (
        F.when(adsets & plain.contains("anuncios"), "adset").when(~adsets & plain.contains("anuncios"), "ad")
        .when(plain.contains("campanhas"), "campaign")
    )


def account_of_file(file_name: Column) -> Column:
    """``Ads---My-Account-Campanhas-...`` gives ``My Account``."""
    part = F.regexp_extract(nfc(file_name), "^[^-]*(?:-[^-]+)*---(.+?)(?:-Campanhas-|-Conjuntos-|-Anúncios-|---|$)", 1)
    return F.when(part != "", F.translate(part, "-", " ")).otherwise("Unknown")


def scan_reports(spark: SparkSession, path: str, fmt: str = "csv") -> dict[str, DataFrame]:
    """The kinds of report found under a folder, tagged with file and account, normalised."""
    listed = list_files(spark, path, fmt)
    files = listed.select("path", report_kind(F.col("file_name")).alias("kind")).collect()
    # once for each file, not for each row
    accounts = listed.select(F.col("file_name").alias("_source_file"), account_of_file(F.col("file_name")).alias("_account_name")).distinct()
    out = {}
    for kind in REPORT_KINDS:
        paths = sorted(f["path"] for f in files if f["kind"] == kind)
        if paths:
            raw = read_table(spark, paths, fmt).withColumnRenamed("arquivo_origem", "_source_file").drop("aba_origem")
            out[kind] = normalise_report(raw.join(accounts, "_source_file", "left"), kind)
    return out


def normalise_report(raw: DataFrame, kind: str) -> DataFrame:
    """Common names, single blanks, numbers without thousands separators, text ids cut to
    15 digits, event columns 0 when absent, simplified goal, ad code."""
    out = {}
    for to, headings in HEADINGS.items():
        present = [F.col(f"`{h}`") for h in (*headings, to) if h in raw.columns]
        if present:
            out[to] = F.coalesce(*[p.cast("string") for p in present])
    for c in NAMES:
        if c in out:
            out[c] = collapse_spaces(out[c])
    for c in ("spend", "results", "budget"):
        if c in out:
            out[c] = thousands(out[c])
    for c in IDS:
        if c in out:
            out[c] = F.substr(F.regexp_replace(out[c], r"\.0$", ""), F.lit(1), F.lit(15))
    for c in EVENTS:
        out[c] = F.coalesce(out[c].try_cast("double"), F.lit(0.0)) if c in out else F.lit(0.0)
    for c in ("report_start", "report_end"):
        if c in out:
            out[c] = out[c].try_cast("date")
    if "optimization_goal_indicator" in out:
        out["optimization_goal"] = u.goal_name(out["optimization_goal_indicator"])
    if kind == "ad" and "ad_name" in out:
        out["ad_code"] = u.ad_code(out["ad_name"])
    kept = [c for c in ("_source_file", "_account_name", "_is_edge_case") if c in raw.columns]
    return raw.select(*[v.alias(k) for k, v in out.items()], *kept)


def with_edge_cases(rows: DataFrame, edge: DataFrame, id_col: str) -> DataFrame:
    """Separately exported rows replace the report rows of the same id."""
    main = rows.join(edge.select(id_col).distinct(), id_col, "left_anti").withColumn("_is_edge_case", F.lit(False))
    return main.unionByName(edge.withColumn("_is_edge_case", F.lit(True)), allowMissingColumns=True)


def in_period(rows: DataFrame, start: str, end: str) -> DataFrame:
    """Rows whose report interval overlaps the period."""
    return rows.filter(overlaps(F.col("report_start"), F.col("report_end"), start, end))


def zero_spend_outside(rows: DataFrame, start: str, end: str) -> DataFrame:
    """All rows; spend is 0 outside the period, ``total_spend`` keeps what was spent."""
    inside = overlaps(F.col("report_start"), F.col("report_end"), start, end)
    return rows.withColumn("total_spend", F.col("spend")).withColumn(
        "spend", F.when(~inside, F.lit(0.0)).otherwise(F.col("spend"))
    )


def read_insights(spark: SparkSession, path: str) -> DataFrame:
    """Landed insight rows (JSON lines) with a declared schema."""
    return spark.read.schema(INSIGHTS).json(path)


def insight_costs(insights: DataFrame) -> DataFrame:
    """Ad-level insight rows to flat cost rows."""
    costs = with_budget_flag(insights)
    goal = effective_goal(F.col("promoted_object.custom_event_str"), F.col("optimization_goal"))
    return costs.select(
        "campaign_id", "campaign_name", "adset_id", "adset_name", "ad_id", "ad_name",
        F.coalesce(F.col("spend").try_cast("double"), F.lit(0.0)).alias("spend"), "has_campaign_budget",
        "daily_budget", "lifetime_budget", goal.alias("optimization_goal"), F.col("date_start").alias("day"),
    )


def log_events(lines: DataFrame) -> DataFrame:
    """``(email, event)`` of text log lines (column ``value``)."""
    from ..functions.events import log_email, log_event

    out = lines.select(log_email(F.col("value")).alias("email"), log_event(F.col("value")).alias("event"))
    return out.filter("email IS NOT NULL AND event IS NOT NULL")


def log_events_by_campaign(events: DataFrame, campaign_ids: DataFrame) -> DataFrame:
    """Events per campaign id and type; e-mails without a campaign are left out."""
    from ..functions.events import LOGGED_EVENTS

    named = left_lookup(events, campaign_ids.select("email", "campaign_id"), "email").filter("campaign_id IS NOT NULL")
    return named.groupBy("campaign_id").agg(*[F.count_if(F.col("event") == e).alias(e) for e in LOGGED_EVENTS])
