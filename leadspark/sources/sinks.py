"""Sinks: snapshots, exports, scored tables and report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import compare, deciles, metrics, profile
from ..operators.joins import left_lookup
from ..operators.model import LeadScorer
from .tables import read_table


def snapshot(captures: DataFrame, path: str, n: int = 1000, time: str = "created_at", tie: str = "id") -> DataFrame:
    """Truncate and load the newest ``n`` rows as JSON lines."""
    rows = captures.orderBy(F.desc(time), F.desc(tie)).limit(n)
    rows.write.mode("overwrite").json(path)
    return rows


def recent_view(captures: DataFrame, name: str, as_of: str, days: int = 7, time: str = "created_at") -> None:
    captures.filter(F.col(time) >= F.date_sub(F.lit(as_of).cast("date"), days)).createOrReplaceTempView(name)


def export_categories(df: DataFrame, column: str, path: str) -> DataFrame:
    """Ranked shares of a column as CSV."""
    table = profile.category_shares(df, [column])
    table.orderBy("rank").coalesce(1).write.mode("overwrite").option("header", True).csv(path)  # one row per category
    return table


def top_leads(scored: DataFrame, n: int, score: str = "lead_score", tie: str = "lead_id") -> DataFrame:
    return scored.orderBy(F.desc_nulls_last(score), tie).limit(n)


def write_scored(scored: DataFrame, path: str, n: int | None = None) -> DataFrame:
    """Scored leads, best first (the top ``n`` if given), and a summary per decile."""
    out = scored.orderBy(F.desc_nulls_last("lead_score")) if n is None else top_leads(scored, n)
    out.write.mode("overwrite").parquet(f"{path}/leads")
    summary = deciles.score_summary(scored)
    summary.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/summary")
    return summary


def scores_to_rows(rows: DataFrame, scores: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Scores joined back to the source rows by id, never by position."""
    return left_lookup(rows.drop("lead_score", "decile"), scores.select(row_id, "lead_score", "decile"), row_id)


def append_captures(df: DataFrame, path: str, time: str = "created_at") -> None:
    """Append captures by day, so that period filters prune folders."""
    df.withColumn("day", F.to_date(time)).write.mode("append").partitionBy("day").parquet(path)


def score_file(spark: SparkSession, path: str, scorer: LeadScorer, mapping: DataFrame | None = None, valid: DataFrame | None = None) -> DataFrame:
    """Rows of a lead file with score and decile. Rows without a ``row_id`` are known by a
    hash of their content: equal rows are scored once and all keep the score."""
    raw = read_table(spark, path, provenance=False)
    if "row_id" not in raw.columns:
        raw = raw.withColumn("row_id", F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in raw.columns])), 256))
    scores = scorer.score(raw.dropDuplicates(["row_id"]), ("row_id",), mapping, valid)
    return scores_to_rows(raw, scores)


def report_tables(
    matched: DataFrame, sales: DataFrame, campaign_metrics: DataFrame, config: DataFrame | None = None,
    adsets: dict[str, DataFrame] | None = None, ads: dict[str, DataFrame] | None = None, all_adsets: DataFrame | None = None,
    legacy: DataFrame | None = None, legacy_instances: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Every table of the validation report, by name."""
    from ..operators import link

    out = {
        "overall": metrics.overall_stats(matched, campaign_metrics, sales),
        "campaigns": campaign_metrics,
        "top_campaigns": metrics.top_campaigns(campaign_metrics),
        "buyers": link.tracked_buyers(matched, sales).orderBy(F.desc("tracked"), "sale_date"),
        "deciles": metrics.decile_performance(matched),
        "cumulative_revenue": deciles.cumulative_revenue(metrics.decile_performance(matched), "revenue_total"),
        "ml_comparison": metrics.compare_arms(campaign_metrics),
        "matching": link.matching_stats(matched, sales),
        "adjusted": metrics.adjusted_overall(matched, campaign_metrics),
    }
    if "comparison_group" in matched.columns:
        out["groups"] = metrics.group_metrics(matched, campaign_metrics)
    if config is not None:
        out["settings"] = config
    if all_adsets is not None:
        out["all_adsets"] = all_adsets
    for name, tables in (("adsets", adsets), ("ads", ads)):
        for part, table in (tables or {}).items():
            out[f"{name}_{part}"] = compare.sorted_report(table) if part == "detailed" else table
    if legacy is not None:
        out["legacy"] = legacy
    if legacy_instances is not None:
        out["legacy_instances"] = legacy_instances
    return out


def write_report(tables: dict[str, DataFrame], path: str) -> None:
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")
