"""Decile construction, thresholds and decile-level quality measures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DECILES
from ..functions.deciles import bin_by_edges, by_thresholds
from .quantiles import exact_quantiles, running_totals

PROBS = tuple(k / 10 for k in range(1, 10))


def qcut_edges(df: DataFrame, column: str = "lead_score", probs=PROBS) -> list[float]:
    """Inner edges of equal-count bins; edges that coincide are merged."""
    wanted = [0.0, *probs, 1.0]
    edges = sorted(set(exact_quantiles(df, column, wanted)))
    return edges[1:-1]


def with_qcut(df: DataFrame, column: str = "lead_score", to: str = "decile", edges: list[float] | None = None) -> DataFrame:
    """Right-closed quantile decile 1..10; equal scores share a bin."""
    edges = qcut_edges(df, column) if edges is None else edges
    return df.withColumn(to, bin_by_edges(F.col(column), edges))


def thresholds(df: DataFrame, column: str = "lead_score", decile: str = "decile") -> DataFrame:
    """Score range, count, mean and spread per decile: at most ten rows."""
    return df.filter(F.col(decile).isNotNull()).groupBy(decile).agg(
        F.min(column).alias("threshold_min"),
        F.max(column).alias("threshold_max"),
        F.count("*").alias("count"),
        F.avg(column).alias("mean_probability"),
        F.stddev_samp(column).alias("std_probability"),
    )


def bands(table: DataFrame) -> list[tuple[int, float, float]]:
    """The threshold rows (one per decile) on the driver, to be folded into expressions."""
    rows = table.select("decile", "threshold_min", "threshold_max").take(len(DECILES) + 1)
    if len(rows) > len(DECILES):
        raise ValueError(f"a threshold table has at most {len(DECILES)} rows")
    return [tuple(r) for r in rows]


def assign_deciles(df: DataFrame, table: DataFrame | list, column: str = "lead_score", to: str = "decile") -> DataFrame:
    """Decile by fixed thresholds (a threshold table or its collected bands)."""
    known = table if isinstance(table, list) else bands(table)
    return df.withColumn(to, by_thresholds(F.col(column), known))


def threshold_checks(table: DataFrame, max_gap: float = 0.01) -> DataFrame:
    """Gap and overlap of each band with the next one (a window over ten rows)."""
    w = Window.orderBy("decile")
    gap = F.lead("threshold_min").over(w) - F.col("threshold_max")
    return (
        table.select("decile", F.lead("decile").over(w).alias("next_decile"), gap.alias("gap"))
        .filter("next_decile IS NOT NULL")
        .withColumn("has_gap", F.col("gap") > max_gap)
        .withColumn("overlaps", F.col("gap") < 0)
    )


def all_deciles(df: DataFrame) -> DataFrame:
    """The ten deciles as a table, to keep empty ones in a report."""
    return df.sparkSession.range(1, 11).select(F.col("id").cast("int").alias("decile"))


def decile_counts(df: DataFrame, decile: str = "decile") -> DataFrame:
    counts = df.filter(F.col(decile).isNotNull()).groupBy(F.col(decile).alias("decile")).agg(F.count("*").alias("n"))
    return all_deciles(df).join(counts, "decile", "left").fillna({"n": 0})


def conversion_by_decile(matched: DataFrame) -> DataFrame:
    """Leads, conversions and rate in percent for each of the ten deciles."""
    counts = (
        matched.filter(F.col("decile").isNotNull()).groupBy("decile")
        .agg(F.count("*").alias("total_leads"), F.count_if("converted").alias("conversions"))
    )
    rate = F.round(F.coalesce(F.try_divide(F.col("conversions") * 100.0, "total_leads"), F.lit(0.0)), 2)
    return (
        all_deciles(matched).join(counts, "decile", "left").fillna({"total_leads": 0, "conversions": 0})
        .withColumn("conversion_rate", rate)
    )


def threshold_stability(df: DataFrame, decile: str = "decile", max_cv: float = 0.5, max_top3: float = 60.0, max_one: float = 50.0, max_empty: int = 2) -> DataFrame:
    """Spread of leads over threshold deciles and whether it is acceptable.

    The coefficient of variation is over deciles that hold leads; the top three are the
    three highest deciles that do.
    """
    counts = df.filter(F.col(decile).isNotNull()).groupBy(F.col(decile).alias("decile")).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.orderBy(F.desc("decile")))  # at most ten rows
    one = counts.withColumn("r", rank).agg(
        F.sum("n").alias("leads"),
        (F.stddev_samp("n") / F.avg("n")).alias("cv"),
        (F.sum(F.when(F.col("r") <= 3, F.col("n"))) * 100.0 / F.sum("n")).alias("top3_pct"),
        (F.max("n") * 100.0 / F.sum("n")).alias("max_pct"),
        (F.lit(len(DECILES)) - F.count("*")).alias("empty_deciles"),
    )
    viable = (
        (F.col("cv") <= max_cv) & (F.col("top3_pct") <= max_top3)
        & (F.col("max_pct") <= max_one) & (F.col("empty_deciles") <= max_empty)
    )
    return one.withColumn("viable", viable)


def compare_decile_counts(df: DataFrame, left: str, right: str) -> DataFrame:
    """Count per decile under two labellings, with absolute and relative difference."""
    a = decile_counts(df, left).withColumnRenamed("n", "n_left")
    b = decile_counts(df, right).withColumnRenamed("n", "n_right")
    diff = F.col("n_right") - F.col("n_left")
    return (
        a.join(b, "decile").withColumn("diff", diff)
        .withColumn("diff_pct", F.coalesce(F.try_divide(diff * 100.0, "n_left"), F.lit(0.0)))
    )


def score_summary(df: DataFrame, column: str = "lead_score", decile: str = "decile") -> DataFrame:
    return df.groupBy(decile).agg(
        F.count("*").alias("leads"), F.avg(column).alias("mean_score"),
        F.min(column).alias("min_score"), F.max(column).alias("max_score"),
    )


def cumulative_revenue(by_decile: DataFrame, revenue: str = "revenue") -> DataFrame:
    """Running revenue from the best decile down, and its share (a window over ten rows)."""
    down = Window.orderBy(F.desc("decile")).rowsBetween(Window.unboundedPreceding, 0)
    total = Window.partitionBy()
    running = F.sum(revenue).over(down)
    share = F.coalesce(F.try_divide(running * 100.0, F.sum(revenue).over(total)), F.lit(0.0))
    return by_decile.withColumn("cumulative_revenue", running).withColumn("cumulative_pct", share)


def auc(df: DataFrame, score: str = "lead_score", target: str = "target", rows: str | None = None) -> DataFrame:
    """Exact area under the ROC curve as one row: probability that a positive outscores a
    negative, ties counting half. ``rows`` names a column of how many rows each row stands for."""
    times = F.lit(1) if rows is None else F.col(rows)
    marked = df.filter(F.col(score).isNotNull()).select(
        score, (times * F.col(target)).cast("long").alias("p"), (times * (1 - F.col(target))).cast("long").alias("q")
    )
    t = running_totals(marked, score, {"pos": "p", "neg": "q"})
    wins = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2.0))
    return t.agg(F.try_divide(wins, F.sum("pos").cast("double") * F.sum("neg")).alias("auc"))


def decile_lift(df: DataFrame, target: str = "target", decile: str = "decile") -> DataFrame:
    """Leads, conversions, rate, share of conversions and lift per non-empty decile."""
    per = df.filter(F.col(decile).isNotNull()).groupBy(F.col(decile).alias("decile")).agg(
        F.count("*").alias("total_leads"), F.sum(target).alias("conversions")
    )
    every = Window.partitionBy()  # at most ten rows
    rate = F.col("conversions") / F.col("total_leads")
    base = F.sum("conversions").over(every) / F.sum("total_leads").over(every)
    share = F.try_divide(F.col("conversions") * 100.0, F.sum("conversions").over(every))
    return (
        per.withColumn("conversion_rate", F.round(rate, 4))
        .withColumn("conversion_share", F.round(share, 2))
        .withColumn("lift", F.round(F.try_divide(F.round(rate, 4), base), 2))
    )


def ranking_metrics(df: DataFrame, score: str = "lead_score", target: str = "target", decile: str = "decile") -> DataFrame:
    """AUC, top-3 and top-5 concentration, maximum lift, monotonicity and D10/D1, one row.

    Monotonicity is the share of steps between neighbouring deciles that do not fall.
    """
    per = decile_lift(df, target, decile)
    up = Window.orderBy("decile")
    step = per.withColumn("previous", F.lag("conversion_rate").over(up)).withColumn(
        "from_top", F.row_number().over(Window.orderBy(F.desc("decile")))
    )
    top = lambda k: F.sum(F.when(F.col("from_top") <= k, F.col("conversion_share")))
    rate_at = lambda k: F.max(F.when(F.col("decile") == k, F.col("conversion_rate")))
    rises = (F.col("conversion_rate") >= F.col("previous")).cast("double")
    one = step.agg(
        top(3).alias("top3_share"), top(5).alias("top5_share"), F.max("lift").alias("max_lift"),
        F.coalesce(F.avg(F.when(F.col("previous").isNotNull(), rises)) * 100.0, F.lit(100.0)).alias("monotonicity"),
        F.coalesce(F.try_divide(rate_at(10), rate_at(1)), F.lit(0.0)).alias("d10_over_d1"),
        F.sum("conversions").alias("conversions"),
    )
    return one.crossJoin(auc(df, score, target))  # one row each


def decile_shares(label: str = "decile") -> list:
    """Aggregates ``pct_d1 .. pct_d10``: percent of the group's rows in each decile."""
    return [
        (F.count_if(F.col(label) == k) * 100.0 / F.count("*")).alias(f"pct_d{k}") for k in DECILES
    ]


def share_columns() -> list:
    return [F.col(f"pct_d{k}") / 100.0 for k in DECILES]
