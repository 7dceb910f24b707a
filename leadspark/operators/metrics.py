"""Campaign, decile, arm and overall metrics of matched leads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DECILES, DEFAULTS, Settings
from ..functions import economics as eco
from ..functions import utm as u
from ..functions.text import percent_difference, safe_ratio
from ..session import stored
from .costs import enrich_costs
from .joins import left_lookup
from .utm import consolidate_campaigns


def _r2(c: Column) -> Column:
    return F.round(c, 2)


def campaign_base_stats(matched: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Responses, distinct converters and revenue per (class, consolidated campaign).

    When no sale carries a value, revenue is converters times the product value; the
    campaigns' totals show that, which are written once, so the leads are not summed again.
    """
    named = consolidate_campaigns(matched)
    sold = F.col("converted")
    adjusted = eco.adjusted_value(F.col("sale_value"), F.col("sale_origin"), settings)
    stats = named.groupBy("ml_type", F.col("campaign_consolidated").alias("campaign")).agg(
        F.count("email").alias("responses"),
        F.sum("sale_value").alias("total_revenue"),
        F.count_distinct(F.when(sold, F.col("email"))).alias("conversions"),
        F.coalesce(F.sum(F.when(sold, adjusted)), F.lit(0.0)).alias("total_revenue_adjusted"),
    )
    stats = stored(stats, "campaign-stats")
    paid = stats.agg((F.coalesce(F.sum("total_revenue"), F.lit(0.0)) != 0).alias("_paid"))
    flat = F.col("conversions") * F.lit(settings.product_value)
    out = stats.crossJoin(F.broadcast(paid))  # one row
    for c in ("total_revenue", "total_revenue_adjusted"):
        out = out.withColumn(c, F.when(F.col("_paid"), F.col(c)).otherwise(flat))
    return out.drop("_paid")


def impute_leads(stats: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Leads of campaigns whose lead event does not fire: their qualified leads over the
    pooled qualified-per-lead ratio of the other campaigns."""
    if not settings.impute_lead_ids or "lead_qualified" not in stats.columns:
        return stats
    prefix = F.substr(u.campaign_id(F.col("campaign")), F.lit(1), F.lit(15))
    special = F.coalesce(prefix.isin(*[i[:15] for i in settings.impute_lead_ids]), F.lit(False))
    known = ~special & prefix.isNotNull() & (F.col("leads") > 0) & (F.col("lead_qualified") > 0)
    ratio = stats.filter(known).agg((F.sum("lead_qualified") / F.sum("leads")).alias("_ratio"))
    fixed = F.when(
        special & (F.col("lead_qualified") > 0) & (F.col("_ratio") > 0),
        F.floor(F.col("lead_qualified") / F.col("_ratio")),
    ).otherwise(F.col("leads"))
    return stats.crossJoin(F.broadcast(ratio)).withColumn("leads", fixed).drop("_ratio")  # one row


def campaign_metrics(matched: DataFrame, costs: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Rates, cost per lead, ROAS and margin per campaign, best margin first.

    Campaigns with neither spend, leads nor conversions are left out.
    """
    # one row for each campaign, written before it is sorted and compared
    stats = stored(impute_leads(enrich_costs(campaign_base_stats(matched, settings), stored(costs, "campaign-costs")), settings), "campaign-table")
    spend, leads, revenue = F.col("spend"), F.col("leads"), F.col("total_revenue")
    active = stats.filter((spend > 0) | (leads > 0) | (F.col("conversions") > 0))
    out = (
        active.withColumn("response_rate", _r2(safe_ratio(F.col("responses"), leads, 100)))
        .withColumn("conversion_rate", _r2(safe_ratio(F.col("conversions"), leads, 100)))
        .withColumn("cpl", _r2(safe_ratio(spend, leads)))
        .withColumn("roas", _r2(safe_ratio(revenue, spend)))
        .withColumn("contribution_margin", _r2(revenue - spend))
        .withColumn("roas_adjusted", _r2(safe_ratio(F.col("total_revenue_adjusted"), spend)))
    )
    return out.withColumn(
        "margin_percent", _r2(safe_ratio(F.col("contribution_margin"), spend, 100))
    ).orderBy(F.desc("contribution_margin"), "campaign", "ml_type")


def top_campaigns(metrics: DataFrame, n: int = 15) -> DataFrame:
    return metrics.orderBy(F.desc("contribution_margin"), "campaign", "ml_type").limit(n)


def decile_performance(matched: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Vendor-A and total conversions per decile against the expected rate."""
    ok = F.col("converted")
    per = matched.filter(F.col("decile").isNotNull()).groupBy("decile").agg(
        F.count("*").alias("leads"),
        F.count_if(ok & (F.col("sale_origin") == "guru")).alias("conversions_guru"),
        F.count_if(ok).alias("conversions_total"),
    )
    expected = eco.rate_of(F.col("decile"), settings.rates) * 100.0
    out = per.withColumn("expected_conversion_rate", _r2(expected))
    for kind in ("guru", "total"):
        done = F.col(f"conversions_{kind}")
        rate = done * 100.0 / F.col("leads")
        out = (
            out.withColumn(f"conversion_rate_{kind}", _r2(rate))
            .withColumn(f"performance_ratio_{kind}", _r2(safe_ratio(rate, expected)))
            .withColumn(f"revenue_{kind}", _r2(done * F.lit(settings.product_value)))
        )
    return out


_ARM = ("leads", "conversions", "total_revenue", "spend", "total_revenue_adjusted")


def arm_totals(metrics: DataFrame, arm: str = "ml_type") -> DataFrame:
    """Totals and ratios of totals per arm."""
    sums = metrics.groupBy(arm).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _ARM])
    return _arm_ratios(sums)


def _arm_ratios(df: DataFrame) -> DataFrame:
    c = F.col
    return (
        df.withColumn("conversion_rate", _r2(safe_ratio(c("conversions"), c("leads"), 100)))
        .withColumn("cpl", _r2(safe_ratio(c("spend"), c("leads"))))
        .withColumn("roas", _r2(safe_ratio(c("total_revenue"), c("spend"))))
        .withColumn("margin", _r2(c("total_revenue") - c("spend")))
        .withColumn("roas_adjusted", _r2(safe_ratio(c("total_revenue_adjusted"), c("spend"))))
        .withColumn("margin_adjusted", _r2(c("total_revenue_adjusted") - c("spend")))
        .withColumns({k: _r2(c(k)) for k in ("total_revenue", "spend", "total_revenue_adjusted")})
    )


def compare_arms(metrics: DataFrame, treated: str = "COM_ML", control: str = "SEM_ML", arm: str = "ml_type") -> DataFrame:
    """One row: every measure of both arms and their difference in percent of the control."""
    both = metrics.sparkSession.range(0, 2).select(
        F.when(F.col("id") == 0, treated).otherwise(control).alias(arm)
    )
    totals = both.join(arm_totals(metrics, arm), arm, "left").na.fill(0)
    return arm_difference(totals, arm, treated, control)


def arm_difference(totals: DataFrame, arm: str, treated: str, control: str) -> DataFrame:
    """Two rows of numbers, one per arm, as one row: ``treated_*``, ``control_*`` and the
    difference in percent of the control, ``diff_*``."""
    measures = [c for c in totals.columns if c != arm]
    at = lambda k, m: F.max(F.when(F.col(arm) == k, F.col(m)))
    one = totals.agg(
        *[at(treated, m).alias(f"treated_{m}") for m in measures],
        *[at(control, m).alias(f"control_{m}") for m in measures],
    )
    diffs = {f"diff_{m}": _r2(percent_difference(F.col(f"treated_{m}"), F.col(f"control_{m}"))) for m in measures}
    return one.withColumns(diffs)


def overall_stats(matched: DataFrame, metrics: DataFrame, sales: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """Overall figures: all sales of the period against matched leads and total spend."""
    ok = F.col("converted")
    from_leads = matched.agg(
        F.count("*").alias("total_leads"), F.count_if(ok).alias("matched_conversions"),
        F.count_if(ok & (F.col("sale_origin") == "guru")).alias("conversions_guru_matched"),
        F.count_if(ok & (F.col("sale_origin") == "tmb")).alias("conversions_tmb_matched"),
    )
    from_sales = sales.agg(
        F.count("*").alias("total_conversions"), F.coalesce(F.sum("sale_value"), F.lit(0.0)).alias("total_revenue"),
        F.count_if(F.col("sale_origin") == "guru").alias("conversions_guru_total"),
        F.count_if(F.col("sale_origin") == "tmb").alias("conversions_tmb_total"),
    )
    from_costs = metrics.agg(
        F.coalesce(F.sum("spend"), F.lit(0.0)).alias("total_spend"), F.coalesce(F.sum("leads"), F.lit(0)).alias("total_leads_meta")
    )
    out = from_leads.crossJoin(from_sales).crossJoin(from_costs)  # one row each
    if excluded is not None:
        out = out.crossJoin(excluded.agg(F.count("*").alias("excluded_leads")))
    else:
        out = out.withColumn("excluded_leads", F.lit(0).cast("long"))
    c = F.col
    return (
        out.withColumn("total_leads_including_excluded", c("total_leads") + c("excluded_leads"))
        .withColumn("conversion_rate", _r2(safe_ratio(c("total_conversions"), c("total_leads"), 100)))
        .withColumn("roas", _r2(safe_ratio(c("total_revenue"), c("total_spend"))))
        .withColumn("margin", _r2(c("total_revenue") - c("total_spend")))
        .withColumns({k: _r2(c(k)) for k in ("total_revenue", "total_spend")})
    )


def group_metrics(matched: DataFrame, metrics: DataFrame, group: str = "comparison_group") -> DataFrame:
    """Metrics per comparison group; spend is summed over the group's distinct campaigns."""
    ok = F.col("converted")
    per = matched.filter(F.col(group).isNotNull()).groupBy(group).agg(
        F.count("*").alias("leads"), F.count_distinct(F.when(ok, F.col("email"))).alias("conversions"),
        F.coalesce(F.sum(F.when(ok, F.col("sale_value"))), F.lit(0.0)).alias("total_revenue"),
    )
    cost = metrics.groupBy("campaign").agg(F.max("spend").alias("spend"))
    paid = (
        matched.select(group, "campaign").distinct().join(cost, "campaign").groupBy(group).agg(F.sum("spend").alias("spend"))
    )
    c = F.col
    return (
        left_lookup(per, paid, group).fillna({"spend": 0.0})
        .withColumn("conversion_rate", _r2(safe_ratio(c("conversions"), c("leads"), 100)))
        .withColumn("cpl", _r2(safe_ratio(c("spend"), c("leads"))))
        .withColumn("roas", _r2(safe_ratio(c("total_revenue"), c("spend"))))
        .withColumn("margin", _r2(c("total_revenue") - c("spend")))
        .withColumns({k: _r2(c(k)) for k in ("total_revenue", "spend")})
    )


def adjusted_overall(matched: DataFrame, spend: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Nominal and realisation-adjusted revenue and ROAS; ``spend`` is a frame with ``spend``."""
    sold = matched.filter("converted").withColumn(
        "_adjusted", eco.adjusted_value(F.col("sale_value"), F.col("sale_origin"), settings)
    )
    tmb, guru = F.col("sale_origin") == "tmb", F.col("sale_origin") == "guru"
    total = lambda c, cond=None: F.coalesce(F.sum(F.when(cond, F.col(c)) if cond is not None else F.col(c)), F.lit(0.0))
    one = sold.agg(
        F.count("*").alias("conversions"), F.count_if(tmb).alias("conversions_tmb"), F.count_if(guru).alias("conversions_guru"),
        total("sale_value").alias("revenue"), total("_adjusted").alias("revenue_adjusted"),
        total("sale_value", tmb).alias("revenue_tmb"), total("_adjusted", tmb).alias("revenue_tmb_adjusted"),
        total("sale_value", guru).alias("revenue_guru"),
    ).crossJoin(spend.agg(F.coalesce(F.sum("spend"), F.lit(0.0)).alias("_spend")))  # one row each
    c = F.col
    return (
        one.withColumn("adjustment", _r2(c("revenue") - c("revenue_adjusted")))
        .withColumn("roas", _r2(safe_ratio(c("revenue"), c("_spend"))))
        .withColumn("roas_adjusted", _r2(safe_ratio(c("revenue_adjusted"), c("_spend"))))
        .withColumn("factor", F.lit(settings.instalment_factor))
        .withColumns({k: _r2(c(k)) for k in ("revenue", "revenue_adjusted", "revenue_tmb", "revenue_tmb_adjusted", "revenue_guru")})
        .drop("_spend")
    )


def event_counts(insights: DataFrame, adsets: DataFrame, events: tuple[str, ...] = ("lead", *DEFAULTS.model_events)) -> DataFrame:
    """Event counts per campaign from nested action rows.

    ``insights`` has ``campaign_id, adset_id, actions array<struct<action_type, value>>``;
    a generic custom conversion counts as the event its adset promotes.
    """
    rows = insights.select("campaign_id", "adset_id", F.explode("actions").alias("a")).select(
        "campaign_id", "adset_id", F.col("a.action_type").alias("type"), F.col("a.value").cast("double").alias("value")
    )
    promoted = adsets.groupBy("adset_id").agg(F.min("custom_event").alias("custom_event"))
    named = left_lookup(rows, promoted, "adset_id")
    event = F.when(F.col("type") == "lead", "lead").when(
        F.col("type") == "offsite_conversion.fb_pixel_custom", F.col("custom_event")
    )
    return (
        named.withColumn("event", event).groupBy("campaign_id").pivot("event", list(events)).agg(F.sum("value")).na.fill(0.0)
    )


def with_event_counts(campaigns: DataFrame, counts: DataFrame) -> DataFrame:
    """Campaigns with their event counts; a missing counter is 0."""
    measures = [c for c in counts.columns if c != "campaign_id"]
    keyed = campaigns.withColumn("_id", u.campaign_id(F.col("campaign")))
    return left_lookup(keyed, counts, "_id", "campaign_id").drop("_id").na.fill(0.0, measures)
