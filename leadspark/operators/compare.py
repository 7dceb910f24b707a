"""Treated against control: comparison groups, matched adsets and ads, arm tables.

Report rows carry ``campaign_id, campaign_name, adset_id, adset_name, spend`` and event
columns; matched leads carry ``campaign, medium, content, email, converted, sale_value``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..functions import economics as eco
from ..functions import utm as u
from ..functions.text import collapse_spaces, ratio_den1, safe_ratio
from ..session import stored
from .joins import left_lookup

EVENTS, OPTIMISED, CONTROL, OTHER = "Eventos ML", "Otimização ML", "Controle", "Outro"
LEGACY = "Faixa A"


def _c15(column: str | Column) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.substr(c.cast("string"), F.lit(1), F.lit(15))


def _pair(*columns) -> Column:
    """One text key of several columns, null when any is null."""
    parts = [F.col(c) if isinstance(c, str) else c for c in columns]
    known = parts[0].isNotNull()
    for p in parts[1:]:
        known = known & p.isNotNull()
    return F.when(known, F.concat_ws("\u0001", *[p.cast("string") for p in parts]))


# -- groups -----------------------------------------------------------------------------


def refined_groups(campaigns: DataFrame, arms: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """``(id15, comparison_group)`` from an ``arms(campaign_id, arm)`` table.

    Treated campaigns (``COM_ML``) that optimise for a model event, or are listed for lead
    imputation, are event campaigns; other treated ones are optimised ones.
    """
    goals = campaigns.groupBy(_c15("campaign_id").alias("_k")).agg(F.max("optimization_goal").alias("_goal"))
    listed = arms.groupBy(_c15("campaign_id").alias("id15")).agg(F.max("arm").alias("_max"), F.min("arm").alias("_min"))
    special = F.col("id15").isin(*[i[:15] for i in settings.impute_lead_ids]) if settings.impute_lead_ids else F.lit(False)
    custom = F.lit(False)
    for event in settings.model_events:
        custom = custom | F.coalesce(F.col("_goal").contains(event), F.lit(False))
    group = (
        F.when(F.col("_max") == "SEM_ML", CONTROL).when(special | custom, EVENTS).otherwise(OPTIMISED)
    )
    return left_lookup(listed, goals, "id15", "_k").select("id15", group.alias("comparison_group"))


def with_refined_group(leads: DataFrame, groups: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Group of a lead by captured or named campaign id, else by its class."""
    named = u.id_suffix(F.col("campaign"), "18", None)
    known = F.coalesce(F.col("campaign_id_meta"), named) if "campaign_id_meta" in leads.columns else named
    keyed = leads.withColumn("_id15", _c15(known))
    table = groups.select(F.col("id15"), F.col("comparison_group").alias("_group"))
    fallback = F.when(F.col("ml_type") == "SEM_ML", CONTROL).when(F.col("ml_type") == "COM_ML", EVENTS).otherwise(OTHER)
    return (
        left_lookup(keyed, table, "_id15", "id15")
        .withColumn("comparison_group", F.coalesce("_group", fallback)).drop("_id15", "_group")
    )


def campaign_goal(adsets: DataFrame) -> DataFrame:
    """One goal per campaign: a model event if any adset uses one, else the first goal."""
    goal = F.coalesce("optimization_goal", F.lit("Lead"))
    has = lambda g: F.max((goal == g).cast("int")) == 1
    first, second = DEFAULTS.model_events
    return adsets.groupBy("campaign_id").agg(
        F.when(has(first), first).when(has(second), second).otherwise(F.min(goal)).alias("optimization_goal")
    )


def with_comparison_group(
    leads: DataFrame, controls: DataFrame, goals: DataFrame | None = None, custom: DataFrame | None = None,
    events_since: str = "2025-11-11", settings: Settings = DEFAULTS,
) -> DataFrame:
    """Group from class, goal, list of event campaigns, date in the name, control names.

    ``controls(campaign_name)`` names the fair controls, ``goals(campaign_id,
    optimization_goal)`` and ``custom(campaign_id)`` describe treated campaigns.
    """
    name = F.col("campaign")
    tail = u.id_suffix(name, "1,", None)
    df = leads.withColumn("_id", tail).withColumn(
        "_base", F.when(tail.isNotNull(), F.trim(F.regexp_replace(name, r"\|[^|]*$", ""))).otherwise(name)
    )
    if "optimization_goal" not in df.columns:
        if goals is None:
            df = df.withColumn("optimization_goal", F.lit(None).cast("string"))
        else:
            table = goals.select(F.col("campaign_id").cast("string").alias("_k"), "optimization_goal")
            df = left_lookup(df, table, "_id", "_k").fillna({"optimization_goal": "Lead"})
    listed = F.lit(False)
    if custom is not None:
        table = custom.select(F.col("campaign_id").cast("string").alias("_k"), F.lit(True).alias("_custom")).distinct()
        df = left_lookup(df, table, "_id", "_k")
        listed = F.coalesce("_custom", F.lit(False))
    fair = controls.select(F.col("campaign_name").alias("_n"), F.lit(True).alias("_fair")).distinct()
    df = left_lookup(df, fair, "campaign", "_n").withColumnRenamed("_fair", "_fair_full")
    df = left_lookup(df, fair, "_base", "_n")
    dated = F.regexp_extract(name, r"\| ([0-9]{4}-[0-9]{2}-[0-9]{2})", 1)
    events = F.col("optimization_goal").isin(*settings.model_events) | listed | (dated >= events_since)
    group = (
        F.when((F.col("ml_type") == "COM_ML") & F.coalesce(events, F.lit(False)), EVENTS)
        .when(F.col("ml_type") == "COM_ML", OPTIMISED)
        .when((F.col("ml_type") == "SEM_ML") & F.coalesce("_fair_full", "_fair"), CONTROL)
        .otherwise(OTHER)
    )
    extra = [c for c in ("_id", "_base", "_custom", "_fair", "_fair_full") if c in df.columns]
    return df.withColumn("comparison_group", group).drop(*extra)


def label_arms(rows: DataFrame, arms: DataFrame) -> DataFrame:
    """Report rows of the listed campaigns with their arm as ``ml_type``."""
    table = arms.select("campaign_id", F.col("arm").alias("ml_type")).dropDuplicates(["campaign_id"])
    return rows.join(table, "campaign_id")


def at_level(rows: DataFrame, allowed: DataFrame, column: str) -> DataFrame:
    """Rows whose campaign, ad code or adset is in the list of a comparison level."""
    return rows.join(allowed.select(column).distinct(), column, "left_semi")


# -- pairs ------------------------------------------------------------------------------


def names_in_both_arms(rows: DataFrame, column: str, min_spend: float = DEFAULTS.min_pair_spend, spend: str | None = None) -> DataFrame:
    """Names whose spend reaches ``min_spend`` in the treated and in the control arm.

    The total spend is used where the period's own spend was zeroed. Both arms are summed
    in one aggregate; a name is in the intersection when both sums pass.
    """
    spend = spend or ("total_spend" if "total_spend" in rows.columns else "spend")
    of = lambda arm: F.sum(F.when(F.col("ml_type") == arm, F.col(spend)))
    sums = rows.filter(F.col(column).isNotNull()).groupBy(column).agg(of("COM_ML").alias("_t"), of("SEM_ML").alias("_c"))
    return sums.filter((F.col("_t") >= min_spend) & (F.col("_c") >= min_spend)).select(column)


def matched_adsets(adsets: DataFrame, min_spend: float = DEFAULTS.min_pair_spend, allowed: DataFrame | None = None) -> DataFrame:
    """Adset rows of the names present in both arms (optionally of a fixed list only)."""
    rows = adsets.withColumn("adset_name", collapse_spaces(F.col("adset_name")))
    names = names_in_both_arms(rows, "adset_name", min_spend)
    if allowed is not None:
        names = names.join(allowed.select("adset_name"), "adset_name", "left_semi")
    out = rows.join(names, "adset_name", "left_semi")
    if "leads_standard" in out.columns:
        return out.withColumn("leads", F.col("leads_standard"))
    return out if "leads" in out.columns else out.withColumn("leads", F.lit(0.0))


def matched_ads(ads: DataFrame, min_spend: float = DEFAULTS.min_pair_spend, allowed: DataFrame | None = None) -> DataFrame:
    names = names_in_both_arms(ads, "ad_code", min_spend, "spend")
    if allowed is not None:
        names = names.join(allowed.select("ad_code"), "ad_code", "left_semi")
    return ads.join(names, "ad_code", "left_semi")


# -- performance ------------------------------------------------------------------------


def lead_stats(matched: DataFrame, *keys: Column, settings: Settings = DEFAULTS) -> DataFrame:
    """Leads, distinct converters and revenue per key; one row per key, so joins cannot
    repeat it."""
    ok = F.col("converted")
    adjusted = eco.adjusted_value(F.col("sale_value"), F.col("sale_origin"), settings)
    return matched.groupBy(*keys).agg(
        F.count("*").alias("lead_rows"),
        F.count_distinct(F.when(ok, F.col("email"))).alias("conversions"),
        F.coalesce(F.sum(F.when(ok, F.col("sale_value"))), F.lit(0.0)).alias("revenue"),
        F.coalesce(F.sum(F.when(ok, adjusted)), F.lit(0.0)).alias("revenue_adjusted"),
    )


_STATS = ("lead_rows", "conversions", "revenue", "revenue_adjusted")


def impute_adset_leads(rows: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Leads of listed campaigns that report none: qualified leads over a fixed ratio."""
    if not settings.impute_lead_ids or "lead_qualified" not in rows.columns:
        return rows
    special = _c15("campaign_id").isin(*[i[:15] for i in settings.impute_lead_ids])
    none = F.coalesce(F.col("leads"), F.lit(0)) == 0
    fixed = F.floor(F.col("lead_qualified") / F.lit(settings.imputation_ratio)).cast("double")
    return rows.withColumn("leads", F.when(special & none & (F.col("lead_qualified") > 0), fixed).otherwise(F.col("leads")))


def add_unit_ratios(df: DataFrame) -> DataFrame:
    """Per-row ratios; a zero denominator counts as 1."""
    c = F.col
    return (
        df.withColumn("cpl", ratio_den1(c("spend"), c("leads")))
        .withColumn("cpa", ratio_den1(c("spend"), c("conversions")))
        .withColumn("conversion_rate", ratio_den1(c("conversions"), c("leads"), 100))
        .withColumn("roas", ratio_den1(c("revenue"), c("spend")))
        .withColumn("margin", c("revenue") - c("spend"))
        .withColumn("margin_pct", ratio_den1(c("revenue") - c("spend"), c("revenue"), 100))
        .withColumn("roas_adjusted", ratio_den1(c("revenue_adjusted"), c("spend")))
    )


def aggregate_arms(df: DataFrame, arm: str, names: str) -> DataFrame:
    """Sums, means of the row ratios, and ROAS as ratio of sums, per arm."""
    total = lambda c: F.sum(c).alias(c)
    mean = lambda c: F.avg(c).alias(f"mean_{c}")
    sums = df.groupBy(arm).agg(
        F.count_distinct(names).alias("names"),
        *[total(c) for c in ("spend", "leads", "conversions", "revenue", "revenue_adjusted", "margin")],
        *[mean(c) for c in ("cpl", "cpa", "conversion_rate", "roas", "margin_pct")],
    )
    c = F.col
    return (
        sums.withColumn("roas", ratio_den1(c("revenue"), c("spend")))
        .withColumn("roas_adjusted", ratio_den1(c("revenue_adjusted"), c("spend")))
        .withColumn("margin_adjusted", c("revenue_adjusted") - c("spend"))
    )


def _fold_adsets(adsets: DataFrame, keys: list[str]) -> DataFrame:
    counted = [c for c in ("spend", "total_spend", "leads", "leads_standard", "lead_qualified", "lead_qualified_hq", "faixa_a") if c in adsets.columns]
    others = [c for c in adsets.columns if c not in keys and c not in counted]
    return adsets.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counted], *[F.min(c).alias(c) for c in others])


def compare_all_adsets(
    adsets: DataFrame, matched: DataFrame, settings: Settings = DEFAULTS, merge_optimised: bool = False
) -> DataFrame:
    """All adsets, event campaigns against control: totals and ratios of totals per group.

    The group of an adset is that of the leads it brought (``comparison_group``), joined
    on 15-digit campaign id and adset name.
    """
    rows = adsets.withColumn("_id15", _c15("campaign_id")).withColumn("adset_name", collapse_spaces(F.col("adset_name")))
    per = _fold_adsets(rows, ["_id15", "adset_name"]).withColumn("_key", _pair("_id15", "adset_name"))
    keyed = matched.withColumn("_lead_key", _pair(u.id_suffix(F.col("campaign")), collapse_spaces(F.col("medium"))))
    stats = lead_stats(keyed.filter("_lead_key IS NOT NULL"), F.col("_lead_key"), F.col("comparison_group"), settings=settings)
    full = per.join(stats, F.col("_key") == F.col("_lead_key"))  # adsets without leads have no group
    if "leads_standard" in full.columns:
        full = full.withColumn("leads", F.col("leads_standard"))
    full = impute_adset_leads(full.filter("NOT (leads = 0 AND spend = 0)"), settings)
    if merge_optimised:
        full = full.replace(OPTIMISED, CONTROL, "comparison_group")
    sums = full.filter(F.col("comparison_group").isin(EVENTS, CONTROL)).groupBy("comparison_group").agg(
        *[F.sum(c).alias(c) for c in ("leads", "conversions", "spend", "revenue", "revenue_adjusted")]
    )
    return _group_ratios(sums)


def _group_ratios(df: DataFrame) -> DataFrame:
    c = F.col
    return (
        df.withColumn("margin", c("revenue") - c("spend"))
        .withColumn("conversion_rate", safe_ratio(c("conversions"), c("leads")))
        .withColumn("cpl", safe_ratio(c("spend"), c("leads")))
        .withColumn("roas", safe_ratio(c("revenue"), c("spend")))
        .withColumn("roas_adjusted", safe_ratio(c("revenue_adjusted"), c("spend")))
        .withColumn("margin_adjusted", c("revenue_adjusted") - c("spend"))
    )


def _repaired(missing: DataFrame, adsets: DataFrame) -> DataFrame:
    """``(_id15, adset_name, conversions)`` for lead adset names that match a report name
    of the campaign only after folding case, or in 70 % of the shorter name (20+ chars).

    The prefix rule is an equi join: the shorter name contributes its own 70 % prefix, the
    longer one every prefix it could be asked for.
    """
    a = missing.select("_id15", "conversions", F.lower("adset_name").alias("a"))
    b = adsets.select("_id15", "adset_name", F.lower("adset_name").alias("b")).distinct()
    same = a.join(b, (a["_id15"] == b["_id15"]) & (F.col("a") == F.col("b"))).select(
        a["_id15"], "adset_name", "a", "conversions", F.lit(0).alias("rank")
    )

    def own(df, c):
        k = F.floor(F.length(c) * 0.7).cast("int")
        return df.filter(F.length(c) >= 20).withColumn("p", F.substr(F.col(c), F.lit(1), k))

    def every(df, c):
        k = F.floor(F.length(c) * 0.7).cast("int")
        cuts = F.transform(F.sequence(F.lit(14), k), lambda i: F.substr(F.col(c), F.lit(1), i))
        return df.filter(F.length(c) >= 20).withColumn("p", F.explode(cuts))

    parts = [same]
    for left, right, short, long in ((own(a, "a"), every(b, "b"), "a", "b"), (every(a, "a"), own(b, "b"), "b", "a")):
        hit = left.join(right, ["_id15", "p"]).filter(F.length(short) <= F.length(long))
        parts.append(hit.select("_id15", "adset_name", "a", "conversions", F.lit(1).alias("rank")))
    found = parts[0].unionByName(parts[1]).unionByName(parts[2])
    best = found.groupBy("_id15", "a").agg(
        F.min_by("adset_name", F.struct("rank", "adset_name")).alias("adset_name"), F.max("conversions").alias("conversions")
    )
    return best.groupBy("_id15", "adset_name").agg(F.max("conversions").alias("repaired"))


def compare_adsets(adsets: DataFrame, matched: DataFrame, groups: DataFrame | None = None, settings: Settings = DEFAULTS) -> dict[str, DataFrame]:
    """Adsets against their leads: ``detailed`` per adset and ``aggregated`` per arm.

    Conversions of lead adset names missing from the report are given to the adset found
    by :func:`_repaired`; revenue stays with exact matches. The report rows and the leads' totals
    are written once, as the table, the missing names and their repair all read them.
    """
    rows = stored(adsets.withColumn("_id15", _c15("campaign_id")).withColumn("adset_name", collapse_spaces(F.col("adset_name"))), "adset-rows")
    keyed = matched.withColumn("_id15", u.id_suffix(F.col("campaign"), "18,", 15)).withColumn(
        "adset_name", collapse_spaces(F.col("medium")))
    stats = lead_stats(keyed.filter("_id15 IS NOT NULL AND adset_name IS NOT NULL"), F.col("_id15"), F.col("adset_name"), settings=settings)
    stats = stored(stats, "adset-leads")
    per = _fold_adsets(rows, ["campaign_id", "adset_id"]).withColumn("_key", _pair("_id15", "adset_name"))
    table = stats.select(_pair("_id15", "adset_name").alias("_sk"), *_STATS)
    full = left_lookup(per, table, "_key", "_sk")
    known = rows.select("_id15", "adset_name").distinct()
    missing = stats.filter("conversions > 0").join(known, ["_id15", "adset_name"], "left_anti")
    fixes = _repaired(missing, rows).select(_pair("_id15", "adset_name").alias("_rk"), "repaired")
    full = left_lookup(full, fixes, "_key", "_rk").withColumn("conversions", F.coalesce("repaired", "conversions")).drop("repaired")
    full = full.fillna(0, list(_STATS))
    if "leads" not in full.columns:
        full = full.withColumn("leads", F.col("leads_standard") if "leads_standard" in full.columns else F.lit(0.0))
    full = impute_adset_leads(full.fillna({"leads": 0}), settings)
    full = add_unit_ratios(full.filter("spend > 0 OR leads > 0 OR conversions > 0"))
    detailed = with_group_of_campaign(full, groups).filter(F.col("comparison_group").isin(EVENTS, CONTROL))
    return {"aggregated": aggregate_arms(full, "ml_type", "adset_name"), "detailed": detailed.drop("_key", "_id15")}


def with_group_of_campaign(rows: DataFrame, groups: DataFrame | None) -> DataFrame:
    if groups is None:
        group = F.when(F.col("ml_type") == "COM_ML", EVENTS).when(F.col("ml_type") == "SEM_ML", CONTROL).otherwise(OTHER)
        return rows.withColumn("comparison_group", group)
    table = groups.select("id15", "comparison_group")
    return left_lookup(rows.withColumn("_g", _c15("campaign_id")), table, "_g", "id15").drop("_g")


def compare_ads(ads: DataFrame, matched: DataFrame, groups: DataFrame | None = None, settings: Settings = DEFAULTS) -> dict[str, DataFrame]:
    """Ads by code against their leads: per (code, group) and per group."""
    per = ads.withColumn("_id15", _c15("campaign_id")).groupBy("_id15", "ad_code", "ml_type").agg(
        F.sum("spend").alias("spend"),
        *[F.min(c).alias(c) for c in ("campaign_id", "campaign_name", "ad_name", "adset_name") if c in ads.columns],
    )
    keyed = matched.withColumn("_lead_key", _pair(u.id_suffix(F.col("campaign"), "18,", 15), u.ad_code(F.col("content"))))
    stats = lead_stats(keyed.filter("_lead_key IS NOT NULL"), F.col("_lead_key"), settings=settings)
    full = left_lookup(per.withColumn("_key", _pair("_id15", "ad_code")), stats, "_key", "_lead_key").fillna(0, list(_STATS))
    full = add_unit_ratios(full.withColumnRenamed("lead_rows", "leads"))
    full = with_group_of_campaign(full, groups).filter(F.col("comparison_group").isin(EVENTS, CONTROL))
    ratios = ("cpl", "cpa", "conversion_rate", "roas", "margin_pct")
    detailed = full.groupBy("ad_code", "comparison_group").agg(
        *[F.min(c).alias(c) for c in ("campaign_id", "campaign_name", "ad_name", "adset_name", "ml_type") if c in full.columns],
        *[F.sum(c).alias(c) for c in ("spend", "leads", "conversions", "revenue", "margin")],
        *[F.avg(c).alias(c) for c in ratios],
    )
    aggregated = full.groupBy("comparison_group").agg(
        F.count_distinct("ad_code").alias("ad_codes"),
        *[F.sum(c).alias(c) for c in ("spend", "leads", "conversions", "margin")],
        *[F.avg(c).alias(c) for c in ratios],
    )
    return {"aggregated": aggregated, "detailed": detailed}


def ads_in_matched_adsets(ads: DataFrame, adset_names: DataFrame, both_arms: bool = False, groups: DataFrame | None = None) -> DataFrame:
    """Ads whose adset is matched; with ``both_arms`` only codes present in both groups."""
    rows = ads.join(adset_names.select("adset_name").distinct(), "adset_name", "left_semi")
    if not both_arms:
        return rows
    grouped = with_group_of_campaign(rows, groups).filter(F.col("comparison_group").isin(EVENTS, CONTROL))
    both = (
        grouped.filter("ad_code IS NOT NULL").select("ad_code", "comparison_group").distinct()
        .groupBy("ad_code").count().filter("count = 2").select("ad_code")
    )
    return grouped.drop("comparison_group").join(both, "ad_code", "left_semi")


# -- legacy arm -------------------------------------------------------------------------


def legacy_adset_comparison(adsets: DataFrame, mapping: DataFrame, event_ids: DataFrame, matched: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Adsets shared between event campaigns and the legacy arm, totals per arm.

    ``mapping(adset_name, campaign_id, in_events)`` lists the legacy adsets and whether the
    event campaigns use them too; ``event_ids(campaign_id)`` the event campaigns.
    """
    mapped = mapping.withColumn("adset_name", collapse_spaces(F.col("adset_name")))
    names = mapped.filter("in_events > 0").select("adset_name").distinct()
    arms = event_ids.select(_c15("campaign_id").alias("id15"), F.lit(EVENTS).alias("comparison_group")).unionByName(
        mapped.select(_c15("campaign_id").alias("id15"), F.lit(LEGACY).alias("comparison_group")).filter(F.length("id15") >= 15)
    ).groupBy("id15").agg(F.min("comparison_group").alias("comparison_group"))  # events before legacy

    def in_arms(df: DataFrame, id15: Column, name: Column) -> DataFrame:
        rows = df.withColumn("_id15", id15).withColumn("adset_name", collapse_spaces(name)).drop("comparison_group")
        rows = rows.join(names, "adset_name", "left_semi")
        return rows.join(arms, F.col("_id15") == F.col("id15"))

    leads = "leads_standard" if "leads_standard" in adsets.columns else "leads"
    cost = in_arms(adsets, _c15("campaign_id"), F.col("adset_name")).groupBy("comparison_group").agg(
        F.sum(leads).alias("leads"), F.sum("spend").alias("spend")
    )
    sold = in_arms(matched.filter("converted"), u.id_suffix(F.col("campaign")), F.col("medium"))
    stats = lead_stats(sold, F.col("comparison_group"), settings=settings).drop("lead_rows")
    joined = cost.join(stats, "comparison_group", "left").fillna(0, ["conversions", "revenue", "revenue_adjusted"])
    return _group_ratios(joined)


def legacy_instances(legacy: DataFrame, events: DataFrame, matched: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Every instance of a shared adset in both arms with its conversions and ROAS.

    ``legacy`` has ``adset_name, campaign_name, campaign_id, spend, leads, in_events``;
    ``events`` the same without the flag.
    """
    wanted = ["adset_name", "campaign_name", "campaign_id", "spend", "leads"]
    clean = lambda df: df.withColumn("adset_name", collapse_spaces(F.col("adset_name")))
    shared = clean(legacy).filter("in_events > 0")
    ours = clean(events).join(shared.select("adset_name").distinct(), "adset_name", "left_semi")
    rows = shared.select(*wanted, F.lit(LEGACY).alias("comparison_group")).unionByName(
        ours.select(*wanted, F.lit(EVENTS).alias("comparison_group"))
    ).withColumn("campaign_id", _c15("campaign_id")).fillna(0, ["spend", "leads"])
    keyed = matched.withColumn("_lead_key", _pair(u.id_suffix(F.col("campaign")), collapse_spaces(F.col("medium"))))
    stats = lead_stats(keyed.filter("_lead_key IS NOT NULL"), F.col("_lead_key"), settings=settings)
    out = left_lookup(rows.withColumn("_key", _pair("campaign_id", "adset_name")),
                      stats.select("_lead_key", "conversions", "revenue"), "_key", "_lead_key").drop("_key")
    return out.fillna(0, ["conversions", "revenue"]).withColumn("roas", safe_ratio(F.col("revenue"), F.col("spend")))


def sorted_report(comparison: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """Comparison rows by falling ROAS, with display names of columns."""
    out = comparison.orderBy(F.desc("roas"), F.desc("spend"))
    return out.withColumnsRenamed(names) if names else out


def group_report(rows: DataFrame, group: str) -> DataFrame:
    """Report table per group: sums and ratios of sums."""
    sums = rows.groupBy(group).agg(*[
        F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("leads", "conversions", "spend", "revenue", "revenue_adjusted")
    ])
    return _group_ratios(sums)
