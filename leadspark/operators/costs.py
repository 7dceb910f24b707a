"""Ad costs: roll-ups, spend by level and period, and campaign look-ups.

Cost rows are ad level and flat: ``campaign_id, campaign_name, adset_id, adset_name,
ad_id, ad_name, spend`` with an optional ``day`` and budget columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..functions import utm as u
from ..functions.text import strip
from ..session import stored
from .fuzzy import best_matches
from .joins import left_lookup

LEVELS = ("campaign", "adset", "ad")


def roll_up(ads: DataFrame) -> DataFrame:
    """Spend and rows per campaign, adset and ad, with subtotals and the grand total."""
    return (
        ads.rollup("campaign_id", "adset_id", "ad_id")
        .agg(F.sum("spend").alias("spend"), F.count("*").alias("rows"),
             F.grouping_id().cast("long").alias("level"))
    )


def spend_by_level(ads: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Long table ``level, by, value, spend``: spend by id and by name on three levels.

    The six groupings come from one pass: each row is unfolded to its six keys, which the
    map-side aggregate folds again before the shuffle.
    """
    keys = [
        F.struct(F.lit(level).alias("level"), F.lit(by).alias("by"), F.col(f"{level}_{by}").cast("string").alias("value"))
        for level in LEVELS
        for by in ("id", "name")
        if f"{level}_{by}" in ads.columns
    ]
    long = ads.select(*extra, "spend", F.explode(F.array(*keys)).alias("key")).select(*extra, "spend", "key.*")
    return long.filter("value IS NOT NULL").groupBy(*extra, "level", "by", "value").agg(F.sum("spend").alias("spend"))


def trailing(df: DataFrame, column: str, as_of, days: tuple[int, ...] = (1, 3, 7)) -> DataFrame:
    """Repeat each row for every trailing window it falls in: ``[as_of - n days, as_of)``.

    Adds ``period_days``. Rows outside the longest window are filtered first, so the scan
    can prune them.
    """
    end = as_of if isinstance(as_of, Column) else F.lit(as_of).cast("date")
    at = F.col(column)
    start = lambda n: F.date_sub(end, n).cast("timestamp_ntz")
    inside = df.filter((at >= start(max(days))) & (at < end.cast("timestamp_ntz")))
    windows = F.array_compact(F.array(*[F.when(at >= start(n), F.lit(n)) for n in days]))
    return inside.withColumn("period_days", F.explode(windows))


def spend_periods(ads: DataFrame, as_of, days: tuple[int, ...] = (1, 3, 7), column: str = "day") -> DataFrame:
    return spend_by_level(trailing(ads, column, as_of, days), ("period_days",))


def hierarchy(ads: DataFrame, extra: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """Campaign, adset and ad tables with summed spend, one row per id (and ``extra``)."""
    own = lambda *names: [F.min(n).alias(n) for n in names if n in ads.columns]
    flags = own("has_campaign_budget", "has_adset_budget", "daily_budget", "lifetime_budget", "optimization_goal")
    total = F.sum("spend").alias("spend")
    return {
        "campaign": ads.groupBy(*extra, "campaign_id").agg(*own("campaign_name"), total, *flags),
        "adset": ads.groupBy(*extra, "campaign_id", "adset_id").agg(*own("campaign_name", "adset_name"), total, *flags),
        "ad": ads.groupBy(*extra, "campaign_id", "adset_id", "ad_id").agg(*own("adset_name", "ad_name"), total),
    }


def with_budget_flag(df: DataFrame, cents: bool = True) -> DataFrame:
    """Budgets in currency units and ``has_campaign_budget``: any daily or lifetime budget."""
    scale = 100.0 if cents else 1.0
    out = df
    for name in ("daily_budget", "lifetime_budget"):
        out = out.withColumn(name, F.col(name).cast("string").try_cast("double") / scale)
    has = F.coalesce(F.col("daily_budget") > 0, F.lit(False)) | F.coalesce(F.col("lifetime_budget") > 0, F.lit(False))
    return out.withColumn("has_campaign_budget", has)


def effective_goal(custom: Column, goal: Column) -> Column:
    """Promoted custom event, else the optimisation goal."""
    return F.coalesce(F.when(custom != "", custom), goal)


def report_hierarchy(campaigns: DataFrame, adsets: DataFrame, ads: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Campaign totals from report rows: spend, budget, creatives, goals, leads, events.

    The budget is the adsets' sum, or, where that is 0, the campaign's own. Campaigns in
    ``impute_lead_ids`` that report no leads take their qualified leads instead.
    """
    usable = adsets.filter("campaign_id IS NOT NULL AND campaign_id <> 'nan'")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0.0)).alias(c)
    events = [c for c in ("leads_standard", "lead_qualified", "lead_qualified_hq", "faixa_a") if c in adsets.columns]
    per = usable.groupBy("campaign_id").agg(
        F.min("campaign_name").alias("campaign_name"), F.min("_account_name").alias("account_id"),
        total("spend"), total("budget"), *[total(c) for c in events],
        F.array_join(F.array_sort(F.collect_set(F.coalesce("optimization_goal", F.lit("Lead")))), ", ").alias("optimization_goal"),
        F.count_distinct("adset_id").alias("num_adsets"),
    )
    creatives = ads.groupBy("campaign_id").agg(F.count("*").alias("num_creatives"))
    own = campaigns.groupBy("campaign_name").agg(F.max("budget").alias("own_budget"))
    out = left_lookup(left_lookup(per, creatives, "campaign_id"), own, "campaign_name")
    budget = F.when((F.col("budget") == 0) & (F.col("own_budget") > 0), F.col("own_budget")).otherwise(F.col("budget"))
    out = out.withColumn("budget", budget).drop("own_budget").fillna({"num_creatives": 0})
    if "leads_standard" in events:
        leads = F.col("leads_standard")
        if settings.impute_lead_ids and "lead_qualified" in events:
            special = F.col("campaign_id").isin(*settings.impute_lead_ids) & (leads == 0)
            leads = F.when(special, F.col("lead_qualified")).otherwise(leads)
        out = out.withColumn("leads", leads)
    return out


STEPS = ("id", "prefix", "name", "exact_name")


def _step_keys(step_keys: dict[str, Column]) -> Column:
    """Array of ``(step, key)`` for the steps whose key is known."""
    entries = [F.when(k.isNotNull(), F.struct(F.lit(s).alias("step"), k.alias("key"))) for s, k in step_keys.items()]
    return F.array_compact(F.array(*entries))


def _lookup_structs(df: DataFrame, costs: DataFrame, columns: tuple[str, ...], campaign: str, steps: tuple[str, ...]) -> DataFrame:
    """Add a struct of cost columns, ``_by_<step>``, for every look-up step.

    The name steps compare the campaign without its last ``|`` part when it carries an id.
    Where a prefix or a name repeats in ``costs`` the smallest id wins. All steps share one
    join of the distinct campaigns, unfolded to their keys, with the unfolded costs.
    """
    name = F.col("_campaign")
    found_id = u.campaign_id(name)
    clean = F.when(found_id.isNotNull(), strip(F.regexp_replace(name, r"\|[^|]*$", ""))).otherwise(strip(name))
    text_id, cost_name = F.col("campaign_id").cast("string"), strip(F.col("campaign_name"))
    first15 = lambda c: F.substr(c, F.lit(1), F.lit(15))
    asked = {"id": found_id, "prefix": first15(found_id), "name": F.lower(clean), "exact_name": clean}
    offered = {"id": text_id, "prefix": first15(text_id), "name": F.lower(cost_name), "exact_name": cost_name}
    pick = lambda keys: _step_keys({s: keys[s] for s in steps})
    names = df.select(F.col(campaign).alias("_campaign")).filter("_campaign IS NOT NULL").distinct()
    wanted = names.select("_campaign", F.explode(pick(asked)).alias("k")).select("_campaign", "k.step", "k.key")
    rows = costs.select("campaign_id", F.struct(*columns).alias("_info"), F.explode(pick(offered)).alias("k"))
    table = rows.groupBy("k.step", "k.key").agg(F.min_by("_info", "campaign_id").alias("_info"))
    hits = wanted.join(table, ["step", "key"]).groupBy("_campaign").agg(
        *[F.max(F.when(F.col("step") == s, F.col("_info"))).alias(f"_by_{s}") for s in steps]
    )
    return left_lookup(df, hits, campaign, "_campaign")


def lookup_campaign(
    df: DataFrame, costs: DataFrame, columns: tuple[str, ...], campaign: str = "campaign",
    steps: tuple[str, ...] = ("id", "prefix", "name"),
) -> DataFrame:
    """Cost columns of a campaign: by full id, by 15-digit prefix, by name (case ignored).

    ``costs`` has one row per ``campaign_id``. Adds ``matched_by``.
    """
    out = _lookup_structs(df, costs, columns, campaign, steps)
    hit = [F.col(f"_by_{s}") for s in steps]
    how = F.coalesce(*[F.when(h.isNotNull(), s) for h, s in zip(hit, steps)])
    found = {c: F.coalesce(*hit)[c] for c in columns}
    return out.withColumns({**found, "matched_by": how}).drop(*[f"_by_{s}" for s in steps])


# Which steps may find which cost column.
COLUMN_STEPS = {
    **dict.fromkeys(("spend",), ("id", "prefix", "name")),
    **dict.fromkeys(("leads", "lead_qualified", "lead_qualified_hq", "faixa_a"), ("id", "prefix")),
    **dict.fromkeys(("budget", "num_creatives", "account_id"), ("id", "exact_name")),
    **dict.fromkeys(("optimization_goal",), ("id", "prefix", "exact_name")),
}


def enrich_costs(df: DataFrame, costs: DataFrame) -> DataFrame:
    """All campaign look-ups in one pass: spend, leads and events by id, prefix or name;
    budget, creatives and account by id or exact name. Missing numbers are 0."""
    columns = tuple(c for c in COLUMN_STEPS if c in costs.columns)
    out = _lookup_structs(df, costs, columns, "campaign", STEPS)
    found = {c: F.coalesce(*[F.col(f"_by_{s}") for s in COLUMN_STEPS[c]])[c] for c in columns}
    out = out.withColumns(found).drop(*[f"_by_{s}" for s in STEPS])
    text = {c: "" for c in ("optimization_goal",) if c in columns}
    return out.fillna({**{c: 0 for c in columns if c not in ("account_id", "optimization_goal")}, **text})


def goals_by_campaign(adsets: DataFrame) -> DataFrame:
    """Sorted, comma-joined goals per campaign; the generic conversion goal reads ``Lead``."""
    goal = F.when(F.col("optimization_goal") == "OFFSITE_CONVERSIONS", "Lead").otherwise(F.col("optimization_goal"))
    named = F.collect_set(F.when(goal != "", goal))
    return adsets.groupBy("campaign_id").agg(
        F.when(F.size(named) == 0, "-").otherwise(F.array_join(F.array_sort(named), ", ")).alias("optimization_goal")
    )


def spend_of_values(values: DataFrame, ads: DataFrame, level: str, threshold: float = DEFAULTS.campaign_similarity) -> DataFrame:
    """Spend of UTM values on a level: by extracted id, by exact name, by similar name.

    ``values`` has a column ``value``. A value whose earlier steps gave 0 goes on to the
    next. Among similar names the most similar wins (ties: first in text order).
    The level's totals and the values are written once, however many steps look at them.
    """
    values = stored(values, "spend-values")
    own = [c for c in ads.columns if c in (f"{level}_id", f"{level}_name", "spend")]
    totals = stored(spend_by_level(ads.select(*own)), "spend-totals")
    by = lambda how, to: totals.filter(F.col("by") == how).select(F.col("value").alias("_k"), F.col("spend").alias(to))
    out = values.withColumn("_id", u.utm_id(F.col("value")))
    out = left_lookup(left_lookup(out, by("id", "_by_id"), "_id", "_k"), by("name", "_by_name"), "value", "_k")
    paid = lambda c: F.when(F.col(c) > 0, F.col(c))
    solved = F.coalesce(paid("_by_id"), paid("_by_name"))
    out = out.withColumn("_solved", solved)
    names = by("name", "spend").withColumn("_folded", F.lower(strip(F.col("_k"))))
    rest = out.filter("_solved IS NULL").select(u.comparable_name(F.col("value")).alias("_utm")).filter("_utm IS NOT NULL")
    pairs = best_matches(rest, names, "_utm", "_folded", threshold, names_first=True)
    best = (
        pairs.join(names, F.col("name") == F.col("_folded"))
        .groupBy(F.col("value").alias("_utm"))
        .agg(F.min_by("spend", F.struct(-F.col("ratio"), F.col("_k"))).alias("_similar"))
    )
    out = left_lookup(out.withColumn("_utm_key", u.comparable_name(F.col("value"))), best, "_utm_key", "_utm")
    how = (
        F.when(paid("_by_id").isNotNull(), "id").when(paid("_by_name").isNotNull(), "name")
        .when(paid("_similar").isNotNull(), "similar")
    )
    return (
        out.withColumn("spend", F.coalesce("_solved", "_similar", F.lit(0.0))).withColumn("matched_by", how)
        .drop("_id", "_by_id", "_by_name", "_solved", "_similar", "_utm_key")
    )


def spend_of_campaign_values(values: DataFrame, ads: DataFrame, threshold: float = DEFAULTS.adset_similarity) -> DataFrame:
    """Spend of full campaign UTM values: the adset named inside it (exact, else the most
    similar in that campaign), else the whole campaign.

    The values and both tables of spend are written once, however many steps look at them."""
    values = stored(values, "spend-values")
    tables = {level: stored(df, f"spend-{level}") for level, df in hierarchy(ads).items() if level != "ad"}
    campaigns = tables["campaign"].select(
        F.col("campaign_id").cast("string").alias("_k"),
        F.struct("spend", *[c for c in ("has_campaign_budget",) if c in tables["campaign"].columns]).alias("_campaign"),
    )
    adsets = (
        tables["adset"].select(F.col("campaign_id").cast("string").alias("_campaign_id"),
                               F.lower("adset_name").alias("_adset"), F.col("adset_id").alias("_order"), "spend")
        .groupBy("_campaign_id", "_adset").agg(F.min_by("spend", "_order").alias("spend"))
    )
    text = F.col("value").cast("string")
    out = values.withColumn("_campaign_id", u.utm_id(text)).withColumn("_adset", F.lower(u.adset_from_campaign(text)))
    pair = lambda c, a: F.when(F.col(c).isNotNull() & F.col(a).isNotNull(), F.concat_ws("\u0001", c, a))
    out = left_lookup(out, campaigns, "_campaign_id", "_k").withColumn("_pair", pair("_campaign_id", "_adset"))
    equal = adsets.select(pair("_campaign_id", "_adset").alias("_k"), F.col("spend").alias("_equal"))
    out = left_lookup(out, equal, "_pair", "_k")
    rest = out.filter("_campaign IS NOT NULL AND _equal IS NULL").select("_campaign_id", "_adset")
    pairs = best_matches(rest, adsets, "_adset", "_adset", threshold, within="_campaign_id")
    best = (
        pairs.withColumn("_k", pair("_campaign_id", "name")).join(equal, "_k")
        .groupBy(pair("_campaign_id", "value").alias("_sk"))
        .agg(F.min_by("_equal", F.struct(-F.col("ratio"), F.col("name"))).alias("_similar"))
    )
    out = left_lookup(out, best, "_pair", "_sk").withColumn("_adset_spend", F.coalesce("_equal", "_similar"))
    budget = (
        F.coalesce(F.col("_campaign.has_campaign_budget"), F.lit(True))
        if "has_campaign_budget" in ads.columns else F.lit(True)
    )
    return (
        out.withColumn("spend", F.coalesce("_adset_spend", "_campaign.spend", F.lit(0.0)))
        .withColumn("has_campaign_budget", budget)
        .withColumn("matched_by", F.when(F.col("_adset_spend").isNotNull(), "adset").when(F.col("_campaign").isNotNull(), "campaign"))
        .drop("_campaign_id", "_adset", "_campaign", "_pair", "_equal", "_similar", "_adset_spend")
    )


def spend_of_ad_values(
    values: DataFrame, ads: DataFrame, threshold: float = DEFAULTS.ad_similarity, extra: tuple[str, ...] = ()
) -> DataFrame:
    """Spend of ad values: ad id, else equal name (case ignored), else the most similar name.

    A name borne by several ads takes the spend of the first by campaign, adset and ad id.
    With ``extra`` (such as a period) both sides are matched within it. The values and the spend
    of each ad are written once, however many steps look at them.
    """
    values = stored(values, "spend-values")
    per_ad = stored(hierarchy(ads, extra)["ad"], "spend-ad")
    order = F.struct("campaign_id", "adset_id", "ad_id")
    tag = lambda c: F.concat_ws("\u0001", *extra, c)
    ids = per_ad.groupBy(tag(F.col("ad_id").cast("string")).alias("_k")).agg(F.min_by("spend", order).alias("_by_id"))
    names = per_ad.filter("ad_name IS NOT NULL").groupBy(*extra, F.lower("ad_name").alias("_name")).agg(
        F.min_by("spend", order).alias("_spend")
    )
    names = stored(names, "spend-names")
    by_name = names.select(tag("_name").alias("_k"), F.col("_spend").alias("_by_name"))
    key = lambda c: F.when(c.isNotNull(), tag(c))
    out = values.withColumn("_name", F.lower(F.col("value").cast("string")))
    out = out.withColumn("_id", key(u.utm_id(F.col("value").cast("string")))).withColumn("_named", key(F.col("_name")))
    out = left_lookup(left_lookup(out, ids, "_id", "_k"), by_name, "_named", "_k")
    out = out.withColumn("_solved", F.coalesce("_by_id", "_by_name"))
    if threshold >= 1:  # equal names are found already
        how = F.when(F.col("_by_id").isNotNull(), "id").when(F.col("_by_name").isNotNull(), "name")
        out = out.withColumn("spend", F.coalesce("_solved", F.lit(0.0))).withColumn("matched_by", how)
        return out.drop("_name", "_id", "_named", "_by_id", "_by_name", "_solved")
    rest = out.filter("_solved IS NULL")
    within = None if not extra else "_within"
    scope = (lambda d: d) if not extra else (lambda d: d.withColumn("_within", F.concat_ws("\u0001", *extra)))
    pairs = best_matches(scope(rest), scope(names), "_name", "_name", threshold, within)
    pair_key = (lambda c: F.col(c)) if not extra else (lambda c: F.concat_ws("\u0001", F.col("_within"), F.col(c)))
    best = (
        pairs.withColumn("_k", pair_key("name")).join(by_name, "_k")
        .groupBy(pair_key("value").alias("_named")).agg(
            F.min_by("_by_name", F.struct(-F.col("ratio"), F.col("name"))).alias("_similar"))
        .withColumnRenamed("_named", "_sk")
    )
    out = left_lookup(out, best, "_named", "_sk")
    how = F.when(F.col("_by_id").isNotNull(), "id").when(F.col("_by_name").isNotNull(), "name").when(
        F.col("_similar").isNotNull(), "similar")
    return (
        out.withColumn("spend", F.coalesce("_solved", "_similar", F.lit(0.0))).withColumn("matched_by", how)
        .drop("_name", "_id", "_named", "_by_id", "_by_name", "_solved", "_similar")
    )


def same_campaign(name: Column, utm: Column, ratio: Column, threshold: float = DEFAULTS.campaign_similarity) -> Column:
    """Whether a cost name and a UTM campaign are the same: equal when folded, or similar."""
    equal = F.lower(strip(name)) == u.comparable_name(utm)
    return F.coalesce(equal | (ratio >= threshold), F.lit(False))
