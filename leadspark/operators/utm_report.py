"""UTM economics: leads per UTM value, window and decile, joined to costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..functions import economics as eco
from ..functions import utm as u
from ..session import stored
from . import costs as cost
from .deciles import decile_shares, share_columns
from .joins import left_lookup


def decile_distribution(leads: DataFrame, value: Column, extra: tuple[str, ...] = (), keep: tuple[Column, ...] = ()) -> DataFrame:
    """Leads and percent in each decile per UTM value, in a single aggregate."""
    return leads.groupBy(*extra, value.alias("value")).agg(F.count("lead_score").alias("leads"), *decile_shares(), *keep)


def add_economics(
    df: DataFrame, dimension: str, has_budget: Column | None = None, days: Column | None = None,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """Cost per lead, projections, recommended action and target budget."""
    days = F.col("period_days") if days is None else days
    has_budget = F.lit(True) if has_budget is None else has_budget
    spend, leads = F.col("spend"), F.col("leads")
    out = df.withColumn("cpl", eco.cpl(spend, leads))
    out = out.withColumn("projected_rate", eco.projected_rate(share_columns(), settings))
    out = out.withColumn("projected_revenue", eco.projected_revenue(F.col("projected_rate"), leads, settings))
    out = out.withColumn("margin", F.col("projected_revenue") - spend)
    out = out.withColumn("projected_roas", eco.projected_roas(F.col("projected_rate"), F.col("cpl"), settings))
    roas, margin = F.col("projected_roas"), F.col("margin")
    out = out.withColumn("action", eco.action(dimension, has_budget, leads, days, spend, margin, roas, settings))
    target = eco.target_budget(dimension, F.col("action"), margin, spend, roas, leads, days, settings)
    return out.withColumn("budget_current", spend).withColumn("budget_target", target)


def _period_key(column: str) -> Column:
    return F.when(F.col(column).isNotNull(), F.concat_ws("\u0001", "period_days", F.col(column).cast("string")))


def _join_period(df: DataFrame, table: DataFrame, column: str, table_column: str) -> DataFrame:
    """Left join on (period, column) through one text key."""
    keyed = table.withColumn("_pk", _period_key(table_column)).drop("period_days", table_column)
    return left_lookup(df.withColumn("_pkey", _period_key(column)), keyed, "_pkey", "_pk").drop("_pkey")


def campaign_report(leads: DataFrame, ads: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Campaign dimension; both inputs carry ``period_days``."""
    valid = leads.filter(u.valid_utm(F.col("campaign"), settings.bare_campaigns))
    valid = valid.withColumn("_id", u.utm_id(F.col("campaign"))).filter("_id IS NOT NULL")
    grouped = decile_distribution(valid, F.col("_id"), ("period_days",))
    table = cost.hierarchy(ads, ("period_days",))["campaign"]
    flag = "has_campaign_budget"
    kept = ["period_days", "campaign_id", "campaign_name", "spend"] + [c for c in (flag,) if c in table.columns]
    out = _join_period(grouped, table.select(*kept), "value", "campaign_id").filter("spend > 0")
    has = F.coalesce(F.col(flag), F.lit(True)) if flag in out.columns else None
    out = out.withColumn("value", F.coalesce("campaign_name", "value")).drop("campaign_name")
    return add_economics(out, "campaign", has, settings=settings)


def adset_of_leads(leads: DataFrame, ads: DataFrame) -> DataFrame:
    """Adset id of a lead from its (campaign id, adset name); unmatched leads are dropped."""
    adsets = ads.filter("adset_name IS NOT NULL").groupBy(
        F.concat_ws("\u0001", F.col("campaign_id").cast("string"), "adset_name").alias("_k")
    ).agg(F.min(F.col("adset_id").cast("string")).alias("adset_id"), F.min("campaign_name").alias("campaign_name"))
    keyed = leads.withColumn("_c", u.utm_id(F.col("campaign"))).withColumn(
        "_key", F.when(F.col("_c").isNotNull() & F.col("medium").isNotNull(), F.concat_ws("\u0001", "_c", "medium"))
    )
    return left_lookup(keyed, adsets, "_key", "_k").drop("_c", "_key").filter("adset_id IS NOT NULL")


def adset_report(leads: DataFrame, ads: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    valid = leads.filter(u.valid_utm(F.col("medium"), settings.bare_mediums))
    found = adset_of_leads(valid, ads)
    grouped = decile_distribution(found, F.col("adset_id"), ("period_days",), (F.min("campaign_name").alias("campaign_name"),))
    table = cost.hierarchy(ads.drop("campaign_name"), ("period_days",))["adset"].drop("campaign_id")
    flag = "has_adset_budget"
    kept = ["period_days", "adset_id", "adset_name", "spend"] + [c for c in (flag,) if c in table.columns]
    out = _join_period(grouped, table.select(*kept), "value", "adset_id").filter("spend > 0")
    has = F.coalesce(F.col(flag), F.lit(True)) if flag in out.columns else None
    out = out.withColumn("value", F.coalesce("adset_name", "value")).drop("adset_name")
    return add_economics(out, "medium", has, settings=settings)


def repair_generic_adsets(leads: DataFrame, ads: DataFrame) -> DataFrame:
    """Adset name of a lead; a platform word in its place is replaced by the adset of the
    first ad of that name, and the lead is dropped when there is none."""
    order = F.struct("campaign_id", "adset_id", "ad_id")
    table = ads.filter("ad_name IS NOT NULL").groupBy(F.lower("ad_name").alias("_k")).agg(
        F.min_by("adset_name", order).alias("_found")
    )
    generic = F.lower("medium").isin(*u.GENERIC_ADSETS)
    keyed = leads.withColumn("_ad", F.when(generic & (F.trim("content") != ""), F.lower("content")))
    out = left_lookup(keyed, table, "_ad", "_k")
    name = F.when(generic, F.col("_found")).otherwise(F.col("medium"))
    return out.withColumn("adset_name", name).drop("_ad", "_found").filter("adset_name IS NOT NULL")


def ad_report(leads: DataFrame, ads: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    valid = leads.filter(u.valid_utm(F.col("content")))
    # read three times: for campaign names, first ads and spend
    ads = stored(ads.select("period_days", *(f"{level}_{by}" for level in cost.LEVELS for by in ("id", "name")), "spend"), "report-ads")
    names = ads.groupBy(F.col("campaign_id").cast("string").alias("_k")).agg(F.min("campaign_name").alias("campaign_name"))
    named = left_lookup(valid.withColumn("_id", u.utm_id(F.col("campaign"))), names, "_id", "_k").drop("_id")
    named = named.withColumn("campaign_name", F.coalesce("campaign_name", u.campaign_label(F.col("campaign"))))
    repaired = repair_generic_adsets(named, ads)
    grouped = decile_distribution(
        repaired, F.col("content"), ("period_days",),
        (F.min("campaign_name").alias("campaign_name"), F.min("adset_name").alias("adset_name")),
    )
    out = cost.spend_of_ad_values(grouped, ads, settings.ad_similarity, ("period_days",)).filter("spend > 0")
    return add_economics(out.drop("matched_by"), "ad", settings=settings)


def keyword_report(leads: DataFrame, settings: Settings = DEFAULTS, source: str = "google-ads") -> DataFrame:
    """Search keywords; their platform reports no cost here, so spend is 0."""
    words = leads.filter(F.col("source") == source).withColumn("_word", u.keyword(F.col("term")))
    grouped = decile_distribution(words.filter("_word IS NOT NULL"), F.col("_word"), ("period_days",))
    return add_economics(grouped.withColumn("spend", F.lit(0.0)), "google_ads", settings=settings)


DIMENSIONS = {"campaign": "campaign", "medium": "medium", "ad": "content", "google_ads": "source"}


def utm_economics(
    leads: DataFrame, ads: DataFrame, as_of, days: tuple[int, ...] = (1, 3, 7), settings: Settings = DEFAULTS,
    dimensions: tuple[str, ...] = tuple(DIMENSIONS),
) -> dict[str, DataFrame]:
    """The dimensions (those whose column is there) over all trailing windows. ``leads``
    need ``decile`` and UTM columns, ``ads`` a ``day``."""
    timed = cost.trailing(leads, "captured_at", as_of, days)
    paid = cost.trailing(ads, "day", as_of, days)
    reports = {
        "campaign": lambda: campaign_report(timed, paid, settings), "medium": lambda: adset_report(timed, paid, settings),
        "ad": lambda: ad_report(timed, paid, settings), "google_ads": lambda: keyword_report(timed, settings),
    }
    return {d: reports[d]() for d in dimensions if DIMENSIONS[d] in leads.columns}


def window_totals(leads: DataFrame) -> DataFrame:
    """First and last capture and leads per source in each window."""
    source = F.col("source") if "source" in leads.columns else F.lit("facebook-ads")
    return leads.groupBy("period_days").agg(
        F.min("captured_at").alias("first_lead"), F.max("captured_at").alias("last_lead"),
        F.count("*").alias("total_leads"),
        F.count_if(source == "facebook-ads").alias("meta_leads"),
        F.count_if(source == "google-ads").alias("google_leads"),
    )
