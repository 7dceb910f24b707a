"""Event counts from nested action rows that arrive as JSON text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import left_lookup

#: The action types that count.
LEAD, CUSTOM = "lead", "offsite_conversion.fb_pixel_custom"
_ACTIONS = "array<struct<action_type: string, value: string>>"


def shredded(insights: DataFrame, payload: str = "payload") -> DataFrame:
    """``campaign_id, adset_id, action_type, value``: one row for each action of each insight.

    The text is parsed once, as a variant; ids and actions are taken from it by path. Null and
    malformed texts, insights without actions and actions without a readable number give no
    row; ids of any scalar type are text.
    """
    parsed = insights.select(F.try_parse_json(payload).alias("v")).filter("v IS NOT NULL")
    at = lambda path, kind: F.try_variant_get("v", path, kind)
    rows = parsed.select(
        at("$.campaign_id", "string").alias("campaign_id"), at("$.adset_id", "string").alias("adset_id"),
        F.explode(at("$.actions", _ACTIONS)).alias("a"),
    )
    return rows.select("campaign_id", "adset_id", "a.action_type", F.col("a.value").try_cast("bigint").alias("value")).filter("campaign_id IS NOT NULL AND value IS NOT NULL")


def unreadable(insights: DataFrame, payload: str = "payload") -> DataFrame:
    """One row: insights, those without text, and those whose text is no JSON."""
    text = F.col(payload)
    return insights.agg(
        F.count("*").alias("insights"), F.count_if(text.isNull()).alias("missing"),
        F.count_if(text.isNotNull() & F.try_parse_json(text).isNull()).alias("malformed"),
    )


def campaign_events(actions: DataFrame, adsets: DataFrame, names: DataFrame) -> DataFrame:
    """``campaign_id, event, n``: of each campaign with an action, every event of ``names (event)``.

    A plain lead counts as ``lead``; a generic custom conversion counts as the event that its
    adset promotes (``adsets``: ``adset_id, custom_event``). Events outside ``names`` do not count; a
    campaign without an event has 0. Counts fold map-side before the names are joined.
    """
    folded = actions.groupBy("campaign_id", "adset_id", "action_type").agg(F.sum("value").alias("n"))
    promoted = adsets.groupBy("adset_id").agg(F.min("custom_event").alias("custom_event"))
    event = F.when(F.col("action_type") == LEAD, LEAD).when(F.col("action_type") == CUSTOM, F.col("custom_event"))
    named = left_lookup(folded, promoted, "adset_id").withColumn("event", event)
    counted = named.filter("event IS NOT NULL").groupBy("campaign_id", "event").agg(F.sum("n").alias("n"))
    wanted = names.select("event").distinct()
    # the names are one row: an array of the few events that were asked for
    listed = wanted.agg(F.collect_set("event").alias("events"))
    full = folded.select("campaign_id").distinct().crossJoin(listed).select("campaign_id", F.explode("events").alias("event"))  # one row
    return full.join(counted, ["campaign_id", "event"], "left").select("campaign_id", "event", F.coalesce("n", F.lit(0)).alias("n"))


def counter(events: DataFrame, campaigns: DataFrame, event: str) -> DataFrame:
    """``campaigns (campaign_id, ...)`` with the count of one event; 0 for an unknown campaign or event."""
    one = events.filter(F.col("event") == event).select("campaign_id", F.col("n").alias("events"))
    return left_lookup(campaigns, one, "campaign_id").withColumn("events", F.coalesce("events", F.lit(0)))
