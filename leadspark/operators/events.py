"""Daily conversion events: score to decile, enrichment from captures, records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..functions import contact as ct
from ..functions import events as ev
from ..functions.dates import epoch_seconds
from ..functions.text import blank_to_null
from .deciles import assign_deciles
from .joins import flag_members, left_lookup

CAPTURE_FIELDS = ("event_id", "fbp", "fbc", "user_agent", "client_ip", "event_source_url")


def enrich_with_captures(leads: DataFrame, captures: DataFrame, now: int, time: str = "data", name: str = "name") -> DataFrame:
    """Leads with names, event id, browser ids and event time.

    ``captures`` holds one row per e-mail. Names come from the survey, else the capture's
    own first and last name, else its full name. A lead without capture gets an event id
    made of ``now`` and a hash of its e-mail; a missing decile is 1.
    """
    fields = [f for f in (*CAPTURE_FIELDS, "first_name", "last_name", "name") if f in captures.columns]
    table = captures.select("email", F.struct(*fields).alias("_c"))
    return with_capture_fields(left_lookup(leads, table, "email"), fields, now, time, name)


def with_capture_fields(df: DataFrame, fields: list[str], now: int, time: str = "data", name: str = "name") -> DataFrame:
    """The enrichment of rows whose capture is the struct ``_c`` (null where there is none) with ``fields``."""
    cap = lambda f: F.col(f"_c.{f}") if f in fields else F.lit(None).cast("string")
    full = blank_to_null(F.col(name)) if name in df.columns else F.lit(None).cast("string")
    own = blank_to_null(cap("first_name"))
    first = F.when(full.isNotNull(), ct.first_name(full)).when(own.isNotNull(), own).otherwise(ct.first_name(cap("name")))
    last = F.when(full.isNotNull(), ct.last_name(full)).when(own.isNotNull(), cap("last_name")).otherwise(ct.last_name(cap("name")))
    made = F.concat(F.lit(f"lead_{now}_"), F.substr(F.sha2("email", 256), F.lit(1), F.lit(16)))
    when = epoch_seconds(F.col(time), F.lit(now)) if time in df.columns else F.lit(now)
    out = df.withColumn("first_name", first).withColumn("last_name", last)
    for f in CAPTURE_FIELDS:
        out = out.withColumn(f, F.coalesce(cap(f), made) if f == "event_id" else cap(f))
    return out.withColumn("event_time", when).withColumn("decile", F.coalesce("decile", F.lit(1))).drop("_c")


def conversion_events(leads: DataFrame, survey: tuple[str, ...] = (), settings: Settings = DEFAULTS) -> DataFrame:
    """One qualified event per lead and one high-quality event for deciles 9 and 10.

    A lead is read once: its hashed identity is made once and its one or two records are
    unfolded in place.
    """
    leads = leads.withColumn("user_data", ev.user_struct(leads.columns))
    cols = leads.columns
    both = F.array_compact(F.array(
        ev.qualified_event(cols, survey, settings),
        F.when(F.col("decile") >= 9, ev.high_quality_event(cols, survey)),
    ))
    return leads.select("email", "decile", F.explode(both).alias("event"))


def purchase_events(buyers: DataFrame) -> DataFrame:
    return buyers.select("email", ev.purchase_event(buyers.columns).alias("event"))


def event_counts(events: DataFrame) -> DataFrame:
    return events.groupBy(F.col("event.event_name").alias("event_name")).agg(F.count("*").alias("events"))


def payload(events: DataFrame) -> DataFrame:
    return events.select("email", F.to_json("event").alias("payload"))


def already_sent(emails: DataFrame, sent: DataFrame) -> DataFrame:
    return emails.join(sent.select("email").distinct(), "email", "left_semi")


def not_sent(leads: DataFrame, sent: DataFrame) -> DataFrame:
    return leads.join(sent.select("email").distinct(), "email", "left_anti")


def sent_counts(emails: DataFrame, sent: DataFrame) -> DataFrame:
    """E-mails checked, already sent and not yet sent, one row."""
    return flag_members(emails.select("email").distinct(), sent, "email", "_s").agg(
        F.count("*").alias("checked"), F.count_if("_s").alias("sent"), F.count_if(~F.col("_s")).alias("not_sent")
    )


def daily_events(
    leads: DataFrame, captures: DataFrame, bands: list[tuple[int, float, float]], now: int,
    survey: tuple[str, ...] = (), settings: Settings = DEFAULTS,
) -> DataFrame:
    """Score to decile, capture enrichment, event records."""
    scored = assign_deciles(leads, bands)
    return conversion_events(enrich_with_captures(scored, captures, now), survey, settings)
