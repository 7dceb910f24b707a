"""Survey leads, captured leads, their combination and look-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import utm as u
from ..functions.contact import email_key, phone_key
from ..functions.dates import in_closed_days, parse_timestamp
from ..functions.deciles import by_thresholds, decile_number, score_in_range
from ..functions.text import decimal_comma
from ..operators.joins import first_per_key
from ..operators.profile import fill_rate
from ..schemas import CAPTURES, LEADS, conform

REQUIRED = ("E-mail", "Campaign")
UTM = {"Source": "source", "Medium": "medium", "Term": "term", "Content": "content"}


def _text(df: DataFrame, name: str) -> Column:
    return F.col(f"`{name}`").cast("string") if name in df.columns else F.lit(None).cast("string")


def survey_leads(raw: DataFrame, bands: list[tuple[int, float, float]] | None = None) -> DataFrame:
    """Survey rows to leads. Rows without a usable e-mail are dropped.

    The date is read per value (day first or ISO). The decile comes from the score when the
    table has scores, else from its class column. ``{{...}}`` campaigns and mediums are null.
    """
    missing = [c for c in REQUIRED if c not in raw.columns]
    dated = next((c for c in ("Data", "Data do Envio") if c in raw.columns), None)
    if missing or dated is None:
        raise ValueError(f"missing columns: {missing + ([] if dated else ['Data'])}")
    score = decimal_comma(_text(raw, "lead_score"))
    if "lead_score" in raw.columns and bands:
        decile = by_thresholds(score_in_range(score), bands)
    else:
        decile = decile_number(_text(raw, "Faixa" if "Faixa" in raw.columns else "decil"))
    out = raw.select(
        email_key(_text(raw, "E-mail")).alias("email"), _text(raw, "Nome Completo").alias("name"),
        phone_key(_text(raw, "Telefone")).alias("phone"), parse_timestamp(_text(raw, dated)).alias("captured_at"),
        u.null_templates(_text(raw, "Campaign")).alias("campaign"), _text(raw, "Source").alias("source"),
        u.null_templates(_text(raw, "Medium")).alias("medium"), _text(raw, "Term").alias("term"),
        _text(raw, "Content").alias("content"), score.alias("lead_score"), decile.alias("decile"),
        *([F.col("lead_id").cast("string").alias("lead_id")] if "lead_id" in raw.columns else []),
    )
    return conform(out, LEADS).filter("email IS NOT NULL")


def scorable(df: DataFrame, name: str = "Nome Completo", email: str = "E-mail") -> DataFrame:
    """Leads whose name and e-mail are present and not blank."""
    return df.filter((F.trim(F.col(f"`{name}`")) != "") & (F.trim(F.col(f"`{email}`")) != ""))


def valid_scores(df: DataFrame, column: str = "lead_score") -> tuple[DataFrame, DataFrame]:
    """Leads with a score in (0, 1], and one row of valid and invalid counts."""
    score = decimal_comma(F.col(column))
    ok = F.coalesce((score > 0) & (score <= 1), F.lit(False))
    counts = df.agg(F.count_if(ok).alias("valid"), F.count_if(~ok).alias("invalid"))
    return df.filter(ok).withColumn(column, score), counts


def captured_leads(raw: DataFrame) -> DataFrame:
    """Captured web leads under the common lead names, with ``campaign_id_meta``."""
    c = conform(raw, CAPTURES)
    return c.select(
        F.col("id").cast("string").alias("lead_id"), email_key(F.col("email")).alias("email"), "name",
        phone_key(F.col("phone")).alias("phone"), F.col("created_at").alias("captured_at"),
        F.col("utm_campaign").alias("campaign"), F.col("utm_source").alias("source"), F.col("utm_medium").alias("medium"),
        F.col("utm_term").alias("term"), F.col("utm_content").alias("content"),
        u.captured_ad_id(F.col("utm_campaign")).alias("campaign_id_meta"),
    ).filter("email IS NOT NULL")


def captures_of(captures: DataFrame, emails: DataFrame, start: str, end: str, time: str = "created_at") -> DataFrame:
    """Captures in a closed period of the given e-mails."""
    return captures.filter(in_closed_days(F.col(time), start, end)).join(emails.select("email").distinct(), "email", "left_semi")


def combined_leads(survey: DataFrame, captures: DataFrame, start: str, end: str) -> DataFrame:
    """Survey leads of the period plus captured leads that carry an ad id and whose e-mail
    is not among them. ``source_type`` tells them apart."""
    in_period = in_closed_days(F.col("captured_at"), start, end)
    order = [F.col(c).isNull() for c in ("campaign",)] + [F.xxhash64(*survey.columns)]
    own = first_per_key(survey.filter(in_period), ["email", "captured_at"], order).withColumn("source_type", F.lit("survey"))
    extra = (
        captures.filter(in_period & F.col("campaign_id_meta").isNotNull())
        .join(own.select("email").distinct(), "email", "left_anti").withColumn("source_type", F.lit("capi"))
    )
    return own.unionByName(extra, allowMissingColumns=True)


def source_counts(survey: DataFrame, captures: DataFrame, combined: DataFrame, start: str, end: str) -> DataFrame:
    """Survey leads, captured persons with an ad id, and captured extras, one row."""
    in_period = in_closed_days(F.col("captured_at"), start, end)
    persons = captures.filter(in_period & F.col("campaign_id_meta").isNotNull()).agg(
        F.count_distinct("email").alias("capi_leads_total"))
    kinds = combined.agg(
        F.count_if(F.col("source_type") == "survey").alias("survey_leads"),
        F.count_if(F.col("source_type") == "capi").alias("capi_leads_extras"),
    )
    return kinds.crossJoin(persons)  # one row each


def latest_by_email(captures: DataFrame, time: str = "created_at", tie: str = "id") -> DataFrame:
    newest = F.max_by(F.struct(*[c for c in captures.columns if c != "email"]), F.struct(time, tie))
    return captures.groupBy("email").agg(newest.alias("r")).select("email", "r.*").select(*captures.columns)


def by_event_id(captures: DataFrame, event_id: str) -> DataFrame:
    return captures.filter(F.col("event_id") == event_id)


def by_emails(captures: DataFrame, emails: DataFrame) -> DataFrame:
    return captures.join(emails.select("email").distinct(), "email", "left_semi")


def most_recent(captures: DataFrame, n: int, start: str | None = None, end: str | None = None, time: str = "created_at", tie: str = "id") -> DataFrame:
    """The newest ``n`` captures, optionally of a period."""
    df = captures
    if start:
        df = df.filter(F.col(time) >= F.lit(start).cast("date"))
    if end:
        df = df.filter(F.col(time) < F.date_add(F.lit(end).cast("date"), 1))
    return df.orderBy(F.desc(time), F.desc(tie)).limit(n)


def last_seven_days(captures: DataFrame, as_of: str, time: str = "created_at") -> DataFrame:
    return captures.filter(F.col(time) >= F.date_sub(F.lit(as_of).cast("date"), 7))


def utm_fill(captures: DataFrame, columns=("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content")) -> DataFrame:
    """Rows and fill rate of UTM fields in percent, one row."""
    return captures.agg(F.count("*").alias("leads"), *[fill_rate(F.col(c)).alias(f"{c}_pct") for c in columns])


def best_captures(captures: DataFrame, tie: str = "id") -> DataFrame:
    """One capture per e-mail: the first with a first name, else the first."""
    named = F.coalesce(F.col("first_name") != "", F.lit(False))
    return first_per_key(captures, ["email"], [~named, F.col(tie)])


def email_campaign_ids(captures: DataFrame, campaign: str = "utm_campaign", time: str = "created_at", tie: str = "id") -> DataFrame:
    """Latest campaign id (18+ digits in the campaign text) per e-mail."""
    found = F.regexp_extract(campaign, "([0-9]{18,})", 1)
    return (
        captures.withColumn("_id", F.when(found != "", found)).filter("_id IS NOT NULL AND email IS NOT NULL")
        .groupBy(F.lower("email").alias("email")).agg(F.max_by("_id", F.struct(time, tie)).alias("campaign_id"))
    )


def without_ids(df: DataFrame, ids: DataFrame, column: str = "id") -> DataFrame:
    """Rows whose id is not listed."""
    return df.join(ids.select(column), column, "left_anti")
