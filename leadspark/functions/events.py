"""Conversion-event records (built here, sent elsewhere) and event-log lines."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from .contact import gender_code, hashed, phone_state
from .deciles import decile_label
from .economics import rate_of
from .text import blank_to_null


def _col(columns: Iterable[str], name: str) -> Column:
    return F.col(name).cast("string") if name in columns else F.lit(None).cast("string")


def user_struct(columns: Iterable[str]) -> Column:
    """Hashed identity plus plain context fields; columns the frame lacks become null."""
    c = lambda name: _col(columns, name)
    country = F.when(blank_to_null(c("phone")).isNotNull(), "br")
    return F.struct(
        hashed(c("email")).alias("em"),
        hashed(c("phone")).alias("ph"),
        hashed(c("first_name")).alias("fn"),
        hashed(c("last_name")).alias("ln"),
        hashed(phone_state(c("phone"))).alias("st"),
        hashed(c("cidade")).alias("ct"),
        hashed(country).alias("country"),
        hashed(c("cep")).alias("zp"),
        gender_code(c("genero")).alias("ge"),
        c("client_ip").alias("client_ip_address"),
        c("user_agent").alias("client_user_agent"),
        c("fbp").alias("fbp"),
        c("fbc").alias("fbc"),
    )


def _properties(own: dict[str, Column], survey: dict[str, Column]) -> Column:
    """Text map of the model's values and the survey answers that are not blank."""
    pairs = {**own, **{k: blank_to_null(v.cast("string")) for k, v in survey.items()}}
    entries = F.array(*[F.struct(F.lit(k), v.cast("string")) for k, v in pairs.items()])
    return F.map_from_entries(F.filter(entries, lambda e: e["col2"].isNotNull()))


def _record(columns, name: str, prefix: str, custom: Column) -> Column:
    return F.struct(
        F.lit(name).alias("event_name"),
        F.col("event_time").cast("long").alias("event_time"),
        F.concat(F.lit(prefix), F.col("event_id").cast("string")).alias("event_id"),
        F.lit("website").alias("action_source"),
        _col(columns, "event_source_url").alias("event_source_url"),
        (F.col("user_data") if "user_data" in columns else user_struct(columns)).alias("user_data"),
        custom.alias("custom_data"),
    )


def qualified_event(
    columns, survey: tuple[str, ...] = (), settings: Settings = DEFAULTS
) -> Column:
    """Qualified-lead event carrying the projected value of the lead's decile."""
    rate = rate_of(F.col("decile"), settings.rates)
    own = {
        "lead_score": F.col("lead_score"),
        "decil": decile_label(F.col("decile")),
        "taxa_conversao": rate,
    }
    custom = F.struct(
        (F.lit(settings.product_value) * rate).alias("value"),
        F.lit("BRL").alias("currency"),
        _properties(own, {s: F.col(s) for s in survey}).alias("custom_properties"),
    )
    return _record(columns, "LeadQualified", "qualified_", custom)


def high_quality_event(columns, survey: tuple[str, ...] = ()) -> Column:
    """High-quality event without a value; meant for deciles 9 and 10."""
    own = {
        "lead_score": F.col("lead_score"),
        "decil": decile_label(F.col("decile")),
        "estrategia": F.lit("high_quality_only"),
    }
    custom = F.struct(
        F.lit(None).cast("double").alias("value"),
        F.lit("BRL").alias("currency"),
        _properties(own, {s: F.col(s) for s in survey}).alias("custom_properties"),
    )
    return _record(columns, "LeadQualifiedHighQuality", "hq_", custom)


def purchase_event(columns) -> Column:
    custom = F.struct(
        F.col("sale_value").cast("double").alias("value"),
        F.lit("BRL").alias("currency"),
        F.create_map(F.lit("original_event_id"), F.col("event_id").cast("string")).alias(
            "custom_properties"
        ),
    )
    return _record(columns, "Purchase", "purchase_", custom)


# Events named in a log line, the longer name first.
LOGGED_EVENTS = ("LeadQualifiedHighQuality", "LeadQualified", "Faixa A")


def log_email(line: Column) -> Column:
    """E-mail of a ``... enviado: a@b.c (decil: ...)`` log line."""
    found = F.regexp_extract(line, r"enviado:\s*(\S+@\S+)\s*\(", 1)
    return F.when(found != "", F.lower(found))


def log_event(line: Column) -> Column:
    return F.coalesce(*[F.when(line.contains(f"{e} enviado:"), e) for e in LOGGED_EVENTS])
