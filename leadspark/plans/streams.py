"""Queries: streams with keyed state and joins of two streams, each fed in several batches."""

from __future__ import annotations

import math
import uuid

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CORRECTED_RATES, DECILES
from ..session import checkpoint_dir, remove, stored
from ..streaming import keyed
from .bindings import sql
from .registry import query

#: Batches that the streams are fed in, and rows of a file, of which a batch has two or more.
FEEDS, FILE_ROWS = 5, 250_000


def _folder(spark) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"


def _feed(rows: DataFrame, path: str, arrival, edges: list, last: DataFrame | None = None) -> DataFrame:
    """Rows written in ranges of their arrival, one after another, and read as a stream of so many batches.

    A range's files hold whole e-mails, so a batch may end within a range. ``rows`` is read
    for each range, so it should be a written table; a range has as many files as its rows need.
    """
    spark = rows.sparkSession
    files = max(2, math.ceil(rows.count() / FEEDS / FILE_ROWS))
    for k, (low, high) in enumerate(zip([None, *edges], [*edges, None], strict=True)):
        part = rows if low is None else rows.filter(arrival >= low)
        part = part if high is None else part.filter(arrival < high)
        part.repartition(files, "email").write.parquet(f"{path}/feed={k}")
    if last is not None:
        last.coalesce(1).write.parquet(f"{path}/feed={len(edges) + 1}")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path)
    return stream.select(*rows.columns)


def _edges(rows: DataFrame, arrival) -> list:
    """Times that cut the rows' span into ``FEEDS`` equal parts."""
    one = rows.agg(F.min(arrival).alias("a"), F.max(arrival).alias("b")).first()
    return [one.a + (one.b - one.a) * k / FEEDS for k in range(1, FEEDS)]


def _result(spark, folder: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{folder}/out").drop("batch_id")


@query(
    "stream_send_once_keyed",
    """WITH c AS (SELECT concat('user', user_id, '@mail.com') AS email, concat('ev', event_id) AS event_id, event_id AS id, ts FROM events)
SELECT email, arg_min(event_id, (ts, event_id)) AS event_id FROM c
WHERE email NOT IN (SELECT email FROM c WHERE ts < TIMESTAMP '2024-01-03' AND id % 7 = 0) GROUP BY email""",
)
def stream_send_once_keyed(t):
    """Captures in five batches, the third repeated after a failure; e-mails sent before are the initial state."""
    folder = _folder(t.spark)
    rows = t.read("events").select(
        F.concat(F.lit("ev"), "event_id").alias("event_id"), F.concat(F.lit("user"), "user_id", F.lit("@mail.com")).alias("email"),
        F.col("ts").alias("created_at"), F.col("event_id").alias("id"),
    )
    sent = rows.filter((F.col("created_at") < F.lit("2024-01-03").cast("timestamp_ntz")) & (F.col("id") % 7 == 0)).select("email", "event_id")
    at = F.col("created_at")
    stream = _feed(rows.drop("id"), f"{folder}/in", at, _edges(rows, at))
    passed = keyed.send_once(stream, sent)
    with keyed.keyed_state(t.spark):
        try:
            keyed.by_batch(passed, f"{folder}/out", f"{folder}/state", fail_once_at=2).awaitTermination()
        except StreamingQueryException:
            keyed.by_batch(passed, f"{folder}/out", f"{folder}/state").awaitTermination()
    remove(t.spark, f"{folder}/in")
    return _result(t.spark, folder, passed.schema).select("email", "event_id")


_BANDS = [(k, (k - 1) / 10, k / 10) for k in range(1, 11)]
_HOURS = "INTERVAL 1 HOUR"
_DECILE = "CASE " + " ".join(f"WHEN lead_score <= {k / 10}::DOUBLE THEN {k}" for k in range(1, 10)) + " ELSE 10 END"
_DAILY = f"""lead_rows AS (SELECT lead_id, email, phone, name, lead_score, captured_at AS at,
    {_DECILE} AS decile FROM leads WHERE email IS NOT NULL),
capture_rows AS (SELECT id, email, first_name, fbp, event_id, created_at + (id % 5 - 2) * 7 * {_HOURS} AS at FROM captures WHERE id % 3 <> 0 AND email IS NOT NULL),
met AS (SELECT l.*, c.id, c.event_id, c.fbp, c.first_name FROM lead_rows l
    LEFT JOIN capture_rows c ON l.email = c.email AND c.at BETWEEN l.at - INTERVAL 1 DAY AND l.at + INTERVAL 1 DAY),
enriched AS (SELECT * FROM met QUALIFY row_number() OVER (PARTITION BY lead_id ORDER BY (NOT coalesce(first_name <> '', false)), id) = 1)"""
_RATES = " ".join(f"WHEN {k} THEN {r}::DOUBLE" for k, r in zip(DECILES, CORRECTED_RATES, strict=True))


@query(
    "stream_daily_events",
    sql(f"""SELECT event_name, prefix || coalesce(event_id, 'lead_1706659200_' || substr(sha256(email), 1, 16)) AS event_id, sha256(email) AS em, fbp,
  CASE event_name WHEN 'LeadQualified' THEN round(2000.0 * CASE decile {_RATES} END, 6) END AS value
FROM enriched, (VALUES ('LeadQualified', 'qualified_', 1), ('LeadQualifiedHighQuality', 'hq_', 9)) k(event_name, prefix, least_decile) WHERE decile >= least_decile""", _DAILY),
)
def stream_daily_events(t):
    """Leads and captures both streamed out of order, captures up to a day after their lead."""
    folder = _folder(t.spark)
    hours = lambda c: F.make_dt_interval(hours=c)
    leads = stored(t.leads.filter("email IS NOT NULL").select("lead_id", "email", "phone", "name", "lead_score", F.col("captured_at").cast("timestamp").alias("created_at")), "daily-leads")
    late = (F.col("id") % 5 - 2).cast("int") * 7
    captures = stored(t.captures.filter("email IS NOT NULL AND id % 3 <> 0").select(
        "id", "email", "first_name", "fbp", "event_id", (F.col("created_at").cast("timestamp") + hours(late)).alias("captured_at")), "daily-captures")
    # rows arrive up to 36 hours after their time
    arrives = F.col("created_at") + hours((F.col("lead_id") % 37).cast("int")), F.col("captured_at") + hours((F.col("id") % 29).cast("int"))
    edges = _edges(leads, arrives[0])
    # a row far ahead on each side moves both watermarks over all others
    ahead = lambda df, at, key: df.limit(1).withColumns({at: F.col(at) + F.expr("INTERVAL 400 DAYS"), key: F.lit(-1).cast(df.schema[key].dataType), "email": F.lit("last")})
    left = _feed(leads, f"{folder}/leads", arrives[0], edges, ahead(leads, "created_at", "lead_id"))
    right = _feed(captures, f"{folder}/captures", arrives[1], edges, ahead(captures, "captured_at", "id"))
    events = keyed.daily_events(left, right, _BANDS, 1706659200)
    with keyed.keyed_state(t.spark):
        keyed.by_batch(events, f"{folder}/out", f"{folder}/state").awaitTermination()
    remove(t.spark, f"{folder}/leads")
    remove(t.spark, f"{folder}/captures")
    return _event_rows(_result(t.spark, folder, events.schema))


def _event_rows(events: DataFrame) -> DataFrame:
    e = F.col("event")
    return events.select(
        e["event_name"].alias("event_name"), e["event_id"].alias("event_id"), e["user_data"]["em"].alias("em"), e["user_data"]["fbp"].alias("fbp"),
        F.round(e["custom_data"]["value"], 6).alias("value"),
    )
