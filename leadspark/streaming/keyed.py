"""Streams that keep arbitrary state per key, and joins of two streams."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.deciles import by_thresholds
from ..operators.events import CAPTURE_FIELDS, conversion_events, with_capture_fields

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_SENT = T.StructType([T.StructField("event_id", T.StringType())])


@contextmanager
def keyed_state(spark: SparkSession):
    """Streams started inside keep their state in RocksDB, which spills to disk and writes only its changes."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(STORE, before) if before else spark.conf.unset(STORE)


class SendOnce(StatefulProcessor):
    """One value per e-mail: the event id that was passed on. An e-mail with a value passes nothing."""

    def __init__(self, order: list[str], keep_ms: int | None):
        self.order, self.keep_ms = order, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sent = handle.getValueState("sent", _SENT, self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if self.sent.exists():
            return
        first = None
        for part in rows:
            best = part.sort_values(self.order, kind="stable", na_position="last").head(1)
            first = best if first is None else pd.concat([first, best]).sort_values(self.order, kind="stable", na_position="last").head(1)
        if first is not None and len(first):
            self.sent.update((str(first["event_id"].iloc[0]),))
            yield first

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        if len(initialState):
            self.sent.update((str(initialState["event_id"].iloc[0]),))

    def close(self) -> None:
        pass


def send_once(
    leads: DataFrame, sent: DataFrame | None = None, order: str = "created_at", keep_days: int | None = None,
) -> DataFrame:
    """The stream of leads that pass: of each e-mail the first row of the first batch it occurs in.

    State is one value per e-mail in the state store, so no batch reads what was sent before;
    ``sent`` (``email, event_id``) is loaded into it once, when the stream first starts, and
    ``keep_days`` lets an e-mail be forgotten. Within a batch rows go by ``order``, then
    ``event_id``. Rows without e-mail do not pass. A batch that is repeated after a failure starts from
    the state before it and passes the same rows. Run it inside ``keyed_state``.
    """
    known = leads.filter("email IS NOT NULL")
    initial = None
    if sent is not None:
        one = sent.filter("email IS NOT NULL").groupBy("email").agg(F.min("event_id").alias("event_id"))
        initial = one.groupBy("email")
    keep = None if keep_days is None else keep_days * 86_400_000
    return known.groupBy("email").transformWithStateInPandas(
        statefulProcessor=SendOnce([order, "event_id"], keep), outputStructType=known.schema, outputMode="Append",
        timeMode="None" if keep is None else "ProcessingTime", initialState=initial,
    )


def by_batch(df: DataFrame, path: str, checkpoint: str, fail_once_at: int | None = None, every: str | None = None) -> StreamingQuery:
    """Append each batch under its own id, so that a repeated batch replaces its files.

    All that is there is read and the stream ends, or with ``every`` it goes on at that interval.
    State with a time to live needs the latter: it has a next batch at any time.
    With ``fail_once_at`` the batch of that number is written and then fails, once: what a
    driver lost between the write and the commit leaves behind.
    """
    failed: list[int] = []

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        if batch_id == fail_once_at and not failed:
            failed.append(batch_id)
            raise RuntimeError("batch written, not committed")

    writer = df.writeStream.foreachBatch(one_batch).outputMode("append").option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def late_captures(
    leads: DataFrame, captures: DataFrame, lead_time: str = "created_at", capture_time: str = "captured_at", delay: str = "2 days", apart: str = "1 day",
) -> DataFrame:
    """Leads joined to the captures of their e-mail that came at most ``apart`` before or after them.

    Both sides are streams with watermarks of ``delay``. A lead waits in the state until the
    watermark shows that no capture can come any more; a capture may arrive before or after its
    lead. A lead that met none leaves with null capture columns. Leads without e-mail meet
    none either. Capture columns get the prefix ``c_``.
    """
    left = leads.withWatermark(lead_time, delay)
    right = captures.select(*(F.col(c).alias(f"c_{c}") for c in captures.columns)).withWatermark(f"c_{capture_time}", delay)
    near = F.expr(f"email = c_email AND c_{capture_time} >= {lead_time} - INTERVAL {apart} AND c_{capture_time} <= {lead_time} + INTERVAL {apart}")
    return left.join(right, near, "leftOuter")


def late_captures_batch(leads: DataFrame, captures: DataFrame, lead_time: str = "created_at", capture_time: str = "captured_at", apart: str = "1 day") -> DataFrame:
    """The same join of two tables: what the stream has passed on once all watermarks are over."""
    right = captures.select(*(F.col(c).alias(f"c_{c}") for c in captures.columns))
    near = F.expr(f"email = c_email AND c_{capture_time} >= {lead_time} - INTERVAL {apart} AND c_{capture_time} <= {lead_time} + INTERVAL {apart}")
    return leads.join(right, near, "left")


def with_best_capture(joined: DataFrame, key: str = "lead_id", time: str = "created_at", tie: str = "c_id") -> DataFrame:
    """One row for each lead of ``late_captures`` with the struct ``_c``: its first capture that has a
    first name, else its first capture, else null."""
    fields = [c for c in joined.columns if c.startswith("c_")]
    own = [c for c in joined.columns if not c.startswith("c_")]
    capture = F.when(F.col(tie).isNotNull(), F.struct(*(F.col(c).alias(c[2:]) for c in fields)))
    unnamed = ~F.coalesce(F.col("c_first_name") != "", F.lit(False))
    rows = joined.groupBy(F.window(time, "1 day").alias("_day"), key).agg(
        F.first(F.struct(*own)).alias("_lead"), F.min_by(capture, F.struct(unnamed, tie)).alias("_c"))
    return rows.select("_lead.*", "_c")


def daily_events(leads: DataFrame, captures: DataFrame, bands: list[tuple[int, float, float]], now: int, joined=late_captures) -> DataFrame:
    """Scored leads to conversion events, with captures that may come late.

    ``leads`` has ``lead_id, email, lead_score, created_at`` and more, ``captures`` ``id, email,
    first_name, captured_at`` and more. With ``joined=late_captures_batch`` both are plain tables.
    """
    scored = leads.withColumn("decile", by_thresholds(F.col("lead_score"), bands))
    fields = [f for f in (*CAPTURE_FIELDS, "first_name", "last_name", "name") if f in captures.columns]
    return conversion_events(with_capture_fields(with_best_capture(joined(scored, captures)), fields, now))
