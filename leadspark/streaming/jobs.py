"""Structured Streaming forms of the incremental jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.deciles import by_thresholds
from ..operators.events import conversion_events, enrich_with_captures, payload
from ..operators.joins import first_per_key
from ..operators.model import LeadScorer

WATERMARK = "1 day"


def read_stream(spark: SparkSession, path: str, schema, fmt: str = "json", max_files: int | None = None) -> DataFrame:
    """File stream; ``max_files`` per trigger takes the place of fixed-size lots."""
    reader = spark.readStream.format(fmt).schema(schema)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).load(path)


def capture_intake(events: DataFrame, time: str = "created_at", key: str = "event_id", url: str = "event_source_url") -> DataFrame:
    """Captured leads without thank-you pages, one per event id within the watermark."""
    df = events
    if url in events.columns:
        df = df.filter(~F.coalesce(F.lower(url).contains("parabens"), F.lit(False)))
    return df.withWatermark(time, WATERMARK).dropDuplicatesWithinWatermark([key])


def weekly_counts(events: DataFrame, time: str, *flags) -> DataFrame:
    """Tumbling Monday weeks (the epoch was a Thursday, hence the four days)."""
    return (
        events.withWatermark(time, WATERMARK).groupBy(F.window(time, "7 days", "7 days", "4 days").alias("week"))
        .agg(F.count("*").alias("leads"), *flags)
    )


def trailing_counts(events: DataFrame, time: str, days: int, *keys: str) -> DataFrame:
    """Daily sliding windows of ``days`` days."""
    window = F.window(time, f"{days} days", "1 day").alias("window")
    return events.withWatermark(time, WATERMARK).groupBy(window, *keys).agg(F.count("*").alias("leads"))


def append_stream(df: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    writer = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def send_once(leads: DataFrame, sent_path: str, out_path: str, checkpoint: str, order: str = "created_at", tie: str = "event_id") -> StreamingQuery:
    """Pass each e-mail on once, ever: its first lead of the first batch it occurs in.

    Batches are written under their own id, so a batch repeated after a failure replaces
    its files and compares only with earlier batches.
    """
    columns = leads.select("email").schema
    nobody = leads.sparkSession.createDataFrame([], columns)
    nobody.write.mode("overwrite").parquet(f"{sent_path}/batch_id=-1")  # so the table exists

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        fresh = first_per_key(batch.filter("email IS NOT NULL"), ["email"], [F.col(order), F.col(tie)]).persist()
        sent = batch.sparkSession.read.parquet(sent_path).filter(F.col("batch_id") < batch_id)
        # the growing table is only scanned: it meets the batch's few e-mails first
        known = sent.select("email").join(fresh.select("email"), "email", "left_semi")
        fresh.join(known, "email", "left_anti").write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}")
        # what was passed on is read back from the output, so both tables always agree
        passed = batch.sparkSession.read.schema(leads.schema).parquet(f"{out_path}/batch_id={batch_id}")
        passed.select("email").write.mode("overwrite").parquet(f"{sent_path}/batch_id={batch_id}")
        fresh.unpersist()

    writer = leads.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def score_stream(raw: DataFrame, scorer: LeadScorer, keep: tuple[str, ...] = ("row_id",)) -> DataFrame:
    """Score leads as they arrive. The checkpoint of the sink remembers what was read, so
    no high-water mark is kept in the data."""
    return scorer.score(raw, keep)


def event_stream(leads: DataFrame, captures: DataFrame, bands: list[tuple[int, float, float]], now: int, survey: tuple[str, ...] = ()) -> DataFrame:
    """Scored leads to event payloads, joined to a static table of captures."""
    scored = leads.withColumn("decile", by_thresholds(F.col("lead_score"), bands))
    return payload(conversion_events(enrich_with_captures(scored, captures, now), survey))
