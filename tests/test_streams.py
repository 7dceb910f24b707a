"""Keyed state and the join of two streams, in several batches."""

import os
from datetime import datetime, timedelta

import pytest
from pyspark.errors import StreamingQueryException

from leadspark.streaming import keyed

START = datetime(2024, 1, 1)
LEADS = "email string, event_id string, created_at timestamp"


def _batch(spark, rows, path):
    spark.createDataFrame(rows, LEADS).coalesce(1).write.mode("append").parquet(path)


def _stream(spark, path):
    return spark.readStream.schema(LEADS).option("maxFilesPerTrigger", 1).parquet(path)


def test_send_once_over_batches(spark, tmp_path):
    source, out, state = (str(tmp_path / d) for d in ("in", "out", "state"))
    at = lambda h: START + timedelta(hours=h)
    batches = [
        [("a", "e2", at(2)), ("a", "e1", at(1)), (None, "e0", at(0))], [("b", "e3", at(3)), ("old", "e4", at(3))],
        [("a", "e5", at(5)), ("c", "e7", at(5)), ("c", "e6", at(5))], [("b", "e8", at(6)), ("d", "e9", at(7))], [("e", "e10", at(8)), ("a", "e11", at(9))],
    ]
    for rows in batches:
        _batch(spark, rows, source)
    sent = spark.createDataFrame([("old", "x"), ("old", "y"), (None, "z")], "email string, event_id string")
    passed = keyed.send_once(_stream(spark, source), sent)
    with keyed.keyed_state(spark):
        with pytest.raises(StreamingQueryException):
            keyed.by_batch(passed, out, state, fail_once_at=2).awaitTermination()
        keyed.by_batch(passed, out, state).awaitTermination()
    assert len([d for d in os.listdir(out) if d.startswith("batch_id=")]) == 5
    rows = spark.read.schema(passed.schema).parquet(out)
    assert sorted((r.email, r.event_id) for r in rows.collect()) == [("a", "e1"), ("b", "e3"), ("c", "e6"), ("d", "e9"), ("e", "e10")]
    # more data, later: the state is still there
    _batch(spark, [("d", "e12", at(20)), ("f", "e13", at(21))], source)
    with keyed.keyed_state(spark):
        keyed.by_batch(passed, out, state).awaitTermination()
    assert sorted(r.event_id for r in spark.read.schema(passed.schema).parquet(out).collect()) == ["e1", "e10", "e13", "e3", "e6", "e9"]
    plan = passed._jdf.queryExecution().analyzed().toString()
    assert plan.count("StreamingRelation") == 1


def test_state_with_a_time_to_live(spark, tmp_path):
    source, out, state = (str(tmp_path / d) for d in ("in", "out", "state"))
    _batch(spark, [("a", "e1", START)], source)
    passed = keyed.send_once(_stream(spark, source), keep_days=1)
    with keyed.keyed_state(spark):
        running = keyed.by_batch(passed, out, state, every="1 second")
        try:
            for more in ([("a", "e2", START)], [("b", "e3", START)]):
                _batch(spark, more, source)
                running.awaitTermination(10)
        finally:
            running.stop()
    assert sorted(r.event_id for r in spark.read.schema(passed.schema).parquet(out).collect()) == ["e1", "e3"]


def test_late_captures(spark, tmp_path):
    lead_schema = "lead_id long, email string, phone string, name string, lead_score double, created_at timestamp"
    cap_schema = "id long, email string, first_name string, fbp string, event_id string, captured_at timestamp"
    at = lambda h: START + timedelta(hours=h)
    leads = [[(1, "a", None, None, 0.95, at(0)), (2, "b", None, "Bo B", 0.2, at(1))], [(3, "a", None, None, 0.5, at(30)), (4, None, None, None, 0.5, at(30))], [(9, "end", None, None, 0.1, at(9000))]]
    captures = [[(1, "x", None, "f", "ev1", at(0))], [(2, "a", None, "f2", "ev2", at(2)), (3, "a", "Ana", "f3", "ev3", at(20))], [(9, "end", None, None, "ev9", at(9000))]]
    for k, (left, right) in enumerate(zip(leads, captures, strict=True)):
        spark.createDataFrame(left, lead_schema).coalesce(1).write.parquet(f"{tmp_path}/leads/p={k}")
        spark.createDataFrame(right, cap_schema).coalesce(1).write.parquet(f"{tmp_path}/caps/p={k}")
    bands = [(k, (k - 1) / 10, k / 10) for k in range(1, 11)]

    def of(kind, schema, read):
        return read.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{kind}").select(*[f.split()[0] for f in schema.split(", ")])

    streamed = keyed.daily_events(of("leads", lead_schema, spark.readStream), of("caps", cap_schema, spark.readStream), bands, 5)
    with keyed.keyed_state(spark):
        keyed.by_batch(streamed, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    batch = keyed.daily_events(of("leads", lead_schema, spark.read), of("caps", cap_schema, spark.read), bands, 5, joined=keyed.late_captures_batch)
    ids = lambda df: sorted((r.event.event_id, r.event.user_data.fbp or "") for r in df.collect())
    # a lead without e-mail passes too and has no id of its own
    got, want = ids(spark.read.schema(streamed.schema).parquet(f"{tmp_path}/out").filter("email IS NOT NULL")), ids(batch.filter("email <> 'end'"))
    assert got == want
    assert ("qualified_ev3", "f3") in got and ("hq_ev3", "f3") in got and any(i.startswith("qualified_lead_5_") for i, _ in got)
