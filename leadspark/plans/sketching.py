"""Queries: profiles of a period from sketches that are stored by day."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import sketches as sk
from ..session import checkpoint_dir
from .registry import query

_ROWS = """rows_of AS (SELECT event_type, CASE WHEN user_id % 10 <> 0 THEN user_id % 40 END AS visitor, value, ts::DATE AS day FROM events)"""
_START, _END = "2024-01-06", "2024-01-19"
_IN = f"day BETWEEN DATE '{_START}' AND DATE '{_END}'"


def _stored(t):
    """Sketches of every day, written by day and read back."""
    path = f"{checkpoint_dir(t.spark).rstrip('/')}/sketches-{uuid.uuid4().hex}"
    rows = t.read("events").select("ts", "event_type", F.when(F.col("user_id") % 10 != 0, F.col("user_id") % 40).alias("visitor"), "value")
    sk.daily_sketches(rows, "ts", ["event_type", "visitor"], ["value"]).write.partitionBy("day").parquet(path)
    return t.spark.read.parquet(path)


@query(
    "period_profile",
    f"""WITH {_ROWS} SELECT 'event_type' AS "column", count(*) AS "rows", count(*) - count(event_type) AS nulls, (count(*) - count(event_type)) * 100.0 / count(*) AS null_pct,
  count(DISTINCT event_type) AS "distinct", NULL::DOUBLE AS low, NULL::DOUBLE AS high FROM rows_of WHERE {_IN}
UNION ALL SELECT 'visitor', count(*), count(*) - count(visitor), (count(*) - count(visitor)) * 100.0 / count(*), count(DISTINCT visitor), NULL, NULL FROM rows_of WHERE {_IN}
UNION ALL SELECT 'value', count(*), count(*) - count(value), (count(*) - count(value)) * 100.0 / count(*), NULL, min(value), max(value) FROM rows_of WHERE {_IN}""",
)
def period_profile(t):
    """Two weeks of a month; the distinct count of the many-valued column is an estimate and left out."""
    out = sk.period_profile(_stored(t), _START, _END)
    few = F.when(F.col("column") != "value", F.col("distinct"))
    return out.select("column", "rows", "nulls", "null_pct", few.alias("distinct"), F.col("quantiles")[0].alias("low"), F.col("quantiles")[2].alias("high"))


@query(
    "period_top_values",
    f"""WITH {_ROWS}, v AS (SELECT 'event_type' AS "column", event_type AS value FROM rows_of WHERE {_IN} UNION ALL SELECT 'visitor', visitor::VARCHAR FROM rows_of WHERE {_IN})
SELECT "column", value, count(*) AS n FROM v WHERE value IS NOT NULL GROUP BY ALL""",
)
def period_top_values(t):
    """Values of two columns by frequency, both within what the sketch tracks."""
    return sk.period_top(_stored(t), _START, _END, 100).filter(F.col("column") != "value").filter("value IS NOT NULL")
