"""Column profiles of any period from sketches kept per day.

A day's rows are read once; its sketches are some kilobytes a column and merge in any order, so the
profile of a period reads the days' sketches and never the rows. Distinct counts come from
HyperLogLog (relative standard error about ``1.04 / sqrt(2 ** LG_K)``: 1.6 %), quantiles from
KLL (rank error about 1.3 % at ``KLL_K``), frequent values from a frequent-items sketch: exact
while a column has fewer values than it tracks, else within ``rows / TRACKED`` or so.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LG_K, KLL_K, TRACKED = 12, 200, 4096


def daily_sketches(df: DataFrame, time: str, values: list[str], numbers: list[str] = ()) -> DataFrame:
    """A row per day and column: ``day, column, rows, filled, distinct, frequent, quantiles``.

    ``values`` are profiled as text, ``numbers`` by quantiles as well; rows without a time are
    left out. All sketches are built by one aggregate with a partial step for each task.
    """
    columns = [*values, *(n for n in numbers if n not in values)]
    both = F.array(*(F.struct(F.lit(k).alias("column"), F.col(k).cast("string").alias("value"), (F.col(k) if k in numbers else F.lit(None)).cast("double").alias("number")) for k in columns))
    long = df.filter(F.col(time).isNotNull()).select(F.col(time).cast("date").alias("day"), F.explode(both).alias("p")).select("day", "p.*")
    return long.groupBy("day", "column").agg(
        F.count("*").alias("rows"), F.count("value").alias("filled"), F.hll_sketch_agg("value", LG_K).alias("distinct"),
        F.expr(f"approx_top_k_accumulate(value, {TRACKED})").alias("frequent"), F.kll_sketch_agg_double("number", KLL_K).alias("quantiles"),
    )


def _period(sketches: DataFrame, start: str, end: str) -> DataFrame:
    return sketches.filter(F.col("day").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def period_profile(sketches: DataFrame, start: str, end: str, ranks: tuple[float, ...] = (0.0, 0.5, 1.0)) -> DataFrame:
    """``column, rows, nulls, null_pct, distinct, quantiles`` of a closed period, from stored sketches."""
    merged = _period(sketches, start, end).groupBy("column").agg(
        F.sum("rows").alias("rows"), F.sum("filled").alias("filled"), F.hll_union_agg("distinct").alias("d"), F.kll_merge_agg_double("quantiles").alias("q"))
    at = [F.when(F.kll_sketch_get_n_double("q") > 0, F.kll_sketch_get_quantile_double("q", F.lit(r))) for r in ranks]
    return merged.select(
        "column", "rows", (F.col("rows") - F.col("filled")).alias("nulls"), ((F.col("rows") - F.col("filled")) * 100.0 / F.col("rows")).alias("null_pct"),
        F.hll_sketch_estimate("d").alias("distinct"), F.array(*at).alias("quantiles"),
    )


def period_top(sketches: DataFrame, start: str, end: str, k: int) -> DataFrame:
    """``column, value, n`` of the ``k`` most frequent values of each column in a closed period, from stored sketches."""
    merged = _period(sketches, start, end).groupBy("column").agg(F.expr(f"approx_top_k_combine(frequent, {TRACKED})").alias("f"))
    return merged.select("column", F.explode(F.expr(f"approx_top_k_estimate(f, {k})")).alias("t")).select("column", F.col("t.item").alias("value"), F.col("t.count").alias("n"))
