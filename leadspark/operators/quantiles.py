"""Exact order statistics and running totals over one numeric column, without ever
sorting the column in a single task.

Quantiles: a sketch brackets each wanted rank, one aggregate counts what lies below and at
the ends of the brackets, and the few thousandths of the values strictly between are
bracketed again until few enough to look at. Most columns take three passes, very long ones
two more; ties lie at the ends and cost nothing.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

#: Accuracy of a sketch, and the values between two ends that are looked at one by one.
ACCURACY = 10_000


def _numbers(df: DataFrame, column: str) -> DataFrame:
    x = F.col(column)
    kept = x.isNotNull()
    if dict(df.dtypes)[column] in ("double", "float"):
        kept = kept & ~F.isnan(x)
    return df.filter(kept).select(x.alias("x"))


@dataclass
class _Bracket:
    """Values strictly between ``low`` and ``high`` (None: open end), of which ``below`` are smaller."""

    rank: int
    below: int
    size: int
    low: object = None
    high: object = None

    def inside(self) -> Column:
        x, test = F.col("x"), F.lit(True)
        test = test if self.low is None else test & (x > F.lit(self.low))
        return test if self.high is None else test & (x < F.lit(self.high))

    def sketch(self) -> Column:
        at = (self.rank - self.below + 0.5) / self.size
        probs = [min(max(at + d, 0.0), 1.0) for d in (-2.0 / ACCURACY, 2.0 / ACCURACY)]
        return F.percentile_approx(F.when(self.inside(), F.col("x")), probs, ACCURACY)


def _narrow(values: DataFrame, open_: list[_Bracket], ends: list, found: dict) -> list[_Bracket]:
    """Count at the ends of each bracket's sketch; ranks at an end are found, the others keep one side."""
    x, checks = F.col("x"), []
    for low, high in ends:
        checks += [F.count_if(x < low), F.count_if(x <= low), F.count_if(x < high), F.count_if(x <= high)]
    counted = list(values.agg(*checks).first())
    left = []
    for i, (b, (low, high)) in enumerate(zip(open_, ends, strict=True)):
        under, low_end, before, high_end = counted[4 * i : 4 * i + 4]
        if under <= b.rank < low_end:
            found[b.rank] = low
        elif before <= b.rank < high_end:
            found[b.rank] = high
        elif b.rank < under:  # the sketch erred; the exact counts tell on which side to look
            left.append(_Bracket(b.rank, b.below, under - b.below, b.low, low))
        elif b.rank < before:
            left.append(_Bracket(b.rank, low_end, before - low_end, low, high))
        else:
            left.append(_Bracket(b.rank, high_end, b.below + b.size - high_end, high, b.high))
    return left


def _look(values: DataFrame, few: list[_Bracket], found: dict) -> None:
    """The values of small brackets, each with its count, in one pass."""
    if not few:
        return
    marks = F.array_compact(F.array(*(F.when(b.inside(), F.lit(i)) for i, b in enumerate(few))))
    counts = values.select("x", F.explode(marks).alias("i")).groupBy("i", "x").count().collect()
    for i, b in enumerate(few):
        seen = b.below
        for value, count in sorted((r["x"], r["count"]) for r in counts if r["i"] == i):
            seen += count
            if b.rank < seen:
                found[b.rank] = value
                break


def _select(values: DataFrame, n: int, ranks: Sequence[int]) -> dict[int, object]:
    found: dict[int, object] = {}
    open_ = [_Bracket(r, 0, n) for r in sorted(set(ranks))]
    while open_:
        sketches = list(values.agg(*(b.sketch() for b in open_)).first())
        open_ = _narrow(values, open_, [tuple(s) for s in sketches], found)
        _look(values, [b for b in open_ if b.size <= ACCURACY], found)
        open_ = [b for b in open_ if b.size > ACCURACY]
    return found


def order_statistics(df: DataFrame, column: str, ranks_of: Callable[[int], Sequence[int]]) -> tuple[int, dict[int, object]]:
    """``(n, {rank: value})`` for 0-based ranks among the non-null values of ``column``.

    The column is written once: the passes read it alone and never again what it comes from.
    """
    values = stored(_numbers(df, column), "order-values")
    n = values.count()
    return n, (_select(values, n, list(ranks_of(n))) if n else {})


def exact_quantiles(df: DataFrame, column: str, probs: Sequence[float]) -> list[float]:
    """Quantiles with linear interpolation between neighbours; empty for an empty column."""
    spots = lambda n: [(n - 1) * p for p in probs]
    n, values = order_statistics(df, column, lambda n: [k for h in spots(n) for k in (math.floor(h), math.ceil(h))])
    if not n:
        return []
    out = []
    for h in spots(n):
        low, high = values[math.floor(h)], values[math.ceil(h)]
        out.append(float(low + (high - low) * (h - math.floor(h))))
    return out


def running_totals(df: DataFrame, column: str, measures: dict[str, str]) -> DataFrame:
    """Per distinct value of ``column``: the summed measures and ``<name>_before``, their
    total over all smaller values.

    Value ranges are totalled first, as many as the root of the number of distinct values:
    so ranges, and values in a range, both grow slowly. Running sums over the ranges and
    within each range add up.
    """
    totals = (
        df.filter(F.col(column).isNotNull())
        .withColumn(column, F.col(column).cast("double"))
        .groupBy(column)
        .agg(*[F.sum(F.expr(expr)).alias(name) for name, expr in measures.items()])
    )
    totals = stored(totals, "running-totals")  # read for the ranges, their totals and the values
    ranges = max(1, math.isqrt(totals.agg(F.approx_count_distinct(column)).first()[0]))
    probs = [i / ranges for i in range(1, ranges)]
    cuts = totals.approxQuantile(column, probs, 1 / (4 * ranges)) if probs else []
    splits = [-math.inf, *sorted(set(cuts)), math.inf]
    ranged = Bucketizer(splits=splits, inputCol=column, outputCol="__range").transform(totals)
    upto = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy("__range")
        .agg(*[F.sum(m).alias(m) for m in measures])
        .select("__range", *[F.coalesce(F.sum(m).over(upto), F.lit(0)).alias(f"__{m}") for m in measures])
    )
    within = Window.partitionBy("__range").orderBy(column).rowsBetween(Window.unboundedPreceding, -1)
    joined = ranged.join(offsets, "__range")
    return joined.select(
        column,
        *measures,
        *[
            (F.col(f"__{m}") + F.coalesce(F.sum(m).over(within), F.lit(0))).alias(f"{m}_before")
            for m in measures
        ],
    )
