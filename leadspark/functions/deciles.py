"""Decile labels and assignment by fixed thresholds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def decile_label(c: Column, padded: bool = True) -> Column:
    """Integer decile to ``D01`` .. ``D10`` (or ``D1`` .. ``D10``)."""
    return F.when(c.isNotNull(), F.format_string("D%02d" if padded else "D%d", c))


def decile_number(c: Column) -> Column:
    """``D3`` or ``D03`` to 3; anything else to null."""
    number = F.regexp_extract(F.upper(F.trim(c)), "^D0*([0-9]+)$", 1).try_cast("int")
    return F.when(number.between(1, 10), number)


def bin_by_edges(x: Column, edges: list[float]) -> Column:
    """Right-closed bin 1.. over ascending inner edges; null stays null."""
    last = len(edges) + 1
    out = F.lit(last)
    for k in range(len(edges), 0, -1):
        out = F.when(x <= F.lit(edges[k - 1]), k).otherwise(out)
    return F.when(x.isNotNull(), out)


def by_thresholds(score: Column, bands: list[tuple[int, float, float]]) -> Column:
    """Decile of the band ``(decile, low, high)`` that holds the score.

    Above all bands the top decile, below all the bottom one, in a gap the band with
    the nearest midpoint. ``bands`` has at most ten rows, so it is folded into literals.
    """
    bands = sorted(bands, key=lambda b: (b[1], b[0]))
    inside = reduce(
        lambda chain, b: chain.when(score.between(F.lit(b[1]), F.lit(b[2])), b[0]),
        bands[1:],
        F.when(score.between(F.lit(bands[0][1]), F.lit(bands[0][2])), bands[0][0]),
    )
    ten = next((b for b in bands if b[0] == 10), None)
    one = next((b for b in bands if b[0] == 1), None)
    if ten:
        inside = inside.when(score > F.lit(ten[2]), 10)
    if one:
        inside = inside.when(score < F.lit(one[1]), 1)
    by_number = sorted(bands, key=lambda b: b[0])
    nearest = F.array_min(
        F.array(
            *[
                F.struct(F.abs(score - F.lit((low + high) / 2)).alias("gap"), F.lit(k).alias("k"))
                for k, low, high in by_number
            ]
        )
    )["k"]
    return F.when(score.isNotNull() & ~F.isnan(score), inside.otherwise(nearest))


def score_in_range(c: Column) -> Column:
    """Score between 0 and 1, else null."""
    return F.when(c.between(0.0, 1.0), c)
