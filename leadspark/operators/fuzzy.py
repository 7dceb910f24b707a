"""Similarity join of names without comparing all pairs.

If the matched-block ratio of two strings of total length T is at least t, their common
subsequence has M >= tT/2 characters, and at most T - 2M of its steps are interrupted, so
the strings share at least 3M - 1 - T >= (1.5 t - 1) T - 1 adjacent character pairs (and
at least tT/2 single characters, used for short strings). With tokens ordered from rare
to common, two strings that share c tokens must already meet within their first
``size - c + 1``. Only such meetings are scored: the join is exact and its keys are rare.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import similarity_at_least
from ..session import stored


def _limits(t: float) -> tuple[int, int]:
    """Longest string that has no guaranteed pair token, and its longest partner."""
    short = 0
    for length in range(1, 200):
        shortest_total = length + math.ceil(length * t / (2 - t) - 1e-9)
        if math.ceil((1.5 * t - 1) * shortest_total - 1 - 1e-9) < 1:
            short = length
    return short, math.floor(short * (2 - t) / t + 1e-9)


def _tokens(df: DataFrame, value: str, t: float) -> DataFrame:
    """``(group, value, token, needed, size)``: numbered pairs, and characters if short."""
    short, partner = _limits(t)
    n = F.length(value)
    starts = lambda upto: F.sequence(F.lit(1), upto)
    text = F.col(value)
    pairs = F.when(n >= 2, F.transform(starts(n - 1), lambda i: F.substr(text, i, F.lit(2))))
    chars = F.transform(starts(n), lambda i: F.substr(text, i, F.lit(1)))
    least = n + F.ceil(n * F.lit(t / (2 - t)) - F.lit(1e-9))
    need_pairs = F.ceil(F.lit(1.5 * t - 1) * least - F.lit(1 + 1e-9)).cast("int")
    need_chars = F.ceil(F.lit(t / 2) * least - F.lit(1e-9)).cast("int")
    parts = [
        df.filter((n > short) & (n >= 2)).select("grp", value, F.lit("p").alias("kind"),
                                               need_pairs.alias("needed"), F.explode(pairs).alias("piece")),
        df.filter((n >= 1) & (n <= partner)).select("grp", value, F.lit("c").alias("kind"),
                                                   need_chars.alias("needed"), F.explode(chars).alias("piece")),
    ]
    pieces = parts[0].unionByName(parts[1])
    counted = pieces.groupBy("grp", value, "kind", "needed", "piece").agg(F.count("*").alias("times"))
    numbered = counted.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    return numbered.select("grp", value, "needed", F.concat_ws("\u0001", "kind", "piece", "i").alias("token"))


def _prefixes(tokens: DataFrame, frequency: DataFrame, value: str) -> DataFrame:
    """The rare end of each string's token list (a string's own tokens, so a small group)."""
    ranked = tokens.join(frequency, ["grp", "token"])
    lists = ranked.groupBy("grp", value, "needed", F.substr("token", F.lit(1), F.lit(1)).alias("kind")).agg(
        F.array_sort(F.collect_list(F.struct("n", "token"))).alias("all")
    )
    keep = F.greatest(F.size("all") - F.greatest(F.col("needed"), F.lit(1)) + 1, F.lit(0))
    cut = F.slice("all", F.lit(1), keep)
    return lists.select("grp", value, F.explode(cut).alias("entry")).select("grp", value, "entry.token")


def similar_pairs(
    left: DataFrame, right: DataFrame, left_col: str, right_col: str, threshold: float, within: str | None = None
) -> DataFrame:
    """Every pair of distinct values with ``ratio >= threshold``: ``[within,] left, right, ratio``.

    With ``within`` only values of the same group are compared. The threshold must be 0.7 or
    more: below, shared pairs are no longer guaranteed for names of usual length.
    """
    if threshold < 0.7:
        raise ValueError("threshold must be at least 0.7")
    group = F.lit("") if within is None else F.col(within).cast("string")
    a = left.select(group.alias("grp"), F.col(left_col).alias("a")).filter("a IS NOT NULL").distinct()
    b = right.select(group.alias("grp"), F.col(right_col).alias("b")).filter("b IS NOT NULL").distinct()
    ta, tb = _tokens(a, "a", threshold), _tokens(b, "b", threshold)
    # rare within the group: other groups are not compared with
    frequency = ta.select("grp", "token").unionByName(tb.select("grp", "token")).groupBy("grp", "token").agg(F.count("*").alias("n"))
    la, lb = F.length("a"), F.length("b")
    close = (F.least(la, lb) * 2.0 / (la + lb)) >= F.lit(threshold - 1e-12)
    pairs = (
        _prefixes(ta, frequency, "a").join(_prefixes(tb, frequency, "b"), ["grp", "token"])
        .filter(close).select("grp", "a", "b").distinct()
    )
    scored = pairs.withColumn("ratio", similarity_at_least(threshold)("a", "b")).filter("ratio IS NOT NULL")
    kept = [F.col("a").alias("left"), F.col("b").alias("right"), "ratio"]
    return scored.select(*kept) if within is None else scored.select(F.col("grp").alias(within), *kept)


#: Thresholds at which a value's best partner is looked for first.
LEVELS = (0.97, 0.93, 0.88)


def best_matches(
    values: DataFrame, names: DataFrame, value_col: str, name_col: str, threshold: float, within: str | None = None,
    names_first: bool = False, levels: tuple[float, ...] = LEVELS,
) -> DataFrame:
    """For each value its most similar names (all of them if several tie), if any reaches ``threshold``:
    ``[within,] value, name, ratio``, the best of ``similar_pairs``.

    Equal names are joined first; the rest is searched at falling thresholds. A level lists all
    pairs at or above it, so a value that meets anything there has met its best and leaves the search:
    the bound rises to what it found, and its many weaker pairs are never made. The ratio depends on
    the order of its two texts: the value comes first, or with ``names_first`` the name. Names and
    values are written once, each level before the next one starts, so their sources are read once.
    """
    group = [within] if within else []
    keys = [*group, "value"]
    table = stored(names.select(*group, F.col(name_col).alias("name")).filter("name IS NOT NULL").distinct(), "match-names")
    rest = stored(values.select(*group, F.col(value_col).alias("value")).filter("value IS NOT NULL").distinct(), "match-values")
    equal = rest.join(table.withColumn("value", F.col("name")), keys).select(*keys, "name", F.lit(1.0).alias("ratio"))
    found = [equal]
    rest = rest.join(equal.select(*keys), keys, "left_anti")
    for number, level in enumerate([*(x for x in sorted(levels, reverse=True) if x > threshold), threshold]):
        rest = stored(rest, f"match-rest-{number}")
        if not rest.take(1):
            break
        if names_first:
            pairs = similar_pairs(table, rest, "name", "value", level, within).withColumnsRenamed({"left": "name", "right": "value"})
        else:
            pairs = similar_pairs(rest, table, "value", "name", level, within).withColumnsRenamed({"left": "value", "right": "name"})
        pairs = stored(pairs.select(*keys, "name", "ratio"), f"match-pairs-{number}")
        best = stored(pairs.join(pairs.groupBy(*keys).agg(F.max("ratio").alias("ratio")), [*keys, "ratio"]).select(*keys, "name", "ratio"), f"match-best-{number}")
        found.append(best)
        rest = rest.join(best.select(*keys).distinct(), keys, "left_anti")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
