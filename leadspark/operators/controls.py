"""Search for fair control campaigns by budget and shared creatives."""

from __future__ import annotations

import math
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..session import stored
from .joins import left_lookup


#: Parts that equally used creatives are dealt to; those of one part are not told apart.
TIE_PARTS = 1024
#: Scores down to which a campaign's best controls are looked for first.
LEVELS = (0.9999, 0.99, 0.9)


def campaign_metadata(campaigns: DataFrame, adsets: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Spend and budget per campaign: daily or lifetime budget, else the sum of its adsets'."""
    own = F.coalesce(
        F.when(F.col("daily_budget") > 0, F.col("daily_budget")), F.when(F.col("lifetime_budget") > 0, F.col("lifetime_budget"))
    )
    totals = campaigns.groupBy("campaign_id").agg(
        F.min("campaign_name").alias("campaign_name"), F.sum("spend").alias("spend"), F.max(own).alias("_own")
    )
    from_adsets = adsets.withColumn("_b", own).groupBy("campaign_id").agg(F.sum("_b").alias("_sum"))
    out = left_lookup(totals, from_adsets, "campaign_id")
    return out.withColumn("budget", F.coalesce("_own", "_sum", F.lit(0.0))).drop("_own", "_sum")


def model_campaigns(metadata: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    marked = F.lit(False)
    for marker in settings.model_markers:
        marked = marked | F.lower("campaign_name").contains(marker)
    return metadata.filter(marked)


def creative_sets(ads: DataFrame) -> DataFrame:
    """Distinct creatives per campaign, one row each (never one array per campaign)."""
    return ads.filter("creative_id IS NOT NULL").select("campaign_id", "creative_id").distinct()


def _budget_band(budget: Column, tolerance: float) -> Column:
    """A number so that budgets within ``tolerance`` of a positive one lie in its own band or a neighbouring one."""
    return F.floor(F.ln(budget) / F.lit(-math.log1p(-tolerance) + 1e-12)).cast("long")


def fair_controls(treated: DataFrame, controls: DataFrame, creatives: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """``(campaign_id, control_id, overlap, overlap_pct, score)`` of acceptable controls.

    A prefix filter keeps the join small and exact: two sets that share at least the wanted
    fraction must meet within the first ``size - needed + 1`` creatives of either, ordered
    from rare to common, equally rare ones by a hash. They meet by creative and band of the budget, so
    only controls of about the same budget are looked at; a treated campaign without a budget fits any.
    The budget itself is checked before overlaps are counted.
    """
    tolerance, wanted = settings.budget_tolerance, settings.creative_overlap
    sides = treated.select("campaign_id", "budget", F.lit(True).alias("is_treated")).unionByName(
        controls.select("campaign_id", "budget", F.lit(False).alias("is_treated"))
    )
    owned = creatives.join(sides, "campaign_id")
    size = owned.groupBy("campaign_id").agg(F.count("*").alias("size"))
    # equally used creatives are told apart by a hash, so sets that all hold the same ones have short prefixes too
    frequency = owned.groupBy("creative_id").agg(F.count("*").alias("used")).withColumn("used", F.struct("used", F.pmod(F.xxhash64("creative_id"), F.lit(TIE_PARTS)).alias("part")))
    ranked = owned.join(frequency, "creative_id").join(size, "campaign_id")
    # of two sets A, B: |A n B| >= wanted * max(|A|, |B|) >= wanted * own size. The cut is made
    # on how often a creative is used (ties stay in), so no campaign's set is gathered.
    keep = F.col("size") - F.ceil(F.col("size") * F.lit(wanted) - F.lit(1e-9)) + 1
    before = Window.partitionBy("campaign_id").orderBy("used").rowsBetween(Window.unboundedPreceding, -1)
    levels = (
        ranked.groupBy("campaign_id", "size", "used").agg(F.count("*").alias("n"))
        .withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .filter(F.col("before") < keep).groupBy("campaign_id").agg(F.max("used").alias("limit"))
    )
    rare = ranked.join(levels, "campaign_id").filter("used <= limit")
    t = rare.filter("is_treated").select(F.col("campaign_id"), F.col("budget").alias("t_budget"), F.col("size").alias("t_size"), "creative_id")
    c = rare.filter("NOT is_treated").select(F.col("campaign_id").alias("control_id"), F.col("budget").alias("c_budget"), F.col("size").alias("c_size"), "creative_id")
    gap = F.when(F.col("t_budget") > 0, F.abs(F.col("t_budget") - F.col("c_budget")) / F.col("t_budget")).otherwise(F.lit(0.0))
    if 0 < tolerance < 1:
        # within the tolerance of a positive budget every budget is positive
        any_budget, own = F.array(F.lit(None).cast("long")), _budget_band(F.col("t_budget"), tolerance)
        t = t.withColumn("band", F.explode(F.when(F.col("t_budget") > 0, F.array(own - 1, own, own + 1)).otherwise(any_budget)))
        positive = F.array(F.lit(None).cast("long"), _budget_band(F.col("c_budget"), tolerance))
        c = c.withColumn("band", F.explode(F.when(F.col("c_budget") > 0, positive).otherwise(any_budget)))
        t, c = (side.withColumn("band", F.coalesce(F.col("band").cast("string"), F.lit("any"))) for side in (t, c))
        meeting = ["creative_id", "band"]
    else:
        meeting = ["creative_id"]
    near = (
        t.join(c, meeting)
        .filter((gap <= tolerance) & (F.least("t_size", "c_size") >= F.greatest("t_size", "c_size") * (wanted - 1e-9)))
        .select("campaign_id", "control_id", gap.alias("budget_gap"), "t_size", "c_size").distinct()
    )
    mine = creatives.select("campaign_id", "creative_id")
    theirs = creatives.select(F.col("campaign_id").alias("control_id"), "creative_id")
    shared = near.join(mine, "campaign_id").join(theirs, ["control_id", "creative_id"]).groupBy(
        "campaign_id", "control_id", "budget_gap", "t_size", "c_size"
    ).agg(F.count("*").alias("overlap"))
    fraction = F.col("overlap") / F.greatest("t_size", "c_size")
    return (
        shared.withColumn("overlap_fraction", fraction).filter(F.col("overlap_fraction") >= wanted)
        .select("campaign_id", "control_id", "overlap", (F.col("overlap_fraction") * 100).alias("overlap_pct"),
                ((1 - F.col("budget_gap")) * F.col("overlap_fraction")).alias("score"))
    )


def _alike(campaigns: DataFrame, sets: DataFrame) -> DataFrame:
    """``campaigns`` with ``class``: the same for campaigns of equal budget and equal creatives.

    A set is told by its size and two 64-bit sums over it, which fold map-side: no set is gathered.
    """
    return campaigns.join(sets, "campaign_id").withColumn("class", F.struct("budget", "_size", "_a", "_b"))


def best_controls(
    treated: DataFrame, controls: DataFrame, creatives: DataFrame, k: int, settings: Settings = DEFAULTS, levels: tuple[float, ...] = LEVELS
) -> DataFrame:
    """The ``k`` best of ``fair_controls`` for each treated campaign, with their ``rank``: by score, then ``control_id``.

    Campaigns of equal budget and equal creatives score alike, so each such class is searched once, by
    its smallest id, and of a class of controls only the ``k`` smallest ids can be among the best.
    A score is the product of two numbers up to one, so a pair that scores at least ``x`` shares at
    least ``x`` of its creatives and differs in budget by at most ``1 - x``. The search falls through
    ``levels``: short prefixes and a narrow budget band first. A class that has met ``k`` controls
    scoring the level or more leaves with its answer, so its many weaker pairs are never listed.
    The last level is the full search, for the classes still without ``k``.
    """
    creatives = stored(creatives.select("campaign_id", "creative_id").distinct(), "control-creatives")
    mark = lambda salt: F.bit_xor(F.xxhash64("creative_id", F.lit(salt)))
    sets = creatives.groupBy("campaign_id").agg(F.count("*").alias("_size"), mark("a").alias("_a"), mark("b").alias("_b"))
    sides = [stored(_alike(df.select("campaign_id", "budget"), sets), f"control-{side}") for side, df in (("treated", treated), ("others", controls))]
    firsts = [df.groupBy("class").agg(F.min("campaign_id").alias("campaign_id"), F.first("budget").alias("budget")) for df in sides]
    searched, offered = (stored(df, "control-classes") for df in firsts)
    smallest = Window.partitionBy("class").orderBy("campaign_id")
    # ids of a class that are not its k smallest are dropped in each task before they meet
    ids = sides[1].withColumn("place", F.row_number().over(smallest)).filter(F.col("place") <= k)
    members = stored(
        ids.select("class", F.col("campaign_id").alias("member")).join(offered.select("class", F.col("campaign_id").alias("control_id")), "class")
        .select("control_id", "member"), "control-members")
    held = stored(creatives.join(searched.select("campaign_id").unionByName(offered.select("campaign_id")).distinct(), "campaign_id", "left_semi"), "control-sets")

    order = Window.partitionBy("campaign_id").orderBy(F.desc("score"), "control_id")
    rest, found = searched.select("campaign_id", "budget"), []
    others = offered.select("campaign_id", "budget")
    wanted, tolerance = settings.creative_overlap, settings.budget_tolerance
    steps = [*(x for x in sorted(levels, reverse=True) if x > wanted), None]
    for number, level in enumerate(steps):
        if level is None:
            pairs = fair_controls(rest, others, held, settings)
        else:
            # a hair wider than the bound, so that rounding loses no pair; the filter is exact
            near = replace(settings, creative_overlap=level, budget_tolerance=min(tolerance, 1 - level + 1e-9))
            pairs = fair_controls(rest, others, held, near).filter(F.col("score") >= level)
        every = pairs.join(members, "control_id").drop("control_id").withColumnRenamed("member", "control_id")
        # at most k rows of a class stay in each task before they meet
        ranked = every.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        best = stored(ranked, f"control-best-{number}")
        if level is None:
            found.append(best)
            break
        done = best.filter(F.col("rank") == k).select("campaign_id")
        found.append(best.join(done, "campaign_id", "left_semi"))
        rest = stored(rest.join(done, "campaign_id", "left_anti"), f"control-rest-{number + 1}")
        if not rest.take(1):
            break
    answers = reduce(DataFrame.unionByName, found).withColumnRenamed("campaign_id", "_first")
    asked = sides[0].select("class", "campaign_id").join(searched.select("class", F.col("campaign_id").alias("_first")), "class").select("campaign_id", "_first")
    return asked.join(answers, "_first").select("campaign_id", "control_id", "overlap", "overlap_pct", "score", "rank")


def control_candidates(metadata: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    return metadata.join(model_campaigns(metadata, settings).select("campaign_id"), "campaign_id", "left_anti")
