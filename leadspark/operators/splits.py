"""Train/test splits: by days, by leads in time order, by person within strata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import person_components
from .quantiles import order_statistics


def split_by_days(df: DataFrame, time: str = "captured_at", fraction: float = 0.7) -> DataFrame:
    """``split`` is ``train`` up to the day that ends ``fraction`` of the period."""
    span = df.agg(F.min(time).alias("_from"), F.max(time).alias("_to"))
    days = F.floor(F.expr("timestampdiff(DAY, _from, _to)") * F.lit(fraction)).cast("int")
    cut = span.select(F.expr("_from").alias("_from"), days.alias("_days")).select(
        (F.col("_from") + F.make_dt_interval("_days")).alias("_cut")
    )
    split = F.when(F.col(time) <= F.col("_cut"), "train").when(F.col(time) > F.col("_cut"), "test")
    return df.crossJoin(F.broadcast(cut)).withColumn("split", split).drop("_cut")  # one row


def split_by_leads(df: DataFrame, time: str = "captured_at", tie: str = "lead_id", fraction: float = 0.7) -> DataFrame:
    """``split`` is ``train`` for the first ``fraction`` of the leads in (time, tie) order.

    The cut is found by exact rank selection on the time and, among leads of that very
    moment, on the tie column; the leads are never numbered in one ordered pass.
    """
    stamped = df.withColumn("_t", F.unix_micros(F.col(time).cast("timestamp")))
    n, at = order_statistics(stamped, "_t", lambda n: [max(int(n * fraction) - 1, 0)])
    wanted = int(n * fraction)
    if wanted == 0:
        return df.withColumn("split", F.lit("test"))
    cut = at[wanted - 1]
    earlier = stamped.filter(F.col("_t") < cut).count()
    same = stamped.filter(F.col("_t") == cut)
    tied, last = order_statistics(same, tie, lambda k: [wanted - earlier - 1])
    first = (F.col("_t") < cut) | ((F.col("_t") == cut) & (F.col(tie) <= F.lit(last[wanted - earlier - 1])))
    known = F.col("_t").isNotNull()
    return stamped.withColumn("split", F.when(known & first, "train").when(known, "test")).drop("_t")


#: Bits of an order hash that one pass over the persons settles, and bits in all.
PASS_BITS, HASH_BITS = 12, 60


def order_hash(person: Column, seed: int) -> Column:
    """A person's place in a random order: the first ``HASH_BITS`` bits of an MD5."""
    return F.conv(F.substr(F.md5(F.concat(F.lit(f"{seed}:"), person)), F.lit(1), F.lit(HASH_BITS // 4)), 16, 10).cast("long")


def mass_cut(df: DataFrame, place: str, mass: str, fraction: float) -> int | None:
    """The greatest ``place`` so that rows up to it hold at most ``fraction`` of all ``mass``; ``None`` if none does.

    A weighted order statistic: each pass adds up the mass in ``2 ** PASS_BITS`` ranges of the
    range that holds the cut, so at most that many sums come to the driver and no row is ordered.
    """
    total = df.agg(F.sum(mass).alias("m")).first().m
    if not total:
        return None
    wanted, before, low, bits = total * fraction, 0, 0, HASH_BITS
    while bits:
        step = max(bits - PASS_BITS, 0)
        part = df.filter((F.col(place) >= low) & (F.col(place) < low + (1 << bits)))
        sums = sorted(tuple(r) for r in part.groupBy(F.floor((F.col(place) - low) / (1 << step)).alias("r")).agg(F.sum(mass).alias("m")).collect())
        crossing = None
        for number, held in sums:
            if before + held > wanted:
                crossing = number
                break
            before += held
        if crossing is None:
            return low + (1 << bits) - 1
        low, bits = low + crossing * (1 << step), step
    return low - 1 if before else None


def split_by_person(
    df: DataFrame, target: str = "target", id_col: str = "lead_id", fraction: float = 0.7, seed: int = 42
) -> DataFrame:
    """No person on both sides, conversion rate alike on both, and ``fraction`` of the leads in training.

    Persons are connected components over e-mail and phone; a person converts if any lead
    does. Within each stratum persons are ordered by a seeded hash; those whose leads fit into
    ``fraction`` of the stratum's leads train, so the share is exact to one person.
    """
    persons = person_components(df, id_col)
    weighed = persons.groupBy("person").agg(F.max(target).alias("_y"), F.count("*").alias("_n"))
    weighed = weighed.withColumn("_h", order_hash(F.col("person"), seed)).persist()
    keep = F.lit(False)
    for label in (0, 1):
        cut = mass_cut(weighed.filter(F.col("_y") == label), "_h", "_n", fraction)
        if cut is not None:
            keep = keep | ((F.col("_y") == label) & (F.col("_h") <= F.lit(cut)))
    sides = weighed.select("person", F.when(keep, "train").otherwise("test").alias("split"))
    return persons.join(sides, "person")


def split_report(df: DataFrame, target: str = "target") -> DataFrame:
    return df.groupBy("split").agg(F.count("*").alias("rows"), F.sum(target).alias("positives"), F.avg(target).alias("positive_rate"))
