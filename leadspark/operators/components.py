"""Connected components of leads that share an e-mail or a phone."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir, remove
from .joins import left_lookup


def _undirected(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang every larger neighbour on the smallest node of the neighbourhood."""
    both = _undirected(edges)
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours on the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return least.select("u", F.col("m").alias("v")).unionByName(moved).distinct()


def _settled(stars: DataFrame) -> bool:
    """Whether every node hangs on exactly one node and no node both hangs and holds."""
    roles = stars.select(F.col("u").alias("n"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).unionByName(
        stars.select(F.col("v").alias("n"), F.lit(0).alias("hangs"), F.lit(1).alias("holds"))
    )
    per = roles.groupBy("n").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
    return not per.filter("hangs > 1 OR (hangs > 0 AND holds > 0)").take(1)


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for an edge list ``(u, v)`` of one orderable type.

    Alternating large and small stars until only stars are left (a logarithmic number of
    rounds). Each star is a minimum per node, folded map-side, and a join whose one side
    has a row per node, so a node with very many neighbours is only a skewed join key.
    Every round is written to the shared checkpoint folder and read back: the lineage is
    cut, nothing is computed twice, and a lost executor re-reads files. A round goes once the
    next one is written.
    """
    spark = edges.sparkSession
    folder = f"{checkpoint_dir(spark).rstrip('/')}/components-{uuid.uuid4().hex}"

    def pinned(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    current = pinned(_undirected(edges).filter("u > v").distinct(), "edges")
    turn, before = 0, "edges"
    while True:
        current = pinned(_small_star(_large_star(current)), f"round-{turn}")
        remove(spark, f"{folder}/{before}")
        if _settled(current):
            break
        turn, before = turn + 1, f"round-{turn}"
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def person_components(leads: DataFrame, id_col: str = "lead_id", email: str = "email", phone: str = "phone") -> DataFrame:
    """Leads with ``person``: one label for all leads linked through e-mails and phones.

    The graph is over contact keys, not leads: a lead with both keys is one edge, and
    equal pairs collapse before anything else, so a key shared by a third of all leads
    costs one node. Leads with no key stand alone.
    """
    e = F.concat(F.lit("e:"), F.col(email))
    p = F.concat(F.lit("p:"), F.col(phone))
    pairs = leads.select(e.alias("u"), p.alias("v")).filter("u IS NOT NULL AND v IS NOT NULL").distinct()
    labels = components(pairs)
    keyed = leads.withColumn("_key", F.coalesce(e, p))
    found = left_lookup(keyed, labels, "_key", "node")
    alone = F.concat(F.lit("i:"), F.col(id_col).cast("string"))
    return found.withColumn("person", F.coalesce("component", "_key", alone)).drop("_key", "component")


def component_sizes(with_person: DataFrame) -> DataFrame:
    """How many persons have how many leads."""
    sizes = with_person.groupBy("person").agg(F.count("*").alias("size"))
    return sizes.groupBy("size").agg(F.count("*").alias("persons"), F.sum("size").alias("leads"))
