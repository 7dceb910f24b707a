"""Exact duplicates by deterministic block naming.

Texts are cut into blocks of fixed size. Sorted distinct blocks get integer names; then
adjacent names are paired and the sorted distinct pairs get names, until each text has a
single name. Equal name at equal level means equal text; no hash decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import fresh, lower_ascii, matching, saved, text_or_empty

#: Bytes in a block.
BLOCK = 4096


def _names(parts: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct ``columns``, sorted, with an integer ``name`` (partition and place in it)."""
    return parts.distinct().sortWithinPartitions(*columns).withColumn("name", F.monotonically_increasing_id())


def _blocks(raw: Column, size: int) -> Column:
    """The blocks of a binary; an empty one has one empty block."""
    count = F.greatest(F.ceil(F.octet_length(raw) / size), F.lit(1)).cast("int")
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(raw, i * size + 1, F.lit(size)))


def _address(block: Column, seed: int) -> Column:
    """A 128-bit address of a block, by which names travel; ``identities`` proves it unambiguous."""
    return F.struct(F.xxhash64(F.lit(2 * seed), block).alias("h1"), F.xxhash64(F.lit(2 * seed + 1), block).alias("h2"))


def identities(texts: DataFrame, text: Column, carry: dict[str, Column], size: int = BLOCK, seed: int = 0) -> DataFrame:
    """``row, <carry>, level, name`` for each row: level and name are equal exactly if the texts are.

    ``row`` numbers the rows of this call. Block texts are shuffled once, after map-side
    removal of repeats; names go back to the rows by a 128-bit address. Should two different
    blocks share an address, which the names table shows, all is done again with another seed.
    """
    raw = texts.select(*(c.alias(k) for k, c in carry.items()), text.cast("binary").alias("raw"))
    cut = raw.withColumn("blocks", _blocks(F.col("raw"), size))
    rows = saved(cut.select(
        F.monotonically_increasing_id().alias("row"), *carry, F.transform("blocks", lambda b: _address(b, seed)).alias("blocks"),
    ), "blocks")
    named = _names(cut.select(F.explode("blocks").alias("block")), ["block"])
    address = _address(F.col("block"), seed)
    names = saved(named.select(address.h1.alias("h1"), address.h2.alias("h2"), "name"), "block-names")
    if names.groupBy("h1", "h2").count().filter("count > 1").take(1):
        return identities(texts, text, carry, size, seed + 1)
    at = rows.select("row", F.size("blocks").alias("n"), F.posexplode("blocks").alias("at", "b")).select("row", "n", "at", "b.*")
    # a merge join: Spark takes the blocks of all texts for no larger than the texts' rows
    current = at.hint("merge").join(names, ["h1", "h2"]).select("row", "n", "at", "name")
    done, level = [], 0
    while True:
        current = saved(current, "names")
        done.append(current.filter("n = 1").select("row", F.lit(level).alias("level"), "name"))
        longer = current.filter("n > 1")
        if not longer.take(1):
            break
        side = lambda k: F.max(F.when(F.col("at") % 2 == k, F.col("name")))
        pairs = longer.groupBy("row", "n", (F.col("at") / 2).cast("int").alias("half")).agg(side(0).alias("a"), F.coalesce(side(1), F.lit(-1)).alias("b"))
        pairs = saved(pairs, "pairs")
        current = pairs.join(_names(pairs.select("a", "b"), ["a", "b"]), ["a", "b"]).select(
            "row", F.ceil(F.col("n") / 2).cast("int").alias("n"), F.col("half").alias("at"), "name"
        )
        level += 1
    named = done[0]
    for other in done[1:]:
        named = named.unionByName(other)
    return rows.drop("blocks").join(named, "row")


def exact_groups(docs: DataFrame) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for each row of ``docs``.

    Texts are equal when identical after lower-casing A-Z only; null is empty. Of equal
    texts the row with the largest doc_id stays (null is smallest; of equal ids one row).
    Repeated rows each have a row here, at most one kept. An empty table gives no rows;
    other columns are not read. A group may hold a third of all rows: its size and keeper
    are aggregated map-side, and the join back may split it.
    """
    normal = lower_ascii(text_or_empty())
    rows = saved(identities(docs, normal, {"doc_id": F.col("doc_id").cast("long"), "text_sha256": F.sha2(normal.cast("binary"), 256)}), "identities")
    groups = rows.groupBy("level", "name").agg(F.max(F.struct("doc_id", "row")).alias("best"), F.count("*").alias("group_size"))
    # written first, so that the join back deals both sides anew and can split a hot group
    groups = saved(groups.select("level", "name", "group_size", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row")), "equal-groups")
    joined = rows.join(groups, ["level", "name"])
    return joined.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256")


def one_of_each(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ``(doc_id, xxhash64 of the text)`` is in ``keys (k_id, k_hash)``, one for each key.

    Rows that agree in doc_id and text are repeats of one document; one of them stays.
    """
    a, b, place = fresh(docs, "k_id", "k_hash", "place")
    numbered = matching(docs, keys, marks=True).withColumn(place, F.row_number().over(W.Window.partitionBy(a, b).orderBy(b)))
    return numbered.filter(F.col(place) == 1).drop(a, b, place)


def exact_dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts: the one with the largest doc_id.

    A null text is empty and equals other empty ones. A null doc_id is less than any other; of rows
    that repeat id and text one stays. Texts of any length are compared as a whole. An empty table
    stays empty; all columns are kept.
    """
    normal = lower_ascii(text_or_empty())
    rows = saved(identities(docs, normal, {"k_id": F.col("doc_id").cast("long"), "k_hash": F.xxhash64(text_or_empty())}), "identities")
    best = rows.groupBy("level", "name").agg(F.max(F.struct("k_id", "row", "k_hash")).alias("best"))
    return one_of_each(docs, best.select("best.k_id", "best.k_hash"))
