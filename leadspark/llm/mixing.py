"""Mixing sources to target weights by pivotal dependent rounding.

A source's documents are each to be taken ``target / size`` times. The whole part is taken;
the fractions are probabilities that are rounded together: two open documents meet, words
move at random from one to the other until one of them is settled at zero or one, and the
other goes on. What one loses in expected words the other gains, and the odds are such that no
probability changes: each document is taken as often as it should be, and a source's words
differ from the expected ones by its last open document at most. Blocks of documents are settled
in tasks; what each block leaves open meets that of other blocks up a reduction tree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from .common import fresh, saved, text_or_empty

#: Weights of the sources in code point order, repeating.
WEIGHTS = (3.0, 1.0, 2.0)
#: All targets together, and the most of one source, as multiples of sizes.
SHARE, MOST = 1.5, 2.0
#: Documents in a block of the first level, and open documents that meet in one node above.
BLOCK, FAN = 1024, 256
SEED = 5


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long"), F.lit(0).cast("long"))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``sizes (source, source_size, ...)``, a row per source, with ``group`` (its number) and ``target``.

    Sources in code point order (null last) get the weights in turn. Targets are ``share`` of
    all sizes dealt by weight; one that is over ``most`` times its source's size stops there
    and the excess is dealt again, until none is above. Each round is one small aggregate.
    """
    total = F.col("source_size")
    # a row per source: their number, not that of documents, meets here
    place = F.row_number().over(W.Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary")))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((place - 1) % len(weights) + 1).cast("int"))
    table = saved(sizes.withColumns({"group": place.cast("long"), "weight": weight}), "sources")
    capped = F.lit(False)
    budget = share * float(table.agg(F.coalesce(F.sum(total), F.lit(0)).alias("s")).first().s)
    level, count = 0.0, -1
    while True:
        limit = most * total
        row = table.agg(
            F.coalesce(F.sum(F.when(capped, limit)), F.lit(0.0)).alias("fixed"), F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0.0)).alias("open"),
            F.count(F.when(capped, 1)).alias("n"),
        ).first()
        if row.n == count or not row.open:
            break
        count, level = row.n, (budget - float(row.fixed)) / float(row.open)
        capped = F.col("weight") * level >= limit
    return table.withColumn("target", F.least(F.col("weight") * level, most * total.cast("double"))).drop("weight")


def _pivot(p: np.ndarray, size: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, int]:
    """Settle probabilities one against the next; the place of the one left open, or -1.

    ``p`` is changed in place to zeros and ones, but for the open one; ``p @ size`` stays.
    """
    open_at = -1
    for i in range(len(p)):
        if open_at < 0:
            open_at = i
        else:
            a, b, ratio = p[open_at], p[i], size[i] / size[open_at]
            up, down = min(1 - a, b * ratio), min(a, (1 - b) * ratio)
            move = up if draws[i] * (up + down) < down else -down
            p[open_at], p[i] = a + move, b - move / ratio
            if min(p[i], 1 - p[i]) > min(p[open_at], 1 - p[open_at]):
                p[open_at], open_at = round(p[open_at]), i
            else:
                p[i] = round(p[i])
        if p[open_at] < 1e-12 or p[open_at] > 1 - 1e-12:
            p[open_at] = round(p[open_at])
            open_at = -1
    return p, open_at


def _draws(h: np.ndarray, level: int) -> np.ndarray:
    """Draws in [0, 1) fixed by each item's hash and the level."""
    x = h.view(np.uint64) + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def settle_node(p: np.ndarray, size: np.ndarray, h: np.ndarray, level: int) -> tuple[np.ndarray, int]:
    """One node's pivotal rounding, and the place of the item that it leaves open, or -1."""
    return _pivot(p.copy(), size, _draws(h, level))


_SETTLED = T.StructType([
    *(T.StructField(k, T.LongType()) for k in ("key", "h", "node", "group", "size")), T.StructField("p", T.DoubleType()), T.StructField("open", T.BooleanType()),
])


def _settle(level: int):
    """Task over rows ``key, h, node, group, size, p`` sorted by group and node: settles each node's rows."""

    def done(part: pa.Table) -> pa.RecordBatch:
        part = part.combine_chunks()
        h, node, group, size, p = (part.column(k).to_numpy() for k in ("h", "node", "group", "size", "p"))
        p, left = p.copy(), np.zeros(len(p), bool)
        starts = np.nonzero(np.concatenate(([True], (group[1:] != group[:-1]) | (node[1:] != node[:-1]))))[0]
        for a, b in zip(starts, [*starts[1:], len(p)], strict=True):
            p[a:b], at = settle_node(p[a:b], size[a:b], h[a:b], level)
            if at >= 0:
                left[a + at] = True
        columns = [part.column(k).combine_chunks() for k in ("key", "h", "node", "group", "size")]
        return pa.RecordBatch.from_arrays([*columns, pa.array(p), pa.array(left)], names=_SETTLED.names)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            if not held.num_rows:
                continue
            group, node = (held.column(k).to_numpy() for k in ("group", "node"))
            # the last node may go on in the next batch
            before = np.nonzero((group != group[-1]) | (node != node[-1]))[0]
            if len(before):
                cut = int(before[-1]) + 1
                yield done(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield done(held)

    return task


def round_together(items: DataFrame) -> DataFrame:
    """``key, p`` with ``p`` zero or one, from ``key, h, group, size, p, number``.

    Within each ``group`` the sizes of the ones add up to the sum of ``p * size``, but for less than
    one item. In a node items meet by falling size. ``h`` is a hash that fixes an item's draws, ``number`` the group's items, which
    are cut into blocks of about ``BLOCK``. Nodes have a bounded number of rows at every level
    and are dealt to tasks whole.
    """
    blocks = F.greatest(F.ceil(F.col("number") / BLOCK), F.lit(1)).cast("long")
    rows = items.withColumn("node", F.pmod(F.xxhash64(F.lit(SEED), "h"), blocks))
    done, level = [], 0
    while True:
        rows = rows.select("key", "h", "node", "group", "size", "p").repartition("group", "node")
        ordered = rows.sortWithinPartitions("group", "node", F.desc("size"), "h")
        settled = saved(ordered.mapInArrow(_settle(level), _SETTLED), "rounding")
        done.append(settled.filter("NOT open").select("key", "p"))
        still = settled.filter("open")
        if not still.agg(F.max("node").alias("top")).first().top:
            break
        level += 1
        rows = still.withColumn("node", F.floor(F.col("node") / FAN))
    # each group has one open item at most, settled by a draw of its own
    own = F.pmod(F.xxhash64(F.lit(SEED), F.lit("last"), "h"), F.lit(1 << 53)).cast("double") / float(1 << 53)
    out = still.select("key", F.when(own < F.col("p"), 1.0).otherwise(0.0).alias("p"))
    for part in done:
        out = out.unionByName(part)
    return out


def mixed(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``k_id, k_hash, k_source, size, source_size, target, copies``: one row for each different document.

    ``size`` is a text's number of words (null: 0). Rows that agree in doc_id, source and text
    are one item whose rows are all taken equally often, each counted; null ids and sources are
    values like any other. Texts without words get no copies. A table without ``source`` has
    one source, null. An empty table gives no rows; other columns are not read. Draws are
    hashes of ids and texts, so reruns agree.
    """
    rows = _keyed(docs).select("k_id", "k_hash", "k_source", word_count(F.col("text")).alias("size"))
    items = rows.groupBy("k_id", "k_hash", "k_source").agg(F.max("size").alias("size"), F.count("*").alias("rows"))
    numbered = items.withColumns({"key": F.monotonically_increasing_id(), "h": F.xxhash64(F.lit(SEED), "k_id", "k_hash", "k_source")})
    items = saved(numbered, "mixing-items")
    words = F.col("size") * F.col("rows")
    totals = items.groupBy(F.col("k_source").alias("source")).agg(F.sum(words).alias("source_size"), F.count(F.when(F.col("size") > 0, 1)).alias("number"))
    targets = source_targets(totals, weights, share, most).select(F.col("source").alias("t_source"), "group", "source_size", "number", "target")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rated = items.join(targets, F.col("k_source").eqNullSafe(F.col("t_source"))).drop("t_source").withColumn("rate", F.when(F.col("size") > 0, rate).otherwise(0.0))
    rated = saved(rated.withColumn("whole", F.floor(F.col("rate") + 1e-12)), "mixing-rates")
    open_items = rated.withColumn("p", F.col("rate") - F.col("whole")).filter("p > 1e-9")
    chosen = round_together(open_items.select("key", "h", "group", "size", "p", "number")).withColumnRenamed("p", "one")
    copies = F.col("whole") + F.coalesce(F.col("one").cast("long"), F.lit(0))
    return rated.join(chosen, "key", "left").select("k_id", "k_hash", "k_source", "size", "source_size", "target", copies.alias("copies"))


def _keyed(docs: DataFrame) -> DataFrame:
    source = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("k_id"), F.xxhash64(text_or_empty()).alias("k_hash"), source.alias("k_source"), "text")


def with_copies(docs: DataFrame, decisions: DataFrame, *columns: str) -> DataFrame:
    """``docs`` with ``columns`` of the decision about each row."""
    a, b, c = fresh(docs, "k_id", "k_hash", "k_source")
    source = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    marked = docs.withColumns({a: F.col("doc_id").cast("long"), b: F.xxhash64(text_or_empty()), c: source}).alias("l")
    found = decisions.select("k_id", "k_hash", "k_source", *columns).toDF(a, b, c, *columns).alias("r")
    same = F.col(f"l.{a}").eqNullSafe(F.col(f"r.{a}")) & (F.col(f"l.{b}") == F.col(f"r.{b}")) & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    return marked.join(found, same).select(*(F.col(f"l.`{x}`") for x in docs.columns), *(F.col(f"r.{x}") for x in columns))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``docs`` with each row as often as the mix takes it.

    A null text has size zero; a null source is a source of its own. Rows that repeat id, source and text are
    taken together, very long documents as a whole. An empty table stays empty; all columns are kept.
    """
    (copies,) = fresh(docs, "copies")
    taken = with_copies(docs, mixed(docs, weights, share, most).withColumnRenamed("copies", copies), copies).filter(F.col(copies) > 0)
    (again,) = fresh(taken, "again")
    return taken.withColumn(again, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).drop(copies, again)
