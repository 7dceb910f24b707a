"""Join helpers shared by the operators.

No operator broadcasts a side whose size grows with the data on faith: joins are plain
equi joins that adaptive execution may turn into broadcasts from measured sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Columns that tell rows apart and are cheap to read, in order of preference.
ROW_IDS = ("lead_id", "row_id", "sale_id", "event_id", "id", "captured_at", "created_at", "sale_date")


def spread_key(df: DataFrame, key: str) -> Column:
    """``key``, with nulls replaced by row hashes that match nothing.

    A left join sends all null keys to one task; the hashes spread them evenly. A row id
    is hashed where there is one, so that the join does not make a scan read every column.
    """
    ids = [c for c in ROW_IDS if c in df.columns and c != key][:1]
    hashable = [f.name for f in df.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    filler = F.concat(F.lit("\u0000"), F.xxhash64(*(ids or hashable)).cast("string"))
    return F.coalesce(F.col(key).cast("string"), filler)


def left_lookup(left: DataFrame, table: DataFrame, key: str, table_key: str | None = None) -> DataFrame:
    """Left join to ``table``, which has one row per key; its key column is not kept."""
    table_key = table_key or key
    right = table.filter(F.col(table_key).isNotNull()).withColumn(
        "__table_key", F.col(table_key).cast("string")
    )
    right = right.drop(table_key)
    keyed = left.withColumn("__key", spread_key(left, key))
    return keyed.join(right, F.col("__key") == F.col("__table_key"), "left").drop(
        "__key", "__table_key"
    )


def flag_members(left: DataFrame, keys: DataFrame, key: str, flag: str, keys_key: str | None = None) -> DataFrame:
    """Boolean column telling whether ``key`` occurs in ``keys``."""
    keys_key = keys_key or key
    members = keys.select(keys_key).distinct().withColumn(flag, F.lit(True))
    return left_lookup(left, members, key, keys_key).withColumn(
        flag, F.coalesce(F.col(flag), F.lit(False))
    )


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The row with the smallest ``order`` per key.

    An aggregate with map-side combine rather than a window, so a hot key never has to
    be gathered and sorted in one task. Give ``order`` ties a unique last column.
    """
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return best.select(*keys, "__row.*").select(*df.columns)


def nulls_last(c: Column) -> list[Column]:
    return [c.isNull(), c]
