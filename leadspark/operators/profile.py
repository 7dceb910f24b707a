"""Column profiles, category shares, cross-tabs and capture statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.contact import phone_key
from ..functions.text import safe_ratio


def _unpivot(one: DataFrame, columns: list[str], measures: list[str]) -> DataFrame:
    """A one-row frame with ``<column>.<measure>`` fields to one row per column."""
    entries = [
        F.struct(F.lit(c).alias("column"), *[F.col(f"`{c}.{m}`").alias(m) for m in measures]) for c in columns
    ]
    return one.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def column_profile(df: DataFrame, columns: list[str] | None = None, approximate: bool = False) -> DataFrame:
    """Distinct values, nulls and share of nulls per column.

    Exact distinct counts come from one grouping of ``(column, value)`` pairs, which folds
    map-side; ``approximate`` uses a sketch in a single aggregate instead.
    """
    columns = columns or df.columns
    if approximate:
        one = df.agg(
            *[F.approx_count_distinct(c).alias(f"{c}.distinct") for c in columns],
            *[F.count_if(F.col(c).isNull()).alias(f"{c}.nulls") for c in columns],
            *[F.count("*").alias(f"{c}.rows") for c in columns],
        )
        out = _unpivot(one, columns, ["distinct", "nulls", "rows"])
    else:
        out = value_counts(df, columns).groupBy("column").agg(
            F.count("value").alias("distinct"),
            F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("nulls"),
            F.sum("n").alias("rows"),
        )
    return out.withColumn("null_pct", safe_ratio(F.col("nulls"), F.col("rows"), 100)).drop("rows")


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column, value, n`` for every value (as text, nulls included) of every column."""
    pairs = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]
    long = df.select(F.explode(F.array(*pairs)).alias("p")).select("p.column", "p.value")
    return long.groupBy("column", "value").agg(F.count("*").alias("n"))


def missing_rates(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Share of nulls per column in percent."""
    columns = columns or df.columns
    one = df.agg(*[(F.avg(F.col(c).isNull().cast("double")) * 100).alias(f"{c}.missing_pct") for c in columns])
    return _unpivot(one, columns, ["missing_pct"])


def mean_missing_rate(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return missing_rates(df, columns).agg(F.avg("missing_pct").alias("mean_missing_pct"))


def category_shares(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, share in percent and rank of every category; null is a category.

    The window runs over the categories of one column, after counting.
    """
    counts = value_counts(df, columns)
    rows = df.agg(F.count("*").alias("_rows"))
    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), F.asc_nulls_first("value")))
    return (
        counts.withColumn("rank", rank).crossJoin(F.broadcast(rows))  # one row
        .withColumn("pct", F.col("n") * 100.0 / F.col("_rows")).drop("_rows")
    )


def utm_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    return value_counts(df, [c for c in columns if c in df.columns])


def crosstab(df: DataFrame, first: str, second: str) -> DataFrame:
    """Counts of both columns with margins; ``level`` 0 is a cell, 3 the grand total."""
    return df.cube(first, second).agg(F.count("*").alias("n"), F.grouping_id().cast("long").alias("level"))


def inconsistent_utm(df: DataFrame, source: str = "source", term: str = "term") -> DataFrame:
    """Rows with a social platform's term whose source is not that platform's ads."""
    other = ~F.col(source).eqNullSafe(F.lit("facebook-ads"))
    return df.filter(F.col(term).isin("instagram", "facebook") & other)


def phone_validity(df: DataFrame, group: str, phone: str = "phone_raw") -> DataFrame:
    ok = phone_key(F.col(phone)).isNotNull()
    return df.groupBy(group).agg(
        F.count("*").alias("rows"), F.count_if(ok).alias("valid"), (F.avg(ok.cast("double")) * 100).alias("valid_pct")
    )


def flag_rates(df: DataFrame, flags: list[str]) -> DataFrame:
    """Count and percent of true values of boolean columns, one row per flag."""
    one = df.agg(
        *[F.count_if(F.col(f)).alias(f"{f}.n") for f in flags],
        *[(F.avg(F.col(f).cast("double")) * 100).alias(f"{f}.pct") for f in flags],
    )
    return _unpivot(one, flags, ["n", "pct"])


def dtype_counts(df: DataFrame) -> dict[str, int]:
    """Columns per type, from the schema alone."""
    counts: dict[str, int] = {}
    for _, kind in df.dtypes:
        counts[kind] = counts.get(kind, 0) + 1
    return counts


def unification_report(before: DataFrame, after: DataFrame, column: str) -> DataFrame:
    """Categories before and after a unification, with counts on both sides."""
    b = before.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n_before"))
    a = after.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n_after"))
    both = b.join(a, "value", "full").fillna(0, ["n_before", "n_after"])
    status = F.when(F.col("n_after") == 0, "removed").when(F.col("n_before") == 0, "added").otherwise("kept")
    return both.withColumn("status", status)


def capture_stats(df: DataFrame, key: str = "email", fields: tuple[str, ...] = ("fbp", "fbc")) -> DataFrame:
    """Rows, distinct keys and fill rates of the given fields, one row."""
    filled = lambda f: F.col(f).isNotNull() & (F.col(f).cast("string") != "")
    both = filled(fields[0])
    for f in fields[1:]:
        both = both & filled(f)
    return df.agg(
        F.count("*").alias("total"), F.count_distinct(key).alias(f"distinct_{key}"),
        *[F.count_if(filled(f)).alias(f"with_{f}") for f in fields],
        F.count_if(both).alias("with_all"),
        *[(F.coalesce(F.try_divide(F.count_if(filled(f)) * 100.0, F.count("*")), F.lit(0.0))).alias(f"{f}_pct") for f in fields],
    )


def table_stats(df: DataFrame, key: str = "email", time: str = "created_at", sent: str | None = None) -> DataFrame:
    """Rows, distinct keys and first/last time of a table, one row."""
    extra = [F.count_if(F.col(sent).isNotNull()).alias("sent")] if sent else []
    return df.agg(
        F.count("*").alias("rows"), F.count_distinct(key).alias("distinct_keys"),
        F.min(time).alias("first_time"), F.max(time).alias("last_time"), *extra,
    )


def fill_rate(c: Column) -> Column:
    return F.avg((c.isNotNull() & (c != "")).cast("double")) * 100
