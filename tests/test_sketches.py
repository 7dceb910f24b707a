"""Profiles from daily sketches against exact ones."""

from pyspark.sql import functions as F

from leadspark.operators import sketches as sk


def test_period_profile_within_stated_error(spark):
    rows = spark.range(60_000).select(
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 10).cast("int")).alias("day_of"), F.when(F.col("id") % 7 != 0, F.col("id") % 20_011).alias("v"),
        (F.pmod(F.xxhash64("id"), F.lit(1000)) / 10).alias("x"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("rare"), F.col("id"))).otherwise(F.concat(F.lit("often"), F.col("id") % 5)).alias("s"),
    )
    stored = sk.daily_sketches(rows, "day_of", ["v", "s"], ["x"]).cache()
    assert stored.count() == 30
    part = rows.filter("day_of BETWEEN '2024-01-03' AND '2024-01-06'")
    got = {r.column: r for r in sk.period_profile(stored, "2024-01-03", "2024-01-06", (0.0, 0.25, 0.5, 0.9, 1.0)).collect()}
    exact = part.agg(F.count("*").alias("n"), F.count("v").alias("v"), F.count_distinct("v").alias("d"), F.count_distinct("s").alias("s"), F.expr("percentile(x, array(0.0, 0.25, 0.5, 0.9, 1.0))").alias("q")).first()
    assert got["v"].rows == exact.n and got["v"].nulls == exact.n - exact.v
    assert abs(got["v"].distinct / exact.d - 1) < 0.05 and abs(got["s"].distinct / exact.s - 1) < 0.05
    assert all(abs(a - b) < 4 for a, b in zip(got["x"].quantiles, exact.q, strict=True)) and got["v"].quantiles == [None] * 5
    assert (got["x"].quantiles[0], got["x"].quantiles[-1]) == (exact.q[0], exact.q[-1])
    top = [(r.value, r.n) for r in sk.period_top(stored, "2024-01-03", "2024-01-06", 4).filter("column = 's'").collect()]
    want = {r.s: r["count"] for r in part.filter("s LIKE 'often%'").groupBy("s").count().collect()}
    assert {v for v, _ in top} == set(want) and all(abs(n - want[v]) <= exact.n / 1000 for v, n in top)


def test_period_without_days(spark):
    rows = spark.createDataFrame([("2024-01-01", "a"), (None, "b")], "t string, v string").select(F.col("t").cast("timestamp").alias("t"), "v")
    stored = sk.daily_sketches(rows, "t", ["v"])
    assert [(r.rows, r.distinct) for r in sk.period_profile(stored, "2024-01-01", "2024-01-02").collect()] == [(1, 1)]
    assert sk.period_profile(stored, "2024-02-01", "2024-02-02").collect() == []
