"""As-of look-ups and splits by lead mass against plain versions."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from leadspark.operators import asof, splits

START = datetime(2023, 12, 30)


def test_next_value_equals_brute_force(spark):
    rng = random.Random(2)
    at = lambda: START + timedelta(seconds=rng.choice([0, 60, 86400, 3, 7 * 86400]) * rng.randint(0, 60))
    points = [(rng.choice(["a", "b", "hot", None]), at() if rng.random() > 0.05 else None, rng.randint(0, 9)) for _ in range(150)]
    seen = [(rng.choice(["a", "b", "hot", "hot", "c", None]), at() if rng.random() > 0.05 else None) for _ in range(400)]
    got = asof.next_value(spark.createDataFrame(points, "k string, ts timestamp_ntz, value int"), spark.createDataFrame(seen, "k string, ts timestamp_ntz"), bucket=3600, span=4)
    want = {}
    for k, ts in seen:
        if k is not None and ts is not None:
            later = [(t, v) for key, t, v in points if key == k and t is not None and t >= ts]
            want[k, ts] = min(later)[1] if later else None
    assert {(r.k, r.ts): r.value for r in got.collect()} == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and not any(line.rstrip().endswith("]") and "], [k#" in line and ", b#" not in line and ", s#" not in line for line in windows)


def test_next_value_of_nothing(spark):
    points, seen = spark.createDataFrame([], "k string, ts timestamp_ntz, value int"), spark.createDataFrame([("a", START)], "k string, ts timestamp_ntz")
    assert [tuple(r) for r in asof.next_value(points, seen).collect()] == [("a", START, None)]
    assert asof.next_value(seen.withColumn("value", F.lit(1)), seen.filter("false")).collect() == []


def test_mass_cut(spark):
    rng = random.Random(3)
    for n in (1, 2, 50, 400):
        rows = [(rng.getrandbits(60) if rng.random() > 0.3 else rng.getrandbits(5), rng.randint(1, 40)) for _ in range(n)]
        df = spark.createDataFrame(rows, "h long, n long")
        for fraction in (0.0, 0.3, 0.7, 1.0):
            cut = splits.mass_cut(df, "h", "n", fraction)
            total, best = sum(m for _, m in rows), []
            for h in sorted({h for h, _ in rows}):
                if sum(m for x, m in rows if x <= h) <= total * fraction:
                    best.append(h)
            assert {h for h, _ in rows if cut is not None and h <= cut} == set(best)
    assert splits.mass_cut(df.filter("false"), "h", "n", 0.5) is None


def test_split_by_lead_mass(spark):
    # one person has two fifths of the leads
    rows = [(i, f"p{i if i > 400 else 0}@x.com", None, 0) for i in range(1000)]
    out = splits.split_by_person(spark.createDataFrame(rows, "lead_id long, email string, phone string, target int"))
    train = out.filter("split = 'train'").count()
    assert 300 <= train <= 700 and out.groupBy("email").agg(F.countDistinct("split").alias("n")).filter("n > 1").count() == 0
