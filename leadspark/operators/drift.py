"""Distribution drift between two populations, weekly shares and person leakage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import week_start
from .profile import value_counts

EPSILON = 1e-10


def drift_shares(train: DataFrame, prod: DataFrame, features: list[str]) -> DataFrame:
    """Share in percent (two decimals) of every category in both populations.

    A category present on one side only has difference 0: there is nothing to compare
    it with. Shares are over the rows where the feature is known.
    """
    both = train.select(F.lit("t").alias("_side"), *features).unionByName(prod.select(F.lit("p").alias("_side"), *features))
    pairs = [F.struct(F.lit(f).alias("feature"), F.col(f).cast("string").alias("category")) for f in features]
    long = both.select("_side", F.explode(F.array(*pairs)).alias("x")).select("_side", "x.*").filter("category IS NOT NULL")
    of = lambda s, a: F.count_if(F.col("_side") == s).alias(a)
    counts = long.groupBy("feature", "category").agg(of("t", "n_train"), of("p", "n_prod"))
    totals = counts.groupBy("feature").agg(F.sum("n_train").alias("_t"), F.sum("n_prod").alias("_p"))
    out = counts.join(F.broadcast(totals), "feature")  # one row per feature
    share = lambda n, total: F.when(F.col(n) > 0, F.round(F.col(n) * 100.0 / F.col(total), 2))
    out = out.withColumn("train_pct", share("n_train", "_t")).withColumn("prod_pct", share("n_prod", "_p"))
    diff = F.coalesce(F.round(F.col("prod_pct") - F.col("train_pct"), 2), F.lit(0.0))
    return (
        out.withColumn("diff_pp", diff).withColumn("abs_diff_pp", F.abs("diff_pp")).fillna(0.0, ["train_pct", "prod_pct"])
        .drop("_t", "_p")
    )


def drift_kl(shares: DataFrame, epsilon: float = EPSILON) -> DataFrame:
    """Kullback-Leibler divergence of train from production per feature.

    With p = (a + e) / sum(a + e), sum(p ln(p / q)) needs only sums over the categories,
    so the normalising totals come from the same aggregate.
    """
    a, b = F.col("n_train").cast("double"), F.col("n_prod").cast("double")
    sums = shares.groupBy("feature").agg(F.sum(a).alias("_a"), F.sum(b).alias("_b"))
    p = a / F.col("_a") + F.lit(epsilon)
    q = b / F.col("_b") + F.lit(epsilon)
    parts = shares.join(F.broadcast(sums), "feature")  # one row per feature
    agg = parts.groupBy("feature").agg(
        F.sum(p * F.log(p / q)).alias("_plog"), F.sum(p).alias("_p"), F.sum(q).alias("_q")
    )
    return agg.select("feature", (F.col("_plog") / F.col("_p") - F.log(F.col("_p") / F.col("_q"))).alias("kl"))


def drift_summary(shares: DataFrame, high: float = 5.0, medium: float = 2.0) -> DataFrame:
    """Largest and mean difference, worst category and status per feature, worst first."""
    worst = F.struct(F.col("abs_diff_pp"), F.col("category"), F.col("diff_pp"))
    out = shares.groupBy("feature").agg(
        F.max("abs_diff_pp").alias("max_drift"), F.avg("abs_diff_pp").alias("mean_drift"), F.max(worst).alias("_w")
    )
    status = F.when(F.col("max_drift") > high, "high").when(F.col("max_drift") > medium, "moderate").otherwise("stable")
    return out.select(
        "feature", "max_drift", "mean_drift", F.col("_w.category").alias("worst_category"),
        F.col("_w.diff_pp").alias("worst_diff_pp"), status.alias("status"),
    ).orderBy(F.desc("max_drift"), "feature")


def weekly_top_share(df: DataFrame, training_pct: float, time: str = "captured_at", decile: str = "decile", top: int = 10) -> DataFrame:
    """Leads, top-decile leads and share per Monday week, against the training share."""
    known = df.filter(F.col(decile).isNotNull() & F.col(time).isNotNull())
    out = known.groupBy(week_start(F.col(time)).alias("week")).agg(
        F.count("*").alias("total_leads"), F.count_if(F.col(decile) == top).alias("top_leads"), F.min(time).alias("first_lead")
    )
    pct = F.round(F.col("top_leads") * 100.0 / F.col("total_leads"), 2)
    return out.withColumn("top_pct", pct).withColumn("diff_vs_training", F.round(F.col("top_pct") - F.lit(training_pct), 2))


def leakage(train: DataFrame, test: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """Distinct test persons, those also in train, and the percentage, per way of knowing
    a person. Each side is one aggregate of flags per key, so no set is ever gathered."""
    sides = [(train, 1, 0), (test, 0, 1)]
    long = None
    for df, in_train, in_test in sides:
        entries = [F.struct(F.lit(n).alias("by"), c.cast("string").alias("person")) for n, c in keys.items()]
        part = df.select(F.explode(F.array(*entries)).alias("e")).select(
            "e.*", F.lit(in_train).alias("in_train"), F.lit(in_test).alias("in_test")
        )
        long = part if long is None else long.unionByName(part)
    persons = long.filter("person IS NOT NULL AND person <> ''").groupBy("by", "person").agg(
        F.max("in_train").alias("in_train"), F.max("in_test").alias("in_test")
    )
    both = F.sum(F.col("in_train") * F.col("in_test"))
    return persons.groupBy("by").agg(
        F.sum("in_test").alias("test_persons"), both.alias("in_both"),
        F.coalesce(F.try_divide(both * 100.0, F.sum("in_test")), F.lit(0.0)).alias("leakage_pct"),
    )


def person_keys(email: str = "email", phone: str = "phone") -> dict[str, Column]:
    e, p = F.col(email), F.col(phone)
    tagged = F.concat_ws(",", F.concat(F.lit("e:"), e), F.concat(F.lit("t:"), p))
    return {"email": e, "phone": p, "both": tagged}
