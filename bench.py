"""Time the headline queries and print one JSON line.

Every query is computed in full into a no-op sink. ``score_leads`` is batch scoring as a
user runs it (features, encoding, forest, decile) over all leads with a model fitted
beforehand; ``leads_per_second`` is its rate.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

HEADLINE = (
    "conversion_by_decile", "contacts_normalized", "phone_variants", "target_email_phone", "target_variants", "attribution_first_sale",
    "attribution_temporal", "conversions_dedup", "buyers_tracked", "utm_cleaned", "name_consolidation", "decile_assign", "ranking_metrics",
    "cost_rollup", "cost_by_level", "cost_periods", "cost_lookup_cascade", "utm_economics_1d_3d_7d", "utm_economics_adset", "utm_economics_ad",
    "fuzzy_residue", "campaign_metrics", "ml_vs_control", "adset_comparison", "ad_comparison", "fair_controls", "category_shares", "drift_summary",
    "temporal_split", "leakage", "person_components", "conversion_events", "stream_dedup",
)


def score_leads(spark: SparkSession, sf_dir: str):
    """Set up a fitted scorer; the returned callable scores all leads. Also their number, and the scorer's quality."""
    from leadspark.operators import encode, model
    from leadspark.plans.bindings import Tables
    from leadspark.plans.model import _model_frames
    from leadspark.operators import features
    from leadspark.operators import utm

    t = Tables(spark, sf_dir)
    encoder, train, test = _model_frames(t)
    scorer, held_out = model.train_scorer(train, test, encoder, params={"numTrees": 300, "maxDepth": 8})
    assert isinstance(scorer.encoder, encode.Encoder)

    def run():
        leads = utm.unify_term(utm.with_class(t.leads))
        derived = features.derive_features(leads, "captured_at", "name", "email_raw", "phone_raw", keep_raw=True)
        scored = model.predict(scorer.model, scorer.encoder.transform(derived, ("lead_id",)))
        return model.dec.assign_deciles(scored.select("lead_id", "lead_score"), scorer.bands)

    quality = model.dec.ranking_metrics(held_out).first()
    return run, t.leads.agg(F.count("*")).first()[0], {"auc": quality["auc"], "top3_share": quality["top3_share"]}


def timed(make) -> float:
    start = time.perf_counter()
    make().write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("leadspark-bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g").config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from leadspark.plans import load_all

    queries, _ = load_all()
    names = sys.argv[1:] or HEADLINE
    timed(lambda: queries["conversion_by_decile"](spark, sf_dir))  # start the JVM's engines
    seconds = {name: timed(lambda name=name: queries[name](spark, sf_dir)) for name in names if name != "score_leads"}
    extra = {}
    if "score_leads" in names or not sys.argv[1:]:
        run, leads, quality = score_leads(spark, sf_dir)
        seconds["score_leads"] = timed(run)
        extra = {**quality, "leads_scored": leads, "leads_per_second": round(leads / seconds["score_leads"], 1)}
    print(json.dumps({
        "metric": "headline query seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")), **extra,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
