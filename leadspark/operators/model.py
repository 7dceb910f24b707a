"""Random-forest lead score on ``pyspark.ml``: train, evaluate, tune, save, predict."""

from __future__ import annotations

import itertools
import json
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir, remove, stored
from . import deciles as dec
from .columns import clean_production_columns, drop_campaign_columns, drop_technical, rename_long, unify_categories
from .encode import Encoder, align_features, feature_categories
from .features import derive_features

FOREST = {"numTrees": 300, "maxDepth": 8, "featureSubsetStrategy": "sqrt", "seed": 42}
#: Equal rows are drawn into the bags of a grid search in up to so many parts.
PARTS = 1024


def with_class_weight(df: DataFrame, target: str = "target", rows: str | None = None) -> DataFrame:
    """Balanced weights: rows / (2 * rows of the class), from a two-row aggregate; times the rows that a row stands for."""
    times = F.lit(1) if rows is None else F.col(rows)
    total = df.agg(F.sum(times).alias("_n"), F.sum(times * F.col(target)).alias("_pos"))
    own = F.when(F.col(target) == 1, F.col("_pos")).otherwise(F.col("_n") - F.col("_pos"))
    weight = times * F.col("_n") / (F.lit(2.0) * own)
    return df.crossJoin(F.broadcast(total)).withColumn("_weight", weight).drop("_n", "_pos")  # one row


def spread(df: DataFrame) -> DataFrame:
    """``df`` in as many parts as there are cores. Encoded features are small as files, and a scan would have
    few tasks for the many trees that each row is sent through."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def alike(df: DataFrame, parts: int = 1) -> DataFrame:
    """``df`` with equal rows in ``parts`` rows or, if they are fewer, each for itself; ``_rows`` is how many one stands for.

    No row is left out: ``_rows`` adds up to the number of rows of each kind. The rows are spread over the
    cores by their values and in order, so that bags drawn by place are the same in every run.
    """
    kinds = df.groupBy(*df.columns).agg(F.count("*").alias("_rows"))
    pieces = F.least(F.col("_rows"), F.lit(parts))
    number = F.explode(F.sequence(F.lit(1).cast("long"), pieces)).alias("_piece")
    cut = kinds.select(*df.columns, (F.col("_rows") / pieces).alias("_rows"), number)
    key = [*df.columns, "_piece"]
    return cut.repartition(df.sparkSession.sparkContext.defaultParallelism, *key).sortWithinPartitions(*key).drop("_piece")


def fit_forest(
    train: DataFrame, features: list[str], target: str = "target", params: dict | None = None, rows: str | None = None
) -> PipelineModel:
    """A forest on ``train``; ``rows`` names a column of how many rows each row stands for."""
    assembler = VectorAssembler(inputCols=features, outputCol="_features")
    forest = RandomForestClassifier(
        featuresCol="_features", labelCol=target, weightCol="_weight", **{**FOREST, **(params or {})}
    )
    return Pipeline(stages=[assembler, forest]).fit(with_class_weight(train, target, rows))


def predict(model: PipelineModel, df: DataFrame, to: str = "lead_score") -> DataFrame:
    scored = model.transform(df).withColumn(to, vector_to_array("probability")[1])
    return scored.drop("_features", "rawPrediction", "probability", "prediction")


def evaluate(scored: DataFrame, target: str = "target", score: str = "lead_score") -> DataFrame:
    return dec.ranking_metrics(dec.with_qcut(scored, score), score, target)


def importances(model: PipelineModel, features: list[str]) -> list[tuple[str, float]]:
    values = model.stages[-1].featureImportances.toArray()
    return sorted(zip(features, map(float, values)), key=lambda p: -p[1])


def importance_table(spark: SparkSession, model: PipelineModel, features: list[str], top_n: int | None = None) -> DataFrame:
    """Feature importances, largest first: a table of one row per feature."""
    rows = importances(model, features)
    table = spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")
    return table if top_n is None else table.limit(top_n)


def utm_importance(model: PipelineModel, features: list[str]) -> float:
    utm = set(feature_categories(features)["utm"])
    return sum(v for f, v in importances(model, features) if f in utm)


# Hyper-parameter grids by size.
GRIDS = {
    "small": {"numTrees": (200, 300, 400), "maxDepth": (8, 10)},
    "medium": {
        "numTrees": (200, 300, 400, 500), "maxDepth": (6, 8, 10, 12), "minInstancesPerNode": (1, 5, 10),
    },
    "large": {
        "numTrees": (200, 300, 400, 500), "maxDepth": (6, 8, 10, 12), "minInstancesPerNode": (1, 5, 10),
        "featureSubsetStrategy": ("sqrt", "log2"),
    },
}


def tune(
    train: DataFrame, test: DataFrame, features: list[str], grid: dict, target: str = "target",
    baseline: dict | None = None, min_gain: float = 0.003, parallel: int = 4, parts: int | None = PARTS,
) -> tuple[dict, list[tuple[dict, float]]]:
    """Grid search on a fixed (time) split by AUC. The best setting is returned only if it
    beats the baseline by ``min_gain`` relative; else the baseline is.

    Both parts are written once and read by every fit. ``parallel`` fits run at the same time,
    each in a scheduler pool of its own, so that with ``spark.scheduler.mode`` FAIR the small last
    stages of one fit leave no executor idle. A fit depends on its setting and seed only, so
    neither the number of fits at a time nor their order changes the winner (ties: the first), and
    a setting that the baseline repeats is fitted once.

    A forest sees only features and target, of which many rows have the same. All rows count, but up to
    ``parts`` of each kind are drawn into a tree's bag one by one, and more of a kind in that many equal parts:
    its weight in a bag then varies by ``1 / sqrt(parts)``, not by ``1 / sqrt(rows)``. With ``parts=None``
    every row is drawn by itself. Equal rows of ``test`` are scored once and count as often as they are there.
    """
    spark = train.sparkSession
    folder = f"{checkpoint_dir(spark).rstrip('/')}/grid-{uuid.uuid4().hex}"
    columns = [*features, target]
    whole = train.select(*columns)
    each = spread(whole.withColumn("_rows", F.lit(1))) if parts is None else alike(whole, parts)
    for part, df in (("train", each), ("test", alike(test.select(*columns)))):
        df.write.parquet(f"{folder}/{part}")
    stored = {part: spark.read.parquet(f"{folder}/{part}") for part in ("train", "test")}

    def score(job: tuple[int, dict]) -> float:
        number, params = job
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"grid-{number % parallel}")
        scored = predict(fit_forest(stored["train"], features, target, params, "_rows"), stored["test"])
        return dec.auc(scored, "lead_score", target, "_rows").first()["auc"] or 0.0

    settings = [dict(zip(grid, combo, strict=True)) for combo in itertools.product(*grid.values())]
    settings.append(dict(baseline or {}))
    full = [{**FOREST, **params} for params in settings]
    different = [params for i, params in enumerate(full) if params not in full[:i]]
    try:
        with ThreadPoolExecutor(parallel) as pool:
            # a thread starts with the caller's local properties and keeps its own pool
            found = list(pool.map(inheritable_thread_target(spark)(score), enumerate(different)))
    finally:
        remove(spark, folder)
    scores = [found[different.index(params)] for params in full]
    base = scores.pop()
    tried = list(zip(settings[:-1], scores, strict=True))
    best, top = max(tried, key=lambda r: r[1])
    return (best if top > base * (1 + min_gain) else dict(baseline or {})), tried


@dataclass
class LeadScorer:
    """Fitted forest with its encoder and threshold bands."""

    model: PipelineModel
    encoder: Encoder
    bands: list[tuple[int, float, float]]

    def prepare(self, raw: DataFrame, keep: tuple[str, ...], mapping: DataFrame | None = None, valid: DataFrame | None = None) -> DataFrame:
        return self.encoder.transform(production_features(raw, keep, mapping, valid), keep)

    def score(self, raw: DataFrame, keep: tuple[str, ...] = ("row_id",), mapping: DataFrame | None = None, valid: DataFrame | None = None) -> DataFrame:
        """Score and decile per row id. Rows are never dropped or re-aligned by position;
        equal leads simply get equal scores."""
        scored = predict(self.model, self.prepare(raw, keep, mapping, valid))
        return dec.assign_deciles(scored.select(*keep, "lead_score"), self.bands)

    def save(self, path: str) -> None:
        """Model, encoder and thresholds under one folder."""
        self.model.write().overwrite().save(f"{path}/model")
        spark = SparkSession.active()
        meta = json.dumps({"encoder": self.encoder.to_json(), "bands": self.bands})
        spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")

    @staticmethod
    def load(path: str) -> LeadScorer:
        spark = SparkSession.active()
        meta = json.loads(spark.read.text(f"{path}/meta").first()["value"])
        bands = [tuple(b) for b in meta["bands"]]
        return LeadScorer(PipelineModel.load(f"{path}/model"), Encoder.from_json(meta["encoder"]), bands)

    def info(self, spark: SparkSession) -> DataFrame:
        """Importances with feature category and rank, one row per feature."""
        groups = {f: g for g, names in feature_categories(self.encoder.contract).items() for f in names}
        rows = [
            (i, f, groups[f], v) for i, (f, v) in enumerate(importances(self.model, self.encoder.contract), 1)
        ]
        return spark.createDataFrame(rows, "rank int, feature string, category string, importance double")


def production_features(
    raw: DataFrame, keep: tuple[str, ...] = ("row_id",), mapping: DataFrame | None = None, valid: DataFrame | None = None
) -> DataFrame:
    """Survey rows to unencoded features: clean columns, unify categories and UTMs, drop
    campaign and technical columns, rename, derive. ``keep`` columns pass through."""
    from .utm import unify_medium, unify_source_term

    df = clean_production_columns(raw).transform(unify_categories)
    df = df.transform(lambda d: unify_source_term(d, "Source", "Term"))
    if mapping is not None:
        df = unify_medium(df, mapping, valid, "Medium")
    df = df.transform(drop_campaign_columns).transform(drop_technical).transform(rename_long)
    return derive_features(df)


def train_scorer(train: DataFrame, test: DataFrame, encoder: Encoder, target: str = "target", params: dict | None = None) -> tuple[LeadScorer, DataFrame]:
    """Fit on ``train``; deciles and thresholds come from ``test``, whose scores are returned.

    Both parts are written once, spread over the cores, and so are the scores: the forest sees each row once.
    """
    features = encoder.contract
    model = fit_forest(stored(spread(align_features(train, features, (target,))), "forest-train"), features, target, params)
    scored = dec.with_qcut(stored(predict(model, spread(test)), "forest-scores"), "lead_score")
    bands = dec.bands(dec.thresholds(scored))
    return LeadScorer(model, encoder, bands), scored


def save_registry(spark: SparkSession, path: str, scorer: LeadScorer, metrics: DataFrame, scored: DataFrame) -> None:
    """Artefacts beside the model: metrics, ordered features, thresholds, test predictions."""
    scorer.save(path)
    metrics.coalesce(1).write.mode("overwrite").json(f"{path}/metrics")
    scorer.info(spark).coalesce(1).write.mode("overwrite").json(f"{path}/features")
    dec.thresholds(scored).coalesce(1).write.mode("overwrite").json(f"{path}/thresholds")
    scored.write.mode("overwrite").parquet(f"{path}/test_predictions")
