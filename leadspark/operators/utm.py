"""UTM column unification and campaign-name consolidation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..functions import utm as u
from ..functions.text import comparison_form
from .joins import left_lookup


def unify_source(df: DataFrame, column: str = "source", training: bool = False) -> DataFrame:
    minor = u.MINOR_SOURCES_TRAINING if training else u.MINOR_SOURCES
    return df.withColumn(column, u.unified_source(F.col(column), minor)) if column in df.columns else df


def unify_term(df: DataFrame, column: str = "term") -> DataFrame:
    return df.withColumn(column, u.unified_term(F.col(column))) if column in df.columns else df


def unify_source_term(df: DataFrame, source: str = "source", term: str = "term", training: bool = False) -> DataFrame:
    return df.transform(unify_source, source, training).transform(unify_term, term)


def _best_spellings(counts: DataFrame) -> DataFrame:
    """``(value, spelling)`` from ``(value, n)``: the most frequent value of the same normal
    form; equally frequent ones resolve to the first in text order."""
    formed = counts.withColumn("form", comparison_form(F.col("value")))
    best = formed.groupBy("form").agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("spelling"))
    return formed.join(best, "form").select("value", "spelling")


def _counts(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def common_spellings(df: DataFrame, column: str) -> DataFrame:
    """``(value, spelling)`` of the values that have a more frequent spelling."""
    return _best_spellings(_counts(df, column)).filter("value <> spelling")


def _replace(df: DataFrame, column: str, table: DataFrame) -> DataFrame:
    """Values replaced by ``table(__value, __new)``, where it has them."""
    return left_lookup(df, table, column, "__value").withColumn(column, F.coalesce("__new", column)).drop("__new")


def merge_spellings(df: DataFrame, column: str) -> DataFrame:
    """Replace every spelling by the most frequent one of the same normal form."""
    return _replace(df, column, common_spellings(df, column).select(F.col("value").alias("__value"), F.col("spelling").alias("__new")))


def extract_audience(df: DataFrame, column: str = "medium") -> DataFrame:
    """Audience part of the medium, spellings merged, ``ABERTO`` written ``Aberto``.

    All of it is worked out on the distinct values; the rows only look their value up.
    """
    if column not in df.columns:
        return df
    raw = _counts(df, column).withColumn("audience", u.medium_audience(F.col("value")))
    merged = _best_spellings(raw.groupBy(F.col("audience").alias("value")).agg(F.sum("n").alias("n")))
    merged = merged.select(F.col("value").alias("audience"), F.when(F.col("spelling") == "ABERTO", "Aberto").otherwise(F.col("spelling")).alias("__new"))
    return _replace(df, column, raw.join(merged, "audience").select(F.col("value").alias("__value"), "__new"))


def map_categories(
    df: DataFrame, column: str, mapping: DataFrame, valid: DataFrame | None = None, default: str = "Outros"
) -> DataFrame:
    """Mapped category, else the value itself when valid, else ``default``; null stays null.

    ``mapping`` has ``value, category``; ``valid`` has ``category``. The text ``nan`` is null.
    """
    table = mapping.select("value", "category")
    if valid is not None:
        kept = valid.select(F.col("category").alias("value"), "category")
        table = table.unionByName(kept.join(table.select("value"), "value", "left_anti"))
    table = table.dropDuplicates(["value"]).withColumnsRenamed(
        {"value": "__value", "category": "__category"}
    )
    cleaned = df.withColumn(column, F.when(F.lower(column) != "nan", F.col(column)))
    found = F.coalesce(F.col("__category"), F.when(F.col(column).isNotNull(), default))
    return left_lookup(cleaned, table, column, "__value").withColumn(column, found).drop("__category")


def unify_medium(df: DataFrame, mapping: DataFrame, valid: DataFrame | None = None, column: str = "medium") -> DataFrame:
    return df.transform(extract_audience, column).transform(
        lambda d: map_categories(d, column, mapping, valid) if column in d.columns else d
    )


def longest_names(df: DataFrame, column: str = "campaign") -> DataFrame:
    """Per campaign id: the longest name seen (ties: first in text order), and its base form."""
    names = df.select(F.col(column).alias("name")).distinct()
    names = names.withColumn("id", u.campaign_id(F.col("name"))).filter("id IS NOT NULL")
    return names.groupBy("id").agg(F.min_by("name", F.struct(-F.length("name"), F.col("name"))).alias("best_name"))


def consolidate_campaigns(df: DataFrame, column: str = "campaign", to: str = "campaign_consolidated") -> DataFrame:
    """One name per campaign: by full id, else by 15-digit prefix, else by base name.

    Names without an id take the name of the id-bearing campaign with the same base name.
    Works on the distinct names; each window holds the spellings of one campaign, and
    names without the key in question are spread over groups of their own.
    """
    name, cid = F.col("name"), F.col("id")
    names = df.select(F.col(column).alias("name")).filter("name IS NOT NULL").distinct()
    names = names.withColumn("id", u.campaign_id(name)).withColumn("prefix", F.substr("id", F.lit(1), F.lit(15)))
    names = names.withColumn("base", F.when(u.campaign_base(name) != "", u.campaign_base(name)))

    def group(key: str):
        return Window.partitionBy(F.coalesce(F.col(key), F.concat(F.lit("\u0000"), name)))

    longest = lambda c: F.struct(-F.length(c), F.col(c))
    known = cid.isNotNull()
    names = names.withColumn("by_id", F.when(known, F.min_by("name", longest("name")).over(group("id"))))
    names = names.withColumn("by_prefix", F.when(known, F.min_by("by_id", longest("id")).over(group("prefix"))))
    names = names.withColumn("by_base", F.min_by("by_id", F.when(known, longest("by_id"))).over(group("base")))
    # ids shorter than the full 18 digits are cut ones, so the prefix decides for them
    whole = F.when(F.length("id") >= 18, F.col("by_id"))
    table = names.select(name.alias("__name"), F.coalesce(whole, "by_prefix", "by_base", "name").alias(to))
    return left_lookup(df, table, column, "__name")


def classify(df: DataFrame, column: str = "campaign", settings: Settings = DEFAULTS) -> DataFrame:
    """Add ``ml_type`` and drop campaigns outside acquisition."""
    return with_class(df, column, settings).filter("ml_type <> 'EXCLUIR'")


def with_class(df: DataFrame, column: str = "campaign", settings: Settings = DEFAULTS) -> DataFrame:
    return df.withColumn("ml_type", u.campaign_class(F.col(column), settings))


def class_counts(df: DataFrame, column: str = "campaign", settings: Settings = DEFAULTS) -> DataFrame:
    """Kept and excluded leads, with the share of each kept class in percent."""
    kind = F.col("ml_type")
    kept = F.count_if(kind != "EXCLUIR")
    share = lambda k: F.coalesce(F.try_divide(F.count_if(kind == k) * 100.0, kept), F.lit(0.0))
    return with_class(df, column, settings).agg(
        kept.alias("kept"), F.count_if(kind == "EXCLUIR").alias("excluded"),
        F.count_if(kind == "COM_ML").alias("com_ml"), F.count_if(kind == "SEM_ML").alias("sem_ml"),
        share("COM_ML").alias("com_ml_pct"), share("SEM_ML").alias("sem_ml_pct"),
    )


def with_event_class(df: DataFrame, goal: str = "optimization_goal", settings: Settings = DEFAULTS) -> DataFrame:
    known = F.col(goal) if goal in df.columns else F.lit(None).cast("string")
    return df.withColumn("capi_type", u.event_class(known, settings))


def event_class_counts(df: DataFrame, goal: str = "optimization_goal") -> DataFrame:
    kind = F.col("capi_type")
    share = lambda k: F.coalesce(F.try_divide(F.count_if(kind == k) * 100.0, F.count("*")), F.lit(0.0))
    return with_event_class(df, goal).agg(
        F.count("*").alias("total"), F.count_if(kind == "COM_CAPI").alias("com_capi"),
        F.count_if(kind == "SEM_CAPI").alias("sem_capi"),
        share("COM_CAPI").alias("com_capi_pct"), share("SEM_CAPI").alias("sem_capi_pct"),
    )


def campaign_list(df: DataFrame, ml_type: str | None = None, column: str = "campaign") -> DataFrame:
    kept = df.filter(F.col(column).isNotNull())
    if ml_type is not None:
        kept = kept.filter(F.col("ml_type") == ml_type)
    return kept.select(column).distinct().orderBy(column)


def name_ids(df: DataFrame, dimension: DataFrame, column: str = "campaign") -> DataFrame:
    """Replace bare numeric campaign ids by the name in ``dimension(campaign_id, campaign_name)``."""
    keyed = df.withColumn("__id", F.when(u.is_numeric_id(F.col(column)), F.trim(column)))
    table = dimension.select("campaign_id", F.col("campaign_name").alias("__name")).dropDuplicates(["campaign_id"])
    named = left_lookup(keyed, table, "__id", "campaign_id")
    return named.withColumn(column, F.coalesce("__name", column)).drop("__id", "__name")
