"""The corpus pipeline: documents to packed sequences, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet
and reread as the next stage's ``docs``. All but the last keep the columns of ``documents``.
Null texts are empty and go at the first stage; ids may be null or repeated; extra columns
are carried along; an empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from leadspark.llm import exact_dedup, mixing, packing, quality, simhash
from leadspark.llm.common import folder, ready, table

#: Jaccard similarity of five-word shingles from which two texts are near copies.
SIMILARITY = 0.8


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    ready(spark)
    return quality.quality_filter(docs)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays."""
    ready(spark)
    return exact_dedup.exact_dedup(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts with similar five-word shingles the document with the smallest id stays."""
    ready(spark)
    return simhash.near_dedup(docs, SIMILARITY)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as their source's target takes them: never, once or twice."""
    ready(spark)
    return mixing.mix(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their ids, placed in sequences of 1024 tokens."""
    ready(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_rules), ("exact dedup", exact_duplicates), ("near dedup", near_duplicates),
    ("source mix", source_mix), ("packing", packed_sequences),
]
#: The mix draws at random and packing cuts token ids, which SQL cannot state.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every one is written to the shared folder, the last is returned."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = folder(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
