"""The corpus pipeline: documents to packed training sequences, in five stages that each keep all that the one before kept.

Every stage takes (spark, docs, sf_dir) with the columns of `documents` and gives the same columns; the last gives packed pieces. Documents
that the quality rules reject go; one document of each near-duplicate class stays; repeated 200-byte strings are cut out of the texts;
private data is replaced; what is left is tokenised, cut and packed. n_chars follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from momentis.llm import near_dedup, packing, pii_surrogates, quality_rules, suffix_dedup
from momentis.llm.common import Scope, materialize

_scopes: list[Scope] = []


def _after(docs: DataFrame) -> None:
    """Delete what the stage before has written for itself: its result has been written by now, as docs is read from there."""
    while _scopes:
        _scopes.pop().close(docs)


def _measured(docs: DataFrame, like: DataFrame) -> DataFrame:
    """docs with the columns of `like` in their order and the texts' new lengths."""
    if "n_chars" in like.columns:
        docs = docs.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(like.schema["n_chars"].dataType))
    return docs.select(*like.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _scopes.clear()
    with Scope(docs) as own:
        kept = quality_rules.keep_good(docs)
    _scopes.append(own)
    return kept


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _after(docs)
    with Scope(docs) as own:
        kept = near_dedup.keep_first(docs)
    _scopes.append(own)
    return kept


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _after(docs)
    with Scope(docs) as own:
        cut = suffix_dedup.remove_repeats(docs)
    _scopes.append(own)
    return _measured(cut, docs)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _after(docs)
    return _measured(pii_surrogates.replace_private(docs), docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _after(docs)
    return packing.packed(docs)


STAGES = [
    ("op3 quality rules", quality),
    ("op8 near-duplicates", near_duplicates),
    ("op6 repeated strings", repeats),
    ("op9 private data", private_data),
    ("op4 packing", sequences),
]

#: SQL expresses neither consistent sampling nor byte spans nor tokenisers; tests hold the pipeline against plain loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written to the shared folder before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
