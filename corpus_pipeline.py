"""Documents to training sequences: quality, language, near duplicates, personal data, packing.

Every stage reads what the one before it has written. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagwright.llm import langid, neardup, packing, pii, quality
from tagwright.llm.common import replace_texts
from tagwright.session import written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose lines reach the quality threshold; the model learns from the labelled documents of ``sf_dir``."""
    field = quality.fit_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, field)


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not rejected."""
    return langid.keep_identified(docs, langid.train(_table(spark, sf_dir, "documents")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five words, similarity of 0.8 or more."""
    return neardup.drop_near_duplicates(docs, settings=neardup.NearSettings.at_80())


def mask_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind in brackets; ``n_chars`` follows the text."""
    field = pii.fit_field(docs)
    masked = replace_texts(docs, "text", lambda: lambda text: pii.masked(text, pii.all_spans(text, field)[1]))
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: one row per piece of a document."""
    return packing.pack(docs)


STAGES = [
    ("quality", keep_quality),
    ("language", keep_language),
    ("near_duplicates", drop_copies),
    ("personal_data", mask_personal),
    ("packing", pack_sequences),
]

# models, sketches and token ids cannot be said in SQL; tests compare with a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written and read again."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
