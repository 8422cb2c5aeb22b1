"""The registered queries of the numbered operators and their SQL. Each reads its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, bpe, exact, hamming, langid, neardup, packing, pii, quality, runs, sitetree, urlvocab, wordrules
from .common import crc_mod

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_semi_markov_pii")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return pii.find_spans(documents, pii.fit_field(documents))


@query("op2_line_crf_quality")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    field = quality.fit_quality(documents, table(spark, folder, "labels"))
    scored = quality.score_documents(documents, field)
    return scored.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


@query("op3_subword_language")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    found = langid.identify(documents, langid.train(documents))
    return found.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "rejected")


@query("op4_multi_index_hashing", hamming.search_sql())
def op4(spark: SparkSession, folder: str) -> DataFrame:
    codes = hamming.sign_codes(table(spark, folder, "embeddings"))
    return hamming.top_k(codes, codes.where(F.col("id") % 50 == 0))


@query("op5_site_style_tree")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return sitetree.extract(table(spark, folder, "pages"))


@query("op6_url_vocabulary", urlvocab.verdict_sql())
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return urlvocab.judge_urls(table(spark, folder, "pages"))


@query("op7_quality_rules")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return wordrules.judge(documents, wordrules.train(documents, table(spark, folder, "labels")))


@query("op8_cost_balanced_packing")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"))


@query("op9_fast_similarity_sketch")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, folder, "documents"))


@query("op10_bpe_automaton")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode_digests(table(spark, folder, "documents"))


@query("op11_shared_cut_alignment")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return align.align_documents(table(spark, folder, "documents"))


@query("op12_block_naming", exact.groups_sql())
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return exact.exact_groups(table(spark, folder, "documents"))


@query("op13_suffix_automaton_runs")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return runs.find_runs(runs.with_periods(table(spark, folder, "documents")))
