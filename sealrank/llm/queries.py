"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpus_pipeline import ORACLE_SQL as PIPELINE_SQL
from corpus_pipeline import run as run_pipeline
from sealrank.llm import (
    exact, lines, lm, mixing, packing, quality, resampling, rules, sentencepieces, simhash, substrings, token_counts, whitening,
)
from sealrank.llm.tables import prepare

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(fn: Query) -> Query:
    @functools.wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return run


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query
def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


@query
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kept texts themselves are in ``remove_repeats``; the digest stands for them here."""
    return substrings.remove_repeats(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


SQL["op2_substring_dedup"] = substrings.ORACLE_SQL


@query
def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(documents(spark, sf_dir))


@query
def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digests(simhash.near_groups(documents(spark, sf_dir)))


@query
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(documents(spark, sf_dir))


@query
def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source is the host, and a source's language its path."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.classify(documents(spark, sf_dir), labels, "source", "lang")


@query
def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.dedup_exact(documents(spark, sf_dir))


SQL["op7_exact_dedup"] = exact.ORACLE_SQL


@query
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(documents(spark, sf_dir))


SQL["op8_quality_rules"] = rules.ORACLE_SQL


@query
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "source", "text")
    return lines.drop_lines(docs, "source")


SQL["op9_line_dedup"] = lines.ORACLE_SQL


@query
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of all documents, and after masking their personal data."""
    return token_counts.count_after_edits(documents(spark, sf_dir))


@query
def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")


@query
def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    drawn = resampling.resample(documents(spark, sf_dir), target)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


SQL["op12_importance_resampling"] = resampling.ORACLE_SQL


@query
def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.encode(documents(spark, sf_dir), sentencepieces.DIGESTS)


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_pipeline(spark, sf_dir)


if PIPELINE_SQL:
    SQL["pipeline"] = PIPELINE_SQL
