"""Readers with explicit schemas."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sealrank import schemas
from sealrank.functions.text import LOAD_LOG_PATTERN
from sealrank.sources.json_arrays import read_json_arrays


def read_table(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> DataFrame:
    """A table in parquet, JSON lines, ``json_array`` (arrays of objects, read in parallel) or CSV."""
    if fmt == "json_array":
        return read_json_arrays(spark, path, schema)
    reader = spark.read.schema(schema)
    if fmt == "csv":
        return reader.option("header", True).csv(path)
    return reader.format(fmt).load(path)


def read_documents(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return read_table(spark, path, schemas.DOCUMENTS, fmt)


def read_queries(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return read_table(spark, path, schemas.QUERIES, fmt)


def read_qrels(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Judgements; ``fmt="trec"`` reads the four-column text form ``query 0 doc relevance``."""
    if fmt != "trec":
        return read_table(spark, path, schemas.QRELS, fmt)
    part = F.split(F.trim("value"), r"\s+")
    return (
        spark.read.text(path)
        .filter(F.trim("value") != "")
        .select(part[0].alias("query_id"), part[2].alias("doc_id"), part[3].cast("int").alias("relevance"))
    )


def read_doc_embeddings(spark: SparkSession, path: str, fmt: str = "parquet", extra: str = "") -> DataFrame:
    return read_table(spark, path, schemas.DOC_EMBEDDINGS + extra, fmt)


def read_query_embeddings(spark: SparkSession, path: str, fmt: str = "parquet", extra: str = "") -> DataFrame:
    return read_table(spark, path, schemas.QUERY_EMBEDDINGS + extra, fmt)


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A parquet table, or the empty table of that schema where nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], schema)


def read_results(spark: SparkSession, path: str, extra: str = "") -> DataFrame:
    """Ranked results in long form; a query with an empty list is one row without a hit.

    No file: FileNotFoundError; no result: ValueError.
    """
    try:
        nested = spark.read.schema(schemas.RESULTS + extra).json(path)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        raise FileNotFoundError(path) from missing
    if nested.isEmpty():
        raise ValueError("no evaluation results")
    groups = [c for c in nested.columns if c not in ("query_id", "results")]
    return nested.select(*groups, "query_id", F.explode_outer("results").alias("hit")).select(
        *groups, "query_id", "hit.rank", "hit.doc_id", "hit.score"
    )


def parse_load_log(lines: DataFrame) -> DataFrame:
    """``size, count, seconds`` from the lines of a load-time log; other lines are dropped."""
    def field(i: int):
        return F.regexp_extract("value", LOAD_LOG_PATTERN, i)

    return lines.filter(F.col("value").rlike(LOAD_LOG_PATTERN)).select(
        field(1).cast("int").alias("size"),
        field(2).cast("bigint").alias("count"),
        field(3).cast("double").alias("seconds"),
    )


def read_load_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_load_log(spark.read.text(path))
