"""Sinks: embeddings, ranked results, NDCG reports, id dumps, metrics and the load log."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sealrank import schemas
from sealrank.functions.text import LOAD_LOG_HEADER, load_line, run_at, six_places
from sealrank.sources.readers import read_or_empty


def sized_path(pattern: str, size: int) -> str:
    """``doc_embeddings_{size}.json`` for one sample size."""
    return pattern.format(size=size)


def query_path(doc_path: str) -> str:
    """The query file that belongs to a document file."""
    return doc_path.replace("doc_", "query_")


def write_embeddings(df: DataFrame, path: str, partition_by: str | None = None, fmt: str = "parquet") -> None:
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.format(fmt).save(path)


def write_json_arrays(lines: DataFrame, path: str) -> None:
    """JSON lines (``value``) as arrays, one per file and task; ``json_array`` reads them."""
    def bracket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = "["
        for batch in batches:
            if batch.num_rows:
                values = batch.column("value").cast(pa.string())
                leads = pa.array([lead] + [","] * (batch.num_rows - 1))
                lead = ","
                yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(leads, values, "")], ["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["[]" if lead == "[" else "]"])], ["value"])

    lines.mapInArrow(bracket, "value string").write.mode("overwrite").text(path)


def nest_results(hits: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """One row per query with its hits in rank order; a list holds at most k hits.

    ``asked`` has the columns that name a list, one row per list; those without a hit are empty.
    """
    keys = [*[c for c in ("backend", "sample_size") if c in hits.columns], "query_id"]
    nested = hits.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "score"))).alias("results"))
    if asked is None:
        return nested
    every = asked.select(*[F.col(c).cast(hits.schema[c].dataType).alias(c) for c in keys]).distinct()
    none = F.array().cast(nested.schema["results"].dataType)
    return every.join(nested, keys, "left").withColumn("results", F.coalesce("results", none))


def write_results(hits: DataFrame, path: str, asked: DataFrame | None = None) -> None:
    """Nested JSON, in one folder per backend and sample size, so that no run overwrites
    the results of another backend. With ``asked``, queries without a hit are written too."""
    groups = [c for c in ("backend", "sample_size") if c in hits.columns]
    nest_results(hits, asked).write.mode("overwrite").partitionBy(*groups).json(path)


def ndcg_csv(report: DataFrame, k: int) -> DataFrame:
    """The report as text: relevances as a list, a dash per place in the AVERAGE row, and
    six decimals."""
    groups = [c for c in ("backend", "sample_size") if c in report.columns]
    dashes = "[" + ", ".join(["'-'"] * k) + "]"
    listed = F.concat(F.lit("["), F.array_join(F.col("rels").cast("array<string>"), ", "), F.lit("]"))
    return report.select(
        *groups,
        "query_id",
        F.when(F.col("rels").isNull(), F.lit(dashes)).otherwise(listed).alias("rels"),
        six_places(F.col("ndcg")).alias(f"NDCG@{k}"),
    )


def write_ndcg(report: DataFrame, path: str, k: int) -> None:
    groups = [c for c in ("backend", "sample_size") if c in report.columns]
    writer = ndcg_csv(report, k).write.mode("overwrite").option("header", True)
    (writer.partitionBy(*groups) if groups else writer).csv(path)


def write_ids(ids: DataFrame, path: str) -> None:
    ids.write.mode("overwrite").json(path)


def append_metrics(
    spark: SparkSession, path: str, backend: str, sample_size: int | None, values: dict[str, float]
) -> None:
    """Add one row per metric; nothing is overwritten and the latest value wins on read."""
    append_all_metrics(spark, path, {(backend, sample_size): values})


def append_all_metrics(spark: SparkSession, path: str, found: dict[tuple[str, int | None], dict[str, float]]) -> None:
    """``append_metrics`` of several backends and sample sizes in one write."""
    rows = [(backend, size, name, float(value)) for (backend, size), values in found.items() for name, value in values.items()]
    frame = spark.createDataFrame(rows, "backend STRING, sample_size INT, metric STRING, value DOUBLE")
    frame.withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(path)


def latest_metrics(spark: SparkSession, path: str) -> DataFrame:
    return (
        read_or_empty(spark, path, schemas.RUN_METRICS)
        .groupBy("backend", "sample_size", "metric")
        .agg(F.max_by("value", "at").alias("value"), F.max("at").alias("at"))
        .withColumn("last_run_at", run_at(F.col("at")))
    )


def load_log_lines(loads: DataFrame) -> DataFrame:
    """``size, count, seconds`` as log lines."""
    return loads.select(load_line(F.col("size"), F.col("count"), F.col("seconds")).alias("value"))


def append_load_log(loads: DataFrame, path: str, start: bool = False) -> None:
    """Append log lines; ``start`` begins a new log with its header."""
    lines = load_log_lines(loads)
    if start:
        header = loads.sparkSession.createDataFrame([(LOAD_LOG_HEADER,)], "value STRING")
        lines = header.union(lines).coalesce(1)
    lines.write.mode("overwrite" if start else "append").text(path)
