"""Continuous ingest, upsert and search with Structured Streaming.

Each micro-batch is one batch job whose output folder is named after the batch, so a batch that runs
again after a failure replaces what it wrote before. Only the upsert keeps state: the newest row per document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sealrank.operators.search import search
from sealrank.plans.pipeline import evaluate_sealed
from sealrank.sources.stores import PlainStore, SealedStore


CATCH_UP = {"availableNow": True}


def read_stream(spark: SparkSession, path: str, schema: str, pattern: str = "*.parquet", files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def table_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stream of a Parquet table that is one file or a folder of part files."""
    folder, _, name = path.rstrip("/").rpartition("/")
    # A glob of one name; Spark takes a path without one for a folder.
    return read_stream(spark, f"{folder}/{{{name}}}", schema)


def ingest_stream(vectors: DataFrame, store: PlainStore | SealedStore, checkpoint: str, name: str = "stream", trigger: dict | None = None) -> StreamingQuery:
    """Append a stream of ``doc_id, embedding[, content]`` to a store.

    ``name`` goes into the batch folders; streams that share a store need different ones.
    ``trigger`` takes the arguments of ``DataStreamWriter.trigger``, for example
    ``{"processingTime": "1 minute"}``; without it the stream ends when it has caught up.
    """
    def add(rows: DataFrame, batch_id: int) -> None:
        store.add(rows, batch=f"{name}-{batch_id}")

    return (
        vectors.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or CATCH_UP)).start()
    )


def upsert_stream(vectors: DataFrame, store: SealedStore, checkpoint: str, name: str = "upsert", trigger: dict | None = None) -> StreamingQuery:
    """Keep the newest version of each document of a stream of ``doc_id, version, embedding[, content]``.

    The state holds the row of the highest version per document, so a row that comes late, with a lower
    version than one before, changes nothing: its document is written again as it was. Of equal versions the one
    with the greater hash of its content wins, whatever the order, so replayed rows change nothing either. Rows
    without a version count as version 0. ``store.latest`` reads the result. State grows with the documents.
    """
    others = [c for c in vectors.columns if c not in ("doc_id", "version")]
    version = F.coalesce(F.col("version").cast("bigint"), F.lit(0)).alias("version")
    row = F.struct(version, *others)
    rank = F.struct(version, F.xxhash64(*others))
    newest = vectors.groupBy("doc_id").agg(F.max_by(row, rank).alias("row")).select("doc_id", "row.*")

    def add(rows: DataFrame, batch_id: int) -> None:
        store.add(rows, batch=f"{name}-{batch_id}")

    return (
        newest.writeStream.outputMode("update").foreachBatch(add).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or CATCH_UP)).start()
    )


def once_each(queries: DataFrame) -> DataFrame:
    """One row per ``query_id``, that of the least hash of its vector: a query that is asked again in a batch, or
    replayed, gets one answer."""
    least = F.min(F.struct(F.xxhash64("embedding").alias("hash"), "embedding"))
    return queries.groupBy("query_id").agg(least.alias("row")).select("query_id", "row.embedding")


def search_stream(
    queries: DataFrame, store: PlainStore | SealedStore, k: int, path: str, checkpoint: str, trigger: dict | None = None,
    latest: bool = False, lenient: bool = False,
) -> StreamingQuery:
    """Answer a stream of ``query_id, embedding`` from a store; hits go to ``path``. ``latest`` searches the last version of
    each document and ``lenient`` names ids that do not open by their raw form, both of a sealed store."""
    def answer(rows: DataFrame, batch_id: int) -> None:
        asked = once_each(rows)
        if isinstance(store, SealedStore):
            hits = evaluate_sealed(asked, store, k, lenient=lenient, latest=latest)
        else:
            hits = search(asked, store.vectors(), k)
        hits.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (
        queries.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or CATCH_UP)).start()
    )
