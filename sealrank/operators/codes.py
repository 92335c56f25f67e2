"""Product-quantised codes: a scan of a few bytes per vector, then exact scores of the survivors.

The dimensions are cut into sub-spaces, each with a codebook of at most 256 words, and a vector's code is
the nearest word of each. A query has a table of its inner products with all words, so its approximate score
with a vector is a sum of looked-up numbers, one per sub-space. The scan reads ids and codes only; the best
``survivors`` of each query then meet their vectors by id and are scored exactly.

Words are the parts of sampled vectors, or with ``rounds`` those of that many rounds of k-means on
a sample of ``FIT_ROWS`` vectors; codes are made for every vector. Ids must be unique, equal scores rank
by id, and a zero vector scores 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sealrank.functions import arrow
from sealrank.functions.vectors import widen
from sealrank.operators.best import BestHits
from sealrank.operators.cells import pick_centroids
from sealrank.operators.packing import pack_vectors
from sealrank.operators.search import QUERY_ROWS, QueryBlock, emit, hit_fields, in_blocks, no_hits, query_block, rank_hits
from sealrank.operators.selection import hash_rank, smallest
from sealrank.session import materialize

MOST_WORDS = 256
FIT_ROWS = 20_000
LOOKUPS_AT_ONCE = 1 << 22


def codebooks(vectors: DataFrame, n_parts: int, n_words: int, rounds: int = 0, seed: int = 42) -> np.ndarray:
    """``parts x words x width/parts`` from packed unit ``vector``s; at most ``FIT_ROWS`` of them are fetched."""
    sampled = pick_centroids(vectors, n_words, seed)
    if sampled.shape[1] % n_parts:
        raise ValueError(f"{sampled.shape[1]} dimensions cannot be cut into {n_parts} equal parts")
    books = sampled.reshape(len(sampled), n_parts, -1).transpose(1, 0, 2).copy()
    if rounds == 0 or len(sampled) == 0:
        return books
    ranked = vectors.withColumn("order", hash_rank(F.col("doc_id"), seed))
    points = arrow.as_matrix(smallest(ranked, "order", "doc_id", FIT_ROWS).orderBy("doc_id").select("vector").toArrow()["vector"])
    parts = points.reshape(len(points), n_parts, -1)
    for _ in range(rounds):
        for part, book in enumerate(books):
            own = nearest_words(parts[:, part], book)
            sums = np.zeros_like(book)
            np.add.at(sums, own, parts[:, part])
            counts = np.bincount(own, minlength=len(book))
            held = counts > 0
            book[held] = sums[held] / counts[held, None]
    return books


def nearest_words(points: np.ndarray, book: np.ndarray) -> np.ndarray:
    """The nearest word of each point, the first of equals."""
    apart = (points**2).sum(axis=1)[:, None] - 2 * points @ book.T + (book**2).sum(axis=1)[None, :]
    return np.argmin(np.round(apart, 12), axis=1)


def encode(points: np.ndarray, books: np.ndarray) -> np.ndarray:
    """A byte per part of each point."""
    parts = points.reshape(len(points), len(books), -1)
    return np.stack([nearest_words(parts[:, p], book) for p, book in enumerate(books)], axis=1).astype(np.uint8)


def build_codes(docs: DataFrame, path: str, n_parts: int = 8, n_words: int = MOST_WORDS, rounds: int = 0, seed: int = 42) -> None:
    """Write ``doc_id``, ``code`` and ``vector`` of all ``docs``, and the codebooks, to ``path``."""
    if not 1 <= n_words <= MOST_WORDS:
        raise ValueError(f"from 1 to {MOST_WORDS} words to a codebook")
    spark = docs.sparkSession
    vectors = materialize(pack_vectors(docs.select("doc_id", widen(F.col("embedding")).alias("embedding"))), "vectors")
    if not vectors.groupBy("doc_id").count().filter("count > 1").isEmpty():
        raise ValueError("doc_id is not unique")
    books = codebooks(vectors, n_parts, n_words, rounds, seed)
    sent = spark.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                points = arrow.as_matrix(batch.column("vector"), books.shape[0] * books.shape[2])
                yield arrow.replace_columns(batch, (), code=arrow.packed_column(encode(points, sent.value)))

    vectors.mapInArrow(run, T.StructType([*vectors.schema, T.StructField("code", T.BinaryType())])).write.parquet(f"{path}/vectors")
    flat = arrow.packed_column(books.reshape(books.shape[0], -1))
    table = pa.table({"part": pa.array(np.arange(len(books), dtype=np.int32)), "words": pa.array([books.shape[1]] * len(books), pa.int32()), "book": flat})
    spark.createDataFrame(table).coalesce(1).write.parquet(f"{path}/books")


def read_books(spark: SparkSession, path: str) -> np.ndarray:
    rows = spark.read.parquet(f"{path}/books").orderBy("part").collect()
    return np.stack([np.frombuffer(r["book"], "<f8").reshape(r["words"], -1) for r in rows])


def _survivors(block: QueryBlock, codes: DataFrame, books: np.ndarray, n: int) -> DataFrame:
    """The ``n`` best of each query by approximate score, of every scan task."""
    n_parts, n_words = books.shape[:2]
    parts = block.matrix.reshape(len(block), n_parts, -1)
    tables = np.einsum("qpd,pwd->qpw", parts, books).reshape(len(block), n_parts * n_words)
    schema = hit_fields(codes, codes.sparkSession.createDataFrame(pa.table({"query_id": block.ids.slice(0, 0)})).schema["query_id"].dataType, None)
    sent = codes.sparkSession.sparkContext.broadcast((block.ids, tables))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, looked = sent.value
        best, offsets = BestHits(len(ids), n), np.arange(n_parts) * n_words
        step = max(1, LOOKUPS_AT_ONCE // (n_parts * max(1, len(ids))))
        everyone = np.arange(len(ids))
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(-1, n_parts)
                scores = np.zeros((len(ids), len(code)))
                for part in range(n_parts):
                    scores += looked[:, code[:, part] + offsets[part]]
                best.offer(scores, everyone, batch.column("doc_id"))
        yield from emit(best, ids, None, False)

    return codes.select("doc_id", "code").mapInArrow(run, schema)


def _exact(block: QueryBlock, candidates: DataFrame, k: int) -> DataFrame:
    """Exact scores of ``query_id, doc_id, vector`` in tasks that know the queries."""
    schema = T.StructType([f for f in candidates.schema if f.name != "vector"]).add("score", T.DoubleType())
    sent = candidates.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {q: i for i, q in enumerate(sent.value.ids.to_pylist())}
        for batch in batches:
            if batch.num_rows:
                asked = sent.value.matrix[[place[q] for q in batch.column("query_id").to_pylist()]]
                found = arrow.as_matrix(batch.column("vector"), asked.shape[1])
                score = np.round(np.einsum("ij,ij->i", asked, found), 12)
                yield arrow.replace_columns(batch, ("vector",), score=pa.array(score))

    return rank_hits(candidates.mapInArrow(run, schema), k)


def search_codes(queries: DataFrame, path: str, k: int = 5, survivors: int = 100, query_rows: int = QUERY_ROWS) -> DataFrame:
    """Top-k of the ``survivors`` best vectors by code: ``query_id, rank, doc_id, score``."""
    spark = queries.sparkSession
    books, rows = read_books(spark, path), spark.read.parquet(f"{path}/vectors")

    def answer(block: QueryBlock) -> DataFrame:
        kept = rank_hits(_survivors(block, rows, books, survivors), survivors).select("query_id", "doc_id")
        return _exact(block, kept.join(rows.select("doc_id", "vector"), "doc_id").select("query_id", "doc_id", "vector"), k)

    whole = query_block(queries, query_rows)
    if whole is not None:
        return answer(whole) if len(whole) else no_hits(queries, rows)
    if not queries.groupBy("query_id").count().filter("count > 1").isEmpty():
        raise ValueError("query_id is not unique")
    return in_blocks(queries, answer, query_rows)
