"""The benchmark from corpus to report: prepare, load, ingest, evaluate, compare.

All sample sizes run in one job. Samples are nested, so every vector is embedded, stored
and scored once with the smallest sample that holds it, and counts for all larger ones.
"""

from __future__ import annotations

import logging
import math
import time
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sealrank import schemas
from sealrank.functions.text import content
from sealrank.operators.cells import CENTROIDS, build_cells, search_cells
from sealrank.operators.embedding import deal_out
from sealrank.operators.evaluation import judge, ndcg_report
from sealrank.operators.sampling import corpus_counts, sample_documents
from sealrank.operators.search import as_distance, rank_hits, search
from sealrank.operators.selection import first_rows, hash_rank, smallest
from sealrank.session import materialize
from sealrank.sources.readers import read_or_empty, read_results, read_table
from sealrank.sources.stores import PlainStore, SealedStore
from sealrank.sources.writers import append_all_metrics, append_load_log, append_metrics, write_embeddings, write_ids, write_ndcg, write_results

LOG = logging.getLogger(__name__)
Embed = Callable[[DataFrame, str], DataFrame]
# Cells of the benchmark's index where the caller names no number.
MOST_CELLS = 4096
# Where the caller names no number of probes: the recall to reach, on so many queries at most.
RECALL, RECALL_QUERIES = 0.9, 500


def prepare_corpus(
    docs: DataFrame, queries: DataFrame, qrels: DataFrame, sizes: list[int], embed: Embed, path: str, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """Sample the corpus around the judged documents, embed it and the queries, and save
    both. ``embed(df, text_column)`` adds ``embedding`` and ``embed_time``.

    The sampled documents are written and dealt out before they are embedded, since a sample
    leaves the splits of the corpus uneven. ``doc_pos`` and ``query_pos`` are kept where the
    tables have them; without a position the order is that of the ids. The documents and judgements there are
    go to the log before anything else, and to ``path``/counts.
    """
    spark = docs.sparkSession
    n_docs, n_qrels = corpus_counts(docs, qrels)
    LOG.info("%d documents, %d judgements", n_docs, n_qrels)
    append_metrics(spark, f"{path}/counts", "corpus", n_docs, {"n_docs": n_docs, "n_qrels": n_qrels})
    chosen = sample_documents(docs, qrels, sizes, seed).select(
        F.col("doc_id").cast("string").alias("doc_id"),
        content(F.col("title"), F.col("text")).alias("content"),
        _position(docs, "doc_pos"),
        "first_size",
    )
    write_embeddings(embed(deal_out(materialize(chosen, "chosen")), "content"), f"{path}/doc_embeddings", "first_size")
    asked = queries.select(F.col("query_id").cast("string").alias("query_id"), "text", _position(queries, "query_pos"))
    write_embeddings(embed(asked, "text"), f"{path}/query_embeddings")
    return (
        read_table(spark, f"{path}/doc_embeddings", schemas.DOC_EMBEDDINGS + ", first_size INT"),
        read_table(spark, f"{path}/query_embeddings", schemas.QUERY_EMBEDDINGS),
    )


def _position(df: DataFrame, name: str) -> Column:
    return (F.col(name) if name in df.columns else F.lit(None)).cast("bigint").alias(name)


def sizes_of(vectors: DataFrame) -> list[int]:
    """The sample sizes a table of vectors was made for; a handful of them."""
    return sorted(r[0] for r in vectors.select("first_size").distinct().collect() if r[0] is not None)


def load_plain(embeddings: DataFrame, store: PlainStore, log: str | None = None, sizes: list[int] | None = None) -> float:
    """Append all embeddings to the plain store in one job; returns the seconds taken.

    The log gets one line per sample size with the documents of that sample and their share of the seconds, or
    one line for the whole where there are no sample sizes. Rows are counted while they are written.
    """
    if log and sizes is None:
        sizes = sizes_of(embeddings) if "first_size" in embeddings.columns else []
    loaded = store.load(embeddings, sizes or [])
    if log:
        found = loaded.by_size or {int(loaded.whole["n_docs"]): loaded.whole}
        lines = [(size, int(own["n_docs"]), own["wall_clock_time"]) for size, own in sorted(found.items())]
        loads = store.spark.createDataFrame(lines, "size INT, count BIGINT, seconds DOUBLE")
        append_load_log(loads.coalesce(1), log, start=True)
    return loaded.seconds


def ingest_sealed(
    embeddings: DataFrame, store: SealedStore, n: int | None = None, position: str = "doc_pos", metrics: str | None = None,
    sizes: list[int] | None = None, observed: str | None = None,
) -> bool:
    """Seal the first n documents into an empty store; a store that has rows is left as it
    is and False returned. Per sample size, or else for all documents, ``metrics`` gets ``total_time``, the seconds that
    the documents took their tasks, and ``wall_clock_time``; ``observed`` gets ``n_docs`` and the sum of ``embed_time``. All
    of it is observed by the job that writes."""
    if not store.is_empty():
        return False
    start = time.perf_counter()
    if n is not None:
        embeddings = first_rows(embeddings.withColumn(position, _position(embeddings, position)), position, "doc_id", n)
    before = time.perf_counter()
    loaded = store.load(embeddings, sizes or [])
    found = loaded.by_size or {int(loaded.whole["n_docs"]): loaded.whole}
    if metrics:
        walls = {size: own["wall_clock_time"] * (1 + (before - start) / loaded.seconds) for size, own in found.items()}
        append_all_metrics(store.spark, metrics, {
            ("sealed", size): {"total_time": own["total_time"], "wall_clock_time": walls[size]} for size, own in found.items()
        })
    if observed:
        append_all_metrics(store.spark, observed, {
            ("sealed", size): {c: own[c] for c in ("n_docs", "embed_time") if c in own} for size, own in found.items()
        })
    return True


def first_queries(queries: DataFrame, limit: int | None) -> DataFrame:
    """The first queries by ``query_pos``, or by id without it: None is all of them, 0 none."""
    if limit is None:
        return queries
    placed = queries.withColumn("query_pos", _position(queries, "query_pos"))
    return first_rows(placed, "query_pos", "query_id", limit).select(queries.columns)


def evaluate_plain(
    queries: DataFrame, store: PlainStore, k: int = 5, sizes: list[int] | None = None, limit: int | None = None
) -> DataFrame:
    """Ranked hits of the plain store; the score is the cosine distance."""
    return as_distance(search(first_queries(queries, limit), store.vectors(), k, sizes))


def evaluate_sealed(
    queries: DataFrame, store: SealedStore, k: int = 5, sizes: list[int] | None = None, limit: int | None = None,
    lenient: bool = False, latest: bool = False, texts: bool = False,
) -> DataFrame:
    """Ranked hits of the sealed store; the score is the cosine similarity. ``texts`` adds the ``content`` of each hit.

    The search knows rows by their keys; ids and texts are opened for the final hits only. Equal scores rank by
    opened id. Where hits beyond the k-th tie with it, which of them count depends on ids that are still sealed: such
    queries, and no others, are searched again with ids opened in the scan.

    ``lenient`` names an id that does not open by its raw form; ``latest`` searches the last version of each
    document only."""
    rows = store.latest() if latest else store.read()
    asked = first_queries(queries, limit)
    keys = ["query_id", *(["sample_size"] if sizes else [])]
    hits = materialize(search(asked, store.keyed_vectors(rows), k + 1, sizes), "keyed-hits")
    at = lambda rank: F.max(F.when(F.col("rank") == rank, F.col("score")))
    tied = materialize(hits.groupBy(*keys).agg(at(k).alias("last"), at(k + 1).alias("beyond")).filter("last = beyond").select(*keys), "tied")
    hits = hits.filter(F.col("rank") <= k)
    if not tied.isEmpty():
        again = asked.join(tied.select("query_id").distinct(), "query_id", "left_semi")
        named = search(again, store.named_vectors(rows, lenient), k, sizes).join(tied, keys, "left_semi")
        named = named.withColumn("doc_id", F.substring_index("doc_id", "\0", -1)).select(hits.columns)
        hits = materialize(hits.join(tied, keys, "left_anti").unionByName(named), "keyed-hits")
    opened = rank_hits(store.open_hits(hits, rows, lenient), k)
    return opened if texts else opened.drop("content")


def evaluate_cells(
    queries: DataFrame, path: str, k: int = 5, sizes: list[int] | None = None, limit: int | None = None, nprobe: int = 8
) -> DataFrame:
    """Ranked hits of the cell index in its approximate form; the score is the cosine distance."""
    return as_distance(search_cells(first_queries(queries, limit), path, k, nprobe, exact=False, sizes=sizes))


def measured_probes(
    queries: DataFrame, docs: DataFrame, path: str, k: int = 5, sizes: list[int] | None = None, limit: int | None = None, recall: float = RECALL
) -> tuple[int, float]:
    """The probes at which the index finds ``recall`` of the exact hits in every sample, doubling from 1, and that
    recall. Measured on queries drawn by hash; at all cells the search is whole."""
    spark = queries.sparkSession
    asked = first_queries(queries, limit).withColumn("order", hash_rank(F.col("query_id"), 42))
    asked = materialize(smallest(asked, "order", "query_id", RECALL_QUERIES).drop("order"), "asked")
    keys = ["query_id", "doc_id", *(["sample_size"] if sizes else [])]
    exact = materialize(search(asked, docs, k, sizes).select(*keys), "exact")
    n_cells = spark.read.schema(CENTROIDS).parquet(f"{path}/centroids").count()
    nprobe = 1
    while True:
        found = search_cells(asked, path, k, nprobe, exact=False, sizes=sizes).select(*keys, F.lit(1).alias("hit"))
        shares = exact.join(found, keys, "left").groupBy(*keys[2:]).agg((F.count("hit") / F.count("*")).alias("recall"))
        reached = shares.agg(F.min("recall")).first()[0]
        reached = 1.0 if reached is None else reached
        if reached >= recall or nprobe >= n_cells:
            return nprobe, reached
        nprobe = min(2 * nprobe, n_cells)


def run_backends(
    embeddings: DataFrame, queries: DataFrame, key: DataFrame, path: str,
    sizes: list[int], k: int = 5, limit: int | None = None, n_cells: int | None = None, nprobe: int | None = None,
    lenient: bool = False, latest: bool = False,
) -> DataFrame:
    """Load and query both stores, and the cell index of the plain one, over all sample sizes.
    Writes stores, index, results, metrics, load log and id dumps under ``path``; returns the
    written hits with ``backend`` and ``sample_size``. Without ``n_cells`` the index has as many
    cells as the square root of the rows, and ``MOST_CELLS`` at most. Without ``nprobe`` as many are probed as
    ``measured_probes`` finds; the number and its recall go to ``path``/recall. ``lenient`` and ``latest`` are those of
    ``evaluate_sealed``."""
    spark = embeddings.sparkSession
    plain, sealed = PlainStore(spark, f"{path}/plain"), SealedStore(spark, f"{path}/sealed", key)
    if plain.is_empty():
        load_plain(embeddings, plain, f"{path}/load_times", sizes)
    ingest_sealed(embeddings, sealed, metrics=f"{path}/metrics", sizes=sizes, observed=f"{path}/observed")
    if read_or_empty(spark, f"{path}/cells/centroids", CENTROIDS).isEmpty() and not plain.is_empty():
        n_cells = n_cells or min(MOST_CELLS, math.isqrt(plain.read().count()))
        build_cells(plain.vectors(), f"{path}/cells", n_cells, mode="overwrite")
    if nprobe is None:
        nprobe = 1
        if not plain.is_empty():
            nprobe, reached = measured_probes(queries, plain.vectors(), f"{path}/cells", k, sizes, limit)
            append_metrics(spark, f"{path}/recall", "cells", max(sizes), {"nprobe": nprobe, "recall": reached})
    stored = {
        "plain": evaluate_plain(queries, plain, k, sizes, limit),
        "sealed": evaluate_sealed(queries, sealed, k, sizes, limit, lenient, latest),
        "cells": evaluate_cells(queries, f"{path}/cells", k, sizes, limit, nprobe),
    }
    taken = {}
    for backend, hits in stored.items():
        start = time.perf_counter()
        asked = first_queries(queries, limit).select("query_id", F.explode(F.array(*map(F.lit, sizes))).alias("sample_size"))
        write_results(
            hits.withColumn("backend", F.lit(backend)), f"{path}/results/{backend}", asked.withColumn("backend", F.lit(backend))
        )
        # One job ranks all samples; a sample's time is the job's by its share of the documents.
        seconds = time.perf_counter() - start
        taken |= {(backend, size): {"eval_time_sec": round(seconds * size / max(sizes), 4)} for size in sizes}
    append_all_metrics(spark, f"{path}/metrics", taken)
    write_ids(plain.ids(), f"{path}/ids/plain")
    write_ids(sealed.ids(), f"{path}/ids/sealed")
    return reduce(DataFrame.unionByName, [read_results(spark, f"{path}/results/{b}", ", backend STRING, sample_size INT") for b in stored])


def report_ndcg(hits: DataFrame, qrels: DataFrame, path: str, k: int = 5) -> DataFrame:
    """NDCG@k per query with the averages, for all backends and sizes at once, as CSV and
    as a table."""
    report = materialize(ndcg_report(judge(hits, qrels), k), "report")
    write_ndcg(report, f"{path}/ndcg", k)
    return report


def run_benchmark(
    docs: DataFrame, queries: DataFrame, qrels: DataFrame, sizes: list[int], embed: Embed, key: DataFrame,
    path: str, k: int = 5, limit: int | None = None, seed: int = 42,
) -> DataFrame:
    """Everything in order: prepare, all backends, report."""
    embeddings, asked = prepare_corpus(docs, queries, qrels, sizes, embed, f"{path}/embeddings", seed)
    hits = run_backends(embeddings, asked, key, path, sizes, k, limit)
    return report_ndcg(hits, qrels, path, k)

