"""Corpus samples that hold every judged document, in nested sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sealrank.operators.selection import hash_rank, nth_smallest, up_to
from sealrank.session import materialize

# A sample has exactly as many ids as its size; up to this many are broadcast, so that the
# corpus texts are filtered where they are read. More are left to Spark's own choice.
BROADCAST_IDS = 500_000


def judged_ids(qrels: DataFrame) -> DataFrame:
    return qrels.select("doc_id").distinct()


def keep(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Documents whose id is in ``ids``."""
    return docs.join(ids, "doc_id", "left_semi")


def leave_out(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Documents whose id is not in ``ids``."""
    return docs.join(ids, "doc_id", "left_anti")


def corpus_counts(docs: DataFrame, qrels: DataFrame) -> tuple[int, int]:
    return docs.count(), qrels.count()


def sample_ids(
    docs: DataFrame, qrels: DataFrame, sizes: list[int], seed: int = 42, intersect_corpus: bool = True
) -> DataFrame:
    """``doc_id, judged, first_size``: the smallest of ``sizes`` whose sample holds the id.

    A sample of n has all judged ids and the n - judged other ids of lowest hash rank, so
    it has exactly n ids, is the same for the same seed, and lies within every larger one.
    Judged ids that the corpus lacks are dropped, or kept with
    ``intersect_corpus=False``; the sample is then not filled beyond what the corpus has.
    """
    sizes = sorted(set(sizes))
    judged = judged_ids(qrels).withColumn("judged", F.lit(True))
    how = "left" if intersect_corpus else "full"
    marked = materialize(
        docs.select("doc_id").distinct()
        .join(judged, "doc_id", how)
        .select("doc_id", F.coalesce("judged", F.lit(False)).alias("judged"),
                hash_rank(F.col("doc_id"), seed).alias("order")),
        "sample",
    )
    total, n_judged = marked.agg(F.count("*"), F.count_if("judged")).first()
    if n_judged > sizes[0]:
        raise ValueError(f"sample size {sizes[0]} is below the {n_judged} judged documents")
    if intersect_corpus and sizes[-1] > total:
        raise ValueError(f"sample size {sizes[-1]} is above the {total} documents of the corpus")
    cuts = nth_smallest(marked.filter("NOT judged"), "order", "doc_id", [n - n_judged for n in sizes if n > n_judged])
    cuts = [False] * (len(sizes) - len(cuts)) + cuts
    first = F.when(F.col("judged"), sizes[0])
    for size, cut in zip(sizes, cuts):
        inside = F.lit(cut is None) if not cut else up_to("order", "doc_id", cut)
        first = first.when(inside, size)
    picked = marked.select("doc_id", "judged", first.cast("int").alias("first_size")).filter("first_size IS NOT NULL")
    return materialize(picked, "picked")


def sample_sweep(sampled: DataFrame, sizes: list[int]) -> DataFrame:
    """One row per id and sample size."""
    every = F.array(*[F.lit(s) for s in sorted(set(sizes))])
    return sampled.select(
        F.explode(F.filter(every, lambda s: s >= F.col("first_size"))).alias("sample_size"), "doc_id", "judged"
    )


def sample_documents(
    docs: DataFrame, qrels: DataFrame, sizes: list[int], seed: int = 42
) -> DataFrame:
    """The documents of the largest sample with the size they first appear in."""
    ids = sample_ids(docs, qrels, sizes, seed).select("doc_id", "first_size")
    if max(sizes) <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return docs.join(ids, "doc_id")
