"""Retrieval quality: relevance of hits, NDCG@k with its average, overlap and recall."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sealrank.functions.text import is_relevant

AVERAGE = "AVERAGE"


def _groups(df: DataFrame) -> list[str]:
    return [c for c in ("backend", "sample_size") if c in df.columns]


def last_judgement(qrels: DataFrame) -> DataFrame:
    """One judgement per query and document: the last by ``pos`` where there is such a
    column, else the highest. Ids become text, as both sides of the join are."""
    relevance = F.max_by("relevance", "pos") if "pos" in qrels.columns else F.max("relevance")
    return qrels.groupBy(
        F.col("query_id").cast("string").alias("query_id"), F.col("doc_id").cast("string").alias("doc_id")
    ).agg(relevance.alias("relevance"))


def judge(hits: DataFrame, qrels: DataFrame) -> DataFrame:
    """Hits with ``rel``: 1 where the pair is judged relevant, 0 where not or not judged."""
    pairs = hits.withColumn("query_id", F.col("query_id").cast("string")).withColumn(
        "doc_id", F.col("doc_id").cast("string")
    )
    joined = pairs.join(last_judgement(qrels), ["query_id", "doc_id"], "left")
    return joined.select(*_groups(hits), "query_id", "rank", "doc_id", "score", is_relevant(F.col("relevance")).alias("rel"))


def dcg(rel: str = "rel", rank: str = "rank", k: int = 5) -> Column:
    """An aggregate: gain 2^rel - 1 discounted by log2(rank + 1), over the first k ranks."""
    gain = (F.pow(F.lit(2.0), F.col(rel)) - 1) / F.log2(F.col(rank) + 1)
    return F.sum(F.when(F.col(rank) <= k, gain).otherwise(0.0))


def idcg(n_relevant: Column, k: int = 5) -> Column:
    """DCG of the retrieved relevances in their best order.

    Relevance is 0 or 1, so that order is all ones first and only their number counts;
    the window over sorted relevances becomes a lookup.
    """
    sums = [0.0]
    for i in range(k):
        sums.append(sums[-1] + 1.0 / math.log2(i + 2))
    best = F.array(*[F.lit(s) for s in sums])
    return F.element_at(best, (F.least(n_relevant, F.lit(k)) + 1).cast("int"))


def query_ndcg(judged: DataFrame, k: int = 5) -> DataFrame:
    """Per query: relevances in rank order, DCG, IDCG and NDCG@k (0 without a hit).

    A row without a rank stands for a query that found nothing.
    """
    groups = _groups(judged)
    lists = judged.groupBy(*groups, "query_id").agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("rank").isNotNull(), F.struct("rank", "rel")))), lambda x: x["rel"]).alias("rels"),
        F.coalesce(dcg(k=k), F.lit(0.0)).alias("dcg"),
        F.sum("rel").alias("n_rel"),
    )
    ideal = idcg(F.col("n_rel"), k)
    return lists.withColumn("idcg", ideal).select(
        *groups, "query_id", "rels", "dcg", "idcg",
        F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(0.0).alias("ndcg"),
    )


def ndcg_report(judged: DataFrame, k: int = 5) -> DataFrame:
    """``query_id, rels, ndcg`` per query and an AVERAGE row per backend and size.

    Grouping sets add the average in the same pass; a union would search twice.
    """
    groups = _groups(judged)
    per_query = query_ndcg(judged, k)
    sets = [[*groups, "query_id"], groups]
    rows = per_query.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in sets[0]]).agg(
        F.grouping("query_id").alias("is_average"), F.any_value("rels").alias("rels"), F.avg("ndcg").alias("ndcg")
    )
    average = F.col("is_average") == 1
    return rows.select(
        *groups,
        F.when(average, F.lit(AVERAGE)).otherwise(F.col("query_id")).alias("query_id"),
        F.when(average, F.lit(None)).otherwise(F.col("rels")).alias("rels"),
        "ndcg",
    )


def compare_backends(left: DataFrame, right: DataFrame, k: int = 5) -> DataFrame:
    """Per query: overlap@k of two rankings, and the widest score gap on shared documents."""
    keys = [*[c for c in ("sample_size",) if c in left.columns], "query_id", "doc_id"]
    both = left.select(*keys, F.col("score").alias("left_score")).join(
        right.select(*keys, F.col("score").alias("right_score")), keys, "full"
    )
    shared = F.col("left_score").isNotNull() & F.col("right_score").isNotNull()
    return both.groupBy(*keys[:-1]).agg(
        (F.count_if(shared) / F.lit(float(k))).alias("overlap"),
        F.max(F.abs(F.col("left_score") - F.col("right_score"))).alias("score_gap"),
    )


def compare_ndcg(left: DataFrame, right: DataFrame) -> DataFrame:
    """NDCG difference of two reports per query and for the average; what a report lacks is 0."""
    keys = [*[c for c in ("sample_size",) if c in left.columns], "query_id"]
    both = left.select(*keys, F.col("ndcg").alias("left_ndcg")).join(
        right.select(*keys, F.col("ndcg").alias("right_ndcg")), keys, "full"
    )
    return both.fillna(0.0, ["left_ndcg", "right_ndcg"]).withColumn("ndcg_gap", F.col("right_ndcg") - F.col("left_ndcg"))


def recall_at_k(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact hits that ``found`` has, per query."""
    keys = ["query_id", "doc_id"]
    marked = exact.select(*keys).join(found.select(*keys, F.lit(1).alias("hit")), keys, "left")
    return marked.groupBy("query_id").agg((F.count("hit") / F.count("*")).alias("recall"))
