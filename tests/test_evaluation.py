import math
import random

import pytest
from pyspark.sql import functions as F

from sealrank.operators.evaluation import (
    compare_backends, compare_ndcg, judge, last_judgement, ndcg_report, query_ndcg, recall_at_k,
)
from sealrank.sources.writers import ndcg_csv

HITS = "query_id STRING, rank INT, doc_id STRING, score DOUBLE"


def gain(rels, k):
    total = 0.0
    for place, rel in list(enumerate(rels, start=1))[:k]:
        total += (2**rel - 1) / math.log2(place + 1)
    return total


def definition(rels, k):
    ideal = gain(sorted(rels, reverse=True), k)
    return gain(rels, k) / ideal if ideal else 0.0


def judged(spark, lists):
    rows = [(q, i + 1, f"d{i}", 0.0, rel) for q, rels in lists.items() for i, rel in enumerate(rels)]
    return spark.createDataFrame(rows, HITS + ", rel INT")


def test_fixed_lists(spark):
    lists = {"a": [1, 0, 1], "none": [0, 0, 0], "late": [0, 0, 0, 0, 0, 1], "first": [1, 0, 0, 0, 0]}
    rows = {r["query_id"]: r for r in query_ndcg(judged(spark, lists), 5).collect()}
    assert rows["a"]["dcg"] == pytest.approx(1.5) and rows["a"]["idcg"] == pytest.approx(1.630930, abs=1e-6)
    assert rows["a"]["ndcg"] == pytest.approx(0.919721, abs=1e-6)
    assert rows["none"]["ndcg"] == 0.0 and rows["first"]["ndcg"] == 1.0
    assert (rows["late"]["dcg"], rows["late"]["idcg"], rows["late"]["ndcg"]) == (0.0, 1.0, 0.0)
    assert all(r["rels"] == lists[q] for q, r in rows.items())


@pytest.mark.parametrize("k", [1, 3, 5, 10])
def test_against_the_definition(spark, k):
    rng = random.Random(k)
    lists = {f"q{i}": [rng.randint(0, 1) for _ in range(rng.randint(1, 12))] for i in range(200)}
    report = {r["query_id"]: r["ndcg"] for r in ndcg_report(judged(spark, lists), k).collect()}
    want = {q: definition(rels, k) for q, rels in lists.items()}
    average = report.pop("AVERAGE")
    assert report == pytest.approx(want) and average == pytest.approx(sum(want.values()) / len(want))


def test_average_per_backend_and_size(spark):
    one = judged(spark, {"a": [1, 0], "b": [0, 0]})
    rows = one.select(F.lit("plain").alias("backend"), F.lit(10).alias("sample_size"), "*").unionByName(
        judged(spark, {"a": [1, 1]}).select(F.lit("sealed").alias("backend"), F.lit(20).alias("sample_size"), "*")
    )
    averages = {
        (r["backend"], r["sample_size"]): r["ndcg"] for r in ndcg_report(rows, 5).filter("query_id = 'AVERAGE'").collect()
    }
    assert averages == {("plain", 10): 0.5, ("sealed", 20): 1.0}


def test_csv_rows(spark):
    rows = {r["query_id"]: tuple(r) for r in ndcg_csv(ndcg_report(judged(spark, {"a": [1, 0, 1]}), 3), 3).collect()}
    assert rows["a"] == ("a", "[1, 0, 1]", "0.919721")
    assert rows["AVERAGE"] == ("AVERAGE", "['-', '-', '-']", "0.919721")


def test_judgements(spark):
    qrels = spark.createDataFrame(
        [(1, "d0", 0, 1), (1, "d0", 1, 2), (1, "d1", 2, 1), (1, "d1", 0, 2)], "query_id INT, doc_id STRING, relevance INT, pos INT"
    )
    last = {r["doc_id"]: r["relevance"] for r in last_judgement(qrels).collect()}
    assert last == {"d0": 1, "d1": 0}
    assert {r["doc_id"]: r["relevance"] for r in last_judgement(qrels.drop("pos")).collect()} == {"d0": 1, "d1": 2}
    hits = spark.createDataFrame([(1, 1, "d0", 0.9), (1, 2, "d1", 0.8), (1, 3, "new", 0.7), (2, 1, "d0", 0.1)],
                                 "query_id INT, rank INT, doc_id STRING, score DOUBLE")
    rels = {(r["query_id"], r["rank"]): r["rel"] for r in judge(hits, qrels).collect()}
    assert rels == {("1", 1): 1, ("1", 2): 0, ("1", 3): 0, ("2", 1): 0}


def test_one_query_with_a_third_of_all_judgements(spark):
    qrels = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("q"), "id")).alias("query_id"),
        F.concat(F.lit("d"), "id").alias("doc_id"), F.lit(1).alias("relevance"),
    )
    hits = spark.createDataFrame([("hot", 1, "d0", 1.0), ("hot", 2, "d1", 0.5), ("q1", 1, "d1", 1.0)], HITS)
    assert {(r["query_id"], r["rank"]): r["rel"] for r in judge(hits, qrels).collect()} == {
        ("hot", 1): 1, ("hot", 2): 0, ("q1", 1): 1
    }


def test_comparisons(spark):
    left = spark.createDataFrame([("a", 1, "x", 0.9), ("a", 2, "y", 0.8), ("b", 1, "x", 0.5)], HITS)
    right = spark.createDataFrame([("a", 1, "x", 0.7), ("a", 2, "z", 0.6), ("b", 1, "x", 0.5)], HITS)
    both = {r["query_id"]: (r["overlap"], r["score_gap"]) for r in compare_backends(left, right, 2).collect()}
    assert both["a"] == (0.5, pytest.approx(0.2)) and both["b"] == (0.5, 0.0)
    assert {r["query_id"]: r["recall"] for r in recall_at_k(right, left).collect()} == {"a": 0.5, "b": 1.0}
    reports = [judged(spark, {"a": r}) for r in ([1, 0], [0, 1])]
    gaps = {r["query_id"]: r["ndcg_gap"] for r in compare_ndcg(*(ndcg_report(j, 2) for j in reports)).collect()}
    assert gaps["a"] == pytest.approx(1 / math.log2(3) - 1) and gaps["AVERAGE"] == gaps["a"]
