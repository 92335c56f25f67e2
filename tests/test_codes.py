"""Search by product-quantised codes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sealrank.operators import codes
from sealrank.operators.codes import build_codes, encode, read_books, search_codes
from sealrank.operators.evaluation import recall_at_k
from sealrank.operators.search import search


@pytest.fixture(scope="module")
def clustered(spark):
    """A third of the vectors are copies of one, and one is zero."""
    rng = np.random.default_rng(31)
    centers = rng.normal(size=(20, 16))
    rows = [(f"d{i:03}", [float(x) for x in centers[i % 20] + 0.2 * rng.normal(size=16)]) for i in range(400)]
    rows += [(f"e{i:03}", [float(x) for x in centers[3]]) for i in range(200)] + [("zero", [0.0] * 16)]
    asked = [(i, [float(x) for x in centers[i % 20] + 0.2 * rng.normal(size=16)]) for i in range(40)] + [(99, [0.0] * 16)]
    return (
        spark.createDataFrame(asked, "query_id BIGINT, embedding ARRAY<DOUBLE>"),
        spark.createDataFrame(rows, "doc_id STRING, embedding ARRAY<DOUBLE>").repartition(3),
    )


def rows(df):
    return [tuple(r) for r in df.orderBy("query_id", "rank").collect()]


def test_codes_are_the_nearest_words(clustered, path, spark):
    _, docs = clustered
    build_codes(docs, place := path("codes"), 4, 32)
    books = read_books(spark, place)
    assert books.shape == (4, 32, 4)
    for r in spark.read.parquet(f"{place}/vectors").collect()[:50]:
        point = np.frombuffer(r["vector"], "<f8").reshape(4, 4)
        apart = [np.round(((book - x) ** 2).sum(axis=1), 12) for book, x in zip(books, point)]
        assert all(a[c] == pytest.approx(a.min(), abs=1e-9) for a, c in zip(apart, bytes(r["code"])))


def test_all_survivors_give_the_full_scan(clustered, path):
    queries, docs = clustered
    build_codes(docs, place := path("codes"), 4, 32)
    want = rows(search(queries, docs, 5))
    assert rows(search_codes(queries, place, 5, 1000)) == want
    assert rows(search_codes(queries, place, 5, 1000, query_rows=16)) == want


@pytest.mark.parametrize("rounds", [0, 4])
def test_few_survivors_hold_most_neighbours(clustered, path, rounds):
    queries, docs = clustered
    docs = docs.filter("doc_id < 'e'")
    build_codes(docs, place := path("codes"), 8, 64, rounds)
    recall = recall_at_k(search_codes(queries, place, 5, 40), search(queries, docs, 5)).agg(F.avg("recall")).first()[0]
    assert recall >= 0.9


def test_training_brings_the_words_nearer(clustered, path, spark):
    _, docs = clustered
    apart = []
    for rounds in (0, 5):
        build_codes(docs, place := path("codes"), 4, 8, rounds)
        books = read_books(spark, place)
        points = np.stack([np.frombuffer(r["vector"], "<f8") for r in spark.read.parquet(f"{place}/vectors").collect()])
        words = np.stack([books[p][c] for p, c in enumerate(encode(points, books).T)], axis=1).reshape(len(points), -1)
        apart.append(((points - words) ** 2).sum())
    assert apart[1] < apart[0]


def test_the_scan_reads_codes_only(clustered, path, spark):
    queries, docs = clustered
    build_codes(docs, place := path("codes"), 4, 32)
    block = codes.query_block(queries)
    stored = spark.read.parquet(f"{place}/vectors")
    plan = codes._survivors(block, stored, read_books(spark, place), 9)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:string,code:binary>" in plan


def test_empty_sides_and_errors(clustered, path):
    queries, docs = clustered
    build_codes(docs, place := path("codes"), 4, 32)
    none = search_codes(queries.limit(0), place, 5)
    assert none.count() == 0 and none.columns == ["query_id", "rank", "doc_id", "score"]
    with pytest.raises(ValueError, match="unique"):
        build_codes(docs.union(docs), path("codes"), 4)
    with pytest.raises(ValueError, match="parts"):
        build_codes(docs, path("codes"), 5)
    with pytest.raises(ValueError, match="words"):
        build_codes(docs, path("codes"), 4, 257)
    with pytest.raises(ValueError, match="unique"):
        search_codes(queries.union(queries), place, 5)
