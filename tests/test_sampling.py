import hashlib

import pytest
from pyspark.sql import functions as F

from sealrank.operators import selection
from sealrank.operators.sampling import (
    corpus_counts, judged_ids, keep, leave_out, sample_documents, sample_ids, sample_sweep,
)


@pytest.fixture(scope="module")
def corpus(spark):
    docs = spark.range(500).select(F.concat(F.lit("d"), "id").alias("doc_id"), F.lit("t").alias("text"))
    qrels = spark.createDataFrame(
        [("q1", f"d{i}", 1) for i in range(0, 60, 3)] + [("q2", "d3", 0), ("q3", "gone", 1)],
        "query_id STRING, doc_id STRING, relevance INT",
    )
    return docs, qrels


def expected(n, seed=42):
    """All judged ids of the corpus, then the others by the md5 of seed and id."""
    judged = {f"d{i}" for i in range(0, 60, 3)}
    others = sorted((hashlib.md5(f"{seed}|d{i}".encode()).hexdigest(), f"d{i}") for i in range(500) if f"d{i}" not in judged)
    return judged | {d for _, d in others[: n - len(judged)]}


def test_samples_are_exact_repeatable_and_nested(corpus):
    docs, qrels = corpus
    sizes = [20, 100, 333, 500]
    first = sample_ids(docs, qrels, sizes)
    rows = sample_sweep(first, sizes).collect()
    for n in sizes:
        assert {r["doc_id"] for r in rows if r["sample_size"] == n} == expected(n)
        assert len([r for r in rows if r["sample_size"] == n]) == n
    again = sample_ids(docs.repartition(7), qrels, sizes)
    assert first.exceptAll(again).count() == 0
    other = sample_ids(docs, qrels, [100], seed=7)
    assert {r["doc_id"] for r in other.collect()} == expected(100, 7) != expected(100)


def test_narrowing_gives_the_same_cut(corpus, monkeypatch):
    docs, qrels = corpus
    monkeypatch.setattr(selection, "FEW_ROWS", 3)
    monkeypatch.setattr(selection, "BUCKETS", 4)
    assert {r["doc_id"] for r in sample_ids(docs, qrels, [123]).collect()} == expected(123)


def test_judged_outside_the_corpus(corpus):
    docs, qrels = corpus
    kept = {r["doc_id"] for r in sample_ids(docs, qrels, [50], intersect_corpus=False).collect()}
    assert "gone" in kept and len(kept) == 50
    assert "gone" not in {r["doc_id"] for r in sample_ids(docs, qrels, [50]).collect()}
    everything = sample_ids(docs, qrels, [900], intersect_corpus=False)
    assert everything.count() == 501


def test_sizes_out_of_range(corpus):
    docs, qrels = corpus
    with pytest.raises(ValueError, match="below the 20 judged"):
        sample_ids(docs, qrels, [19, 100])
    with pytest.raises(ValueError, match="below the 21 judged"):
        sample_ids(docs, qrels, [20], intersect_corpus=False)
    with pytest.raises(ValueError, match="above the 500"):
        sample_ids(docs, qrels, [501])


def test_repeated_ids_count_once(corpus):
    """A third of the corpus rows repeat one id; all of its rows come with it."""
    docs, qrels = corpus
    hot = docs.unionByName(docs.sparkSession.range(250).select(F.lit("d3").alias("doc_id"), F.lit("t").alias("text")))
    assert {r["doc_id"] for r in sample_ids(hot, qrels, [100]).collect()} == expected(100)
    assert sample_documents(hot, qrels, [100]).count() == 350


def test_semi_and_anti_joins(corpus):
    docs, qrels = corpus
    ids = judged_ids(qrels)
    assert ids.count() == 21
    assert keep(docs, ids).count() == 20 and leave_out(docs, ids).count() == 480
    assert corpus_counts(docs, qrels) == (500, 22)


def test_first_rows(spark, monkeypatch):
    df = spark.range(1000).select((F.col("id") * 7 % 1000 - 300).alias("pos"), F.col("id").cast("string").alias("tie"))
    df = df.unionByName(spark.range(400).select(F.lit(5).cast("bigint").alias("pos"), F.concat(F.lit("x"), "id").alias("tie")))
    monkeypatch.setattr(selection, "FEW_ROWS", 10)
    monkeypatch.setattr(selection, "BUCKETS", 8)
    everything = sorted(map(tuple, df.collect()))
    for n in (0, 1, 299, 306, 500, 1399, 1400, 5000):
        assert sorted(map(tuple, selection.first_rows(df, "pos", "tie", n).collect())) == everything[:n]
    assert selection.first_rows(df, "pos", "tie", None).count() == 1400
    assert selection.first_rows(df.limit(0), "pos", "tie", 3).count() == 0


def test_exactly_n_rows_with_repeated_and_missing_keys(spark):
    rows = [(i % 3, "abc"[i % 2]) for i in range(60)] + [(None, "z"), (None, "a"), (5, None), (5, None), (5, "x")]
    df = spark.createDataFrame(rows, "pos BIGINT, tie STRING").repartition(7)
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or ""))
    for n in (0, 1, 9, 10, 11, 37, 60, 61, 62, 63, 64, 65, 99):
        got = sorted(map(tuple, selection.first_rows(df, "pos", "tie", n).collect()), key=str)
        assert got == sorted(order[:n], key=str), n
