import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sealrank import schemas
from sealrank.functions.sealing import open_text
from sealrank.functions.text import content, is_relevant
from sealrank.operators.embedding import embed, embed_distinct, embed_hashed, hashed_embedding, hashed_model
from sealrank.operators.search import search
from sealrank.plans import pipeline
from sealrank.sources import readers, writers
from sealrank.sources.stores import PlainStore, SealedStore
from sealrank.streaming.jobs import ingest_stream, read_stream, search_stream, upsert_stream

VECTORS = "doc_id STRING, embedding ARRAY<DOUBLE>"
TEXTS = ["The cat sat", "the CAT, the hat!", "", None, "Ünïcode naïve 42", "!!! ???", "a-b_c" * 300]


def counted(text, width=64):
    out = np.zeros(width)
    for token in re.split("[^a-z0-9]+", (text or "").lower()):
        if token:
            out[int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % width] += 1
    norm = np.linalg.norm(out)
    return out / norm if norm else out


@pytest.mark.parametrize("width", [8, 64])
def test_both_hashed_forms(spark, width):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i INT, text STRING")
    batch = {r["i"]: r for r in embed_hashed(df, "text", width, spread=True).collect()}
    plain = {r["i"]: r["e"] for r in df.select("i", hashed_embedding(F.col("text"), width).alias("e")).collect()}
    for i, text in enumerate(TEXTS):
        assert batch[i]["embedding"] == pytest.approx(list(counted(text, width)))
        assert plain[i] == pytest.approx(list(counted(text, width)))
        assert batch[i]["embed_time"] >= 0 and batch[i]["text"] == text


def test_texts_without_a_token(spark):
    model = hashed_model(4)()
    assert not model(["", ""]).any() and not model(["?"]).any()
    assert model(["", "a"]).any(axis=1).tolist() == [False, True]


def test_model_is_made_once_per_task(spark):
    def make():
        calls = []

        def model(texts):
            calls.append(len(texts))
            return np.array([[len(t), len(calls)] for t in texts])

        return model

    df = spark.range(1000, numPartitions=1).select(F.col("id").cast("string").alias("t"))
    rows = embed(df, "t", make, batch_texts=300).collect()
    assert [r["embedding"][1] for r in rows] == [1.0] * 300 + [2.0] * 300 + [3.0] * 300 + [4.0] * 100


def test_content_and_relevance(spark):
    row = spark.createDataFrame([(None, "t", None, 2)], "a STRING, b STRING, r INT, s INT").select(
        content(F.col("a"), F.col("b")), content(F.col("b"), F.col("a")), is_relevant(F.col("r")), is_relevant(F.col("s"))
    ).first()
    assert tuple(row) == ("\nt", "t\n", 0, 1)


@pytest.fixture
def small(spark):
    docs = spark.createDataFrame([(str(i), f"title {i}", f"word{i} common text {i % 7}") for i in range(40)], schemas.DOCUMENTS)
    queries = spark.createDataFrame([(f"q{i}", f"word{i}") for i in range(6)], schemas.QUERIES)
    qrels = spark.createDataFrame([(f"q{i}", str(i), 1) for i in range(6)] + [("q0", "39", 0)], schemas.QRELS)
    return docs, queries, qrels


def test_whole_benchmark(spark, small, key, path):
    place = path("run")
    report = pipeline.run_benchmark(*small, [10, 20, 40], embed_hashed, key, place, k=5)
    rows = report.collect()
    averages = {(r["backend"], r["sample_size"]): r["ndcg"] for r in rows if r["query_id"] == "AVERAGE"}
    assert set(averages) == {(b, s) for b in ("plain", "sealed", "cells") for s in (10, 20, 40)}
    assert all(averages["plain", s] == averages["sealed", s] == averages["cells", s] for s in (10, 20, 40))
    assert len(rows) == 3 * 3 * 7
    embedded = readers.read_doc_embeddings(spark, f"{place}/embeddings/doc_embeddings", extra=", first_size INT")
    assert embedded.count() == 40 and pipeline.sizes_of(embedded) == [10, 20, 40]
    log = {r["size"]: r["count"] for r in readers.read_load_log(spark, f"{place}/load_times").collect()}
    assert log == {10: 10, 20: 20, 40: 40}
    for backend in ("plain", "sealed"):
        ids = spark.read.json(f"{place}/ids/{backend}")
        assert {r["doc_id"] for r in ids.collect()} == {str(i) for i in range(40)}
    metrics = {(r["backend"], r["metric"]) for r in writers.latest_metrics(spark, f"{place}/metrics").collect()}
    assert metrics == {("sealed", "total_time"), ("sealed", "wall_clock_time"), *((b, "eval_time_sec") for b in ("plain", "sealed", "cells"))}
    csv = spark.read.option("header", True).csv(f"{place}/ndcg")
    assert csv.count() == len(rows) and "NDCG@5" in csv.columns
    hits = readers.read_results(spark, f"{place}/results/sealed", ", backend STRING, sample_size INT").filter("sample_size = 10")
    assert {int(r["doc_id"]) for r in hits.collect()} <= {int(r["doc_id"]) for r in embedded.filter("first_size = 10").collect()}


def test_probes_reach_the_recall(spark, key, path):
    points = np.random.default_rng(3).normal(size=(600, 16))
    docs = spark.createDataFrame([(str(i), p.tolist(), 300 if i % 2 else 600) for i, p in enumerate(points)], "doc_id STRING, embedding ARRAY<DOUBLE>, first_size INT")
    docs = docs.withColumn("content", F.lit(""))
    queries = docs.selectExpr("concat('q', doc_id) query_id", "embedding").limit(60)
    hits = pipeline.run_backends(docs, queries, key, place := path("run"), [300, 600], n_cells=24)
    found = {b: {(r["query_id"], r["sample_size"], r["doc_id"]) for r in hits.filter(F.col("backend") == b).collect()} for b in ("plain", "cells")}
    for size in (300, 600):
        exact = {x for x in found["plain"] if x[1] == size}
        assert len(exact & found["cells"]) >= 0.9 * len(exact)
    noted = {r["metric"]: r["value"] for r in writers.latest_metrics(spark, f"{place}/recall").collect()}
    assert noted["recall"] >= 0.9 and 1 <= noted["nprobe"] <= 24


def test_ingest_takes_the_first_documents_and_skips_a_full_store(spark, key, path):
    rows = spark.range(50).select(
        F.col("id").cast("string").alias("doc_id"), (50 - F.col("id")).alias("doc_pos"), F.array(F.lit(1.0)).alias("embedding")
    )
    store = SealedStore(spark, path("s"), key)
    assert pipeline.ingest_sealed(rows, store, n=10, metrics=path("m"))
    assert {int(r[0]) for r in store.ids().collect()} == set(range(40, 50))
    assert not pipeline.ingest_sealed(rows, store) and store.count() == 10


def test_load_log_without_sample_sizes(spark, path):
    rows = spark.range(7).select(F.col("id").cast("string").alias("doc_id"), F.array(F.lit(1.0)).alias("embedding"))
    pipeline.load_plain(rows, PlainStore(spark, path("p")), log := path("log"))
    assert [(r["size"], r["count"]) for r in readers.read_load_log(spark, log).collect()] == [(7, 7)]


def test_a_load_observes_itself(spark, key, path):
    rows = spark.range(60).select(
        F.col("id").cast("string").alias("doc_id"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("embedding"),
        F.when(F.col("id") < 10, 10).when(F.col("id") < 50, 50).alias("first_size"), F.lit(0.25).alias("embed_time"),
    )
    for store in (PlainStore(spark, path("p")), SealedStore(spark, path("s"), key)):
        loaded = store.load(rows, [10, 50])
        assert store.count() == 60 and "embed_time" not in store.read().columns
        assert loaded.whole["n_docs"] == 60 and loaded.whole["embed_time"] == 15.0
        assert {s: (own["n_docs"], own["embed_time"]) for s, own in loaded.by_size.items()} == {10: (10, 2.5), 50: (50, 12.5)}
        assert loaded.by_size[10]["wall_clock_time"] == pytest.approx(loaded.seconds / 6)
    assert 0 < loaded.by_size[10]["total_time"] < loaded.by_size[50]["total_time"] < loaded.whole["total_time"]


def test_a_load_of_nothing_observes_nothing(spark, key, path):
    none = spark.createDataFrame([], VECTORS)
    for store in (PlainStore(spark, path("p")), SealedStore(spark, path("s"), key)):
        loaded = store.load(none.repartition(3), [10])
        assert loaded.whole["n_docs"] == 0 and loaded.by_size[10]["n_docs"] == 0


def test_metrics_name_their_sample(spark, small, key, path, caplog):
    place = path("run")
    with caplog.at_level("INFO"):
        pipeline.run_benchmark(*small, [10, 40], embed_hashed, key, place, k=3)
    assert "40 documents, 7 judgements" in caplog.text
    for name in ("metrics", "observed", "recall", "embeddings/counts"):
        assert writers.latest_metrics(spark, f"{place}/{name}").filter("sample_size IS NULL").count() == 0
    taken = writers.latest_metrics(spark, f"{place}/metrics").collect()
    assert {(r["metric"], r["sample_size"]) for r in taken if r["backend"] == "sealed"} == {
        (m, s) for m in ("total_time", "wall_clock_time", "eval_time_sec") for s in (10, 40)
    }
    observed = {(r["metric"], r["sample_size"]): r["value"] for r in writers.latest_metrics(spark, f"{place}/observed").collect()}
    assert observed["n_docs", 10] == 10 and observed["n_docs", 40] == 40 and observed["embed_time", 40] > 0


def test_query_limit(spark, path):
    queries = spark.createDataFrame([("b", 0, [1.0]), ("a", 1, [1.0])], "query_id STRING, query_pos BIGINT, embedding ARRAY<DOUBLE>")
    store = PlainStore(spark, path("p"))
    store.add(spark.createDataFrame([("d", [2.0])], VECTORS))
    for limit, found in ((None, {"a", "b"}), (0, set()), (1, {"b"}), (9, {"a", "b"})):
        hits = pipeline.evaluate_plain(queries, store, limit=limit)
        assert {r["query_id"] for r in hits.collect()} == found


@pytest.fixture
def vector_files(spark, path):
    place = path("files")
    rng = np.random.default_rng(2)
    for part in range(2):
        rows = [(f"{part}-{i}", [float(x) for x in rng.normal(size=4)]) for i in range(100)]
        spark.createDataFrame(rows, VECTORS).coalesce(1).write.mode("append").parquet(place)
    return place


def test_stream_ingest_and_replay(spark, key, path, vector_files):
    store = SealedStore(spark, path("s"), key)

    def stream(checkpoint):
        rows = read_stream(spark, vector_files, VECTORS, files_per_batch=1)
        ingest_stream(rows, store, checkpoint).awaitTermination()

    stream(first := path("offsets"))
    assert store.count() == 200 and store.read().select("batch").distinct().count() == 2
    stream(first)
    assert store.count() == 200, "nothing new to read"
    stream(path("offsets"))
    assert store.count() == 200, "batches that run again replace what they wrote"


def test_stream_search_equals_batch(spark, path, vector_files):
    docs = spark.read.schema(VECTORS).parquet(vector_files)
    store = PlainStore(spark, path("p"))
    store.add(docs)
    asked = read_stream(spark, vector_files, VECTORS, files_per_batch=1).withColumnRenamed("doc_id", "query_id")
    place, offsets = path("hits"), path("offsets")
    search_stream(asked, store, 3, place, offsets).awaitTermination()
    got = spark.read.parquet(place).drop("batch_id")
    want = search(docs.withColumnRenamed("doc_id", "query_id"), docs, 3)
    assert got.count() == 600 and got.exceptAll(want).count() == 0


def test_a_stream_keeps_the_newest_versions_over_restarts(spark, key, path):
    store, place, offsets = SealedStore(spark, path("s"), key), path("files"), path("offsets")
    schema = "doc_id STRING, version BIGINT, embedding ARRAY<DOUBLE>, content STRING"

    def arrive(*rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(place)
        upsert_stream(read_stream(spark, place, schema), store, offsets).awaitTermination()
        return {r["doc_id"]: r["content"] for r in read_back().collect()}

    def read_back():
        tied = F.col("doc_key")
        return store.latest().select(
            open_text(F.col("id_enc"), store.key, tied).alias("doc_id"), open_text(F.col("text_enc"), store.key, tied).alias("content")
        )

    assert arrive(("a", 1, [1.0], "a1"), ("b", 5, [1.0], "b5"), ("a", 2, [2.0], "a2")) == {"a": "a2", "b": "b5"}
    assert arrive(("b", 4, [1.0], "late"), ("c", None, [1.0], "c0")) == {"a": "a2", "b": "b5", "c": "c0"}
    before = store.count()
    assert arrive(("a", 3, [1.0], "a3"), ("b", 5, [1.0], "b5"), ("c", 0, [1.0], "c0")) == {"a": "a3", "b": "b5", "c": "c0"}
    assert store.count() <= before + 3
    # Of equal versions the same one wins, whichever comes first.
    both = [("x", 7, [1.0], "one"), ("x", 7, [1.0], "two")]
    first = arrive(both[0])["x"], arrive(both[1])["x"]
    other = SealedStore(spark, path("s"), key)
    store, place, offsets = other, path("files"), path("offsets")
    assert (arrive(both[1])["x"], arrive(both[0])["x"])[1] == first[1]


def test_a_query_asked_twice_in_a_batch_gets_one_answer(spark, key, path):
    schema = "query_id STRING, embedding ARRAY<DOUBLE>"
    asked = path("asked")
    spark.createDataFrame([("q", [1.0, 0.0]), ("q", [1.0, 0.0]), ("r", [0.0, 1.0]), ("r", [1.0, 1.0])], schema).write.parquet(asked)
    rows = spark.createDataFrame([("d", [1.0, 0.0]), ("e", [0.0, 1.0])], VECTORS)
    sealed, plain = SealedStore(spark, path("s"), key), PlainStore(spark, path("p"))
    for store in (sealed, plain):
        store.add(rows)
    sealed.add(rows.filter("doc_id = 'd'"))
    for store, options, n in ((plain, {}, 2), (sealed, {"latest": True, "lenient": True}, 2), (sealed, {}, 3)):
        search_stream(read_stream(spark, asked, schema), store, 5, place := path("hits"), path("offsets"), **options).awaitTermination()
        hits = spark.read.parquet(place).drop("batch_id").collect()
        assert sorted((r["query_id"], r["rank"]) for r in hits) == [(q, i + 1) for q in "qr" for i in range(n)]


def test_a_text_is_embedded_once(spark, path):
    """A third of the rows hold one text; the model sees each distinct text once."""
    rows = [(i, "hot" if i % 3 == 0 else f"text {i % 20}" if i % 3 == 1 else None, "x") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id BIGINT, body STRING, embedding_of STRING").repartition(6)
    seen = path("seen")

    def counting():
        inner = hashed_model(8)()

        def model(texts):
            import pathlib
            import uuid

            folder = pathlib.Path(seen.removeprefix("file:"))
            folder.mkdir(parents=True, exist_ok=True)
            (folder / uuid.uuid4().hex).write_text("\n".join(texts))
            return inner(texts)

        return model

    import pathlib

    got = embed_distinct(df, "body", counting, part_rows=7).collect()
    calls = [line for f in pathlib.Path(seen.removeprefix("file:")).iterdir() for line in f.read_text().split("\n")]
    assert sorted(calls) == sorted({t or "" for _, t, _ in rows})
    want = {r["doc_id"]: r["embedding"] for r in embed_hashed(df, "body", 8).collect()}
    assert {r["doc_id"]: r["embedding"] for r in got} == want and len(got) == 300
    assert got[0].asDict().keys() == {"doc_id", "body", "embedding_of", "embedding", "embed_time"}
    assert embed_distinct(df.limit(0), "body", hashed_model(8)).count() == 0


def test_first_queries_without_positions(spark):
    queries = spark.createDataFrame([("b",), ("a",), ("c",)], "query_id STRING")
    assert {r[0] for r in pipeline.first_queries(queries, 2).collect()} == {"a", "b"}
    assert pipeline.first_queries(queries, None).count() == 3 and pipeline.first_queries(queries, 0).count() == 0
    placed = spark.createDataFrame([("b", 1), ("a", 2), ("c", None)], "query_id STRING, query_pos BIGINT")
    assert [r[0] for r in pipeline.first_queries(placed, 1).collect()] == ["b"]


def test_queries_that_find_nothing_count_as_zero(spark, path):
    from sealrank.operators.evaluation import compare_ndcg, judge, ndcg_report

    hits = spark.createDataFrame([("plain", "q1", 1, "d", 1.0)], "backend STRING, query_id STRING, rank INT, doc_id STRING, score DOUBLE")
    asked = spark.createDataFrame([("plain", "q1"), ("plain", "q2")], "backend STRING, query_id STRING")
    place = path("results")
    writers.write_results(hits, place, asked)
    qrels = spark.createDataFrame([("q1", "d", 1)], schemas.QRELS)
    report = ndcg_report(judge(readers.read_results(spark, place), qrels), 5)
    rows = {r["query_id"]: r for r in report.collect()}
    assert rows["AVERAGE"]["ndcg"] == 0.5 and rows["q2"]["ndcg"] == 0 and rows["q2"]["rels"] == []
    gaps = {r["query_id"]: r["ndcg_gap"] for r in compare_ndcg(report, report.filter("query_id <> 'q1'")).collect()}
    assert gaps == {"q1": -1.0, "q2": 0.0, "AVERAGE": 0.0}


def test_dealing_out_never_lowers_the_number_of_parts(spark):
    from sealrank.operators.embedding import deal_out

    wanted = 2 * spark.sparkContext.defaultParallelism
    assert deal_out(spark.range(100).repartition(5 * wanted)).rdd.getNumPartitions() == 5 * wanted
    assert deal_out(spark.range(0, 100, 1, 1)).rdd.getNumPartitions() == wanted


def test_both_forms_fold_only_ascii(spark):
    df = spark.createDataFrame([("\u0130stanbul KELVIN \u212a \u00c9t\u00c9",)], "t STRING")
    plain = df.select(hashed_embedding(F.col("t")).alias("e")).first()["e"]
    assert np.allclose(plain, embed_hashed(df, "t").first()["embedding"])


def test_streams_read_tables_of_part_files(spark, tmp_path):
    """A table may be a folder of part files, as well as one file."""
    from sealrank.plans.queries import QUERIES

    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=4)], i % 3) for i in range(30)]
    table = spark.createDataFrame(rows, "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT")
    table.repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    hits, stored = QUERIES["stream_search"](spark, str(tmp_path)), QUERIES["stream_ingest"](spark, str(tmp_path))
    assert sorted(map(tuple, hits.collect())) == sorted(map(tuple, QUERIES["exact_topk"](spark, str(tmp_path)).collect()))
    assert hits.count() == 150 and stored.count() == 120


def test_a_model_is_given_a_bounded_piece_of_long_texts(spark):
    """Twenty texts of a million characters do not go to the model at once."""
    docs = spark.range(20, numPartitions=1).select("id", F.repeat(F.lit("word "), 200_000).alias("text"))
    made = embed(docs, "text", lambda: lambda texts: np.full((len(texts), 1), float(sum(map(len, texts)))))
    assert made.agg(F.max(F.col("embedding")[0])).first()[0] <= 4 << 20
