import base64

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sealrank.functions.sealing import blind_index, load_key, open_text, save_key, seal
from sealrank.operators.packing import unpack_vectors
from sealrank.operators.search import search
from sealrank.plans.pipeline import evaluate_sealed
from sealrank.session import materialize
from sealrank.sources.stores import PlainStore, SealedStore
from tests.conftest import SF_DIR

DOCS = [("a", [3.0, 4.0], "alpha"), ("b", [0.0, 0.0], "beta"), ("ü", [1.0, 0.0], "ünïcode\ntext")]
SCHEMA = "doc_id STRING, embedding ARRAY<DOUBLE>, content STRING"


@pytest.fixture
def store(spark, key, path):
    made = SealedStore(spark, path("sealed"), key)
    made.add(spark.createDataFrame(DOCS, SCHEMA), version=0)
    return made


def test_round_trip(store):
    opened = {r["doc_id"]: r["embedding"] for r in unpack_vectors(store.vectors().select("doc_id", "vector")).collect()}
    assert opened["a"] == pytest.approx([0.6, 0.8]) and opened["b"] == [0.0, 0.0]
    assert sorted(r[0] for r in store.ids().collect()) == ["a", "b", "ü"]
    assert sorted(r[0] for r in store.content().collect()) == sorted(d[2] for d in DOCS)
    assert store.count() == 3 and not store.is_empty()


def test_nothing_is_stored_in_the_clear(spark, store):
    for row in store.read().collect():
        for value in (row["id_enc"], row["text_enc"], row["vector_enc"]):
            assert not any(d[2].encode() in bytes(value) for d in DOCS)
        assert row["doc_key"] not in ("a", "b", "ü")


def test_two_seals_differ_but_the_blind_index_does_not(spark, key, path):
    one, two = (SealedStore(spark, path("s"), key) for _ in range(2))
    for s in (one, two):
        s.add(spark.createDataFrame(DOCS, SCHEMA))
    left, right = ({r["doc_key"]: bytes(r["id_enc"]) for r in s.read().collect()} for s in (one, two))
    assert left.keys() == right.keys() and all(left[k] != right[k] for k in left)


def test_moved_altered_and_raw_ids(spark, key, path):
    ids = spark.createDataFrame([("x",), ("y",)], "doc_id STRING").withColumn("doc_key", blind_index(F.col("doc_id"), key))
    sealed = ids.withColumn("id_enc", seal(F.col("doc_id"), key, F.col("doc_key")))
    sealed.write.parquet(place := path("ids"))
    sealed = spark.read.parquet(place)
    (x, kx, ex), (y, ky, ey) = sorted(map(tuple, sealed.collect()))
    flipped = bytes(ex[:-1]) + bytes([ex[-1] ^ 1])
    for key_of_row, value in ((ky, bytes(ex)), (kx, flipped)):
        row = spark.createDataFrame([(key_of_row, bytearray(value))], "doc_key STRING, id_enc BINARY")
        opened = row.select(open_text(F.col("id_enc"), key, F.col("doc_key"), lenient=True)).first()[0]
        assert opened == base64.b64encode(value).decode()
        with pytest.raises(PySparkException):
            row.select(open_text(F.col("id_enc"), key, F.col("doc_key"))).collect()
    raw = spark.createDataFrame([(kx, bytearray(b"raw-7"))], "doc_key STRING, id_enc BINARY")
    assert raw.select(open_text(F.col("id_enc"), key, F.col("doc_key"), lenient=True)).first()[0] == "raw-7"
    with pytest.raises(PySparkException):
        raw.select(open_text(F.col("id_enc"), key, F.col("doc_key"))).collect()


def test_wrong_key_opens_nothing(spark, store, path):
    other = SealedStore(spark, store.path, load_key(spark, save_key(spark, b"z" * 16, path("key"))))
    with pytest.raises(PySparkException):
        other.ids().collect()


def test_key_is_in_no_plan(spark, store):
    queries = spark.createDataFrame([("q", [1.0, 1.0])], "query_id STRING, embedding ARRAY<DOUBLE>")
    run = search(queries, store.vectors(), 2)._jdf.queryExecution()
    text = run.toString() + run.logical().toString()
    secret = b"0123456789abcdef" * 2
    assert secret.decode() not in text and secret.hex() not in text.lower()


def test_texts_are_not_read_by_a_search(spark, store):
    queries = spark.createDataFrame([("q", [1.0, 1.0])], "query_id STRING, embedding ARRAY<DOUBLE>")
    plan = search(queries, store.vectors(), 2)._jdf.queryExecution().executedPlan().toString()
    assert "text_enc" not in plan and "vector_enc" in plan


def test_without_a_key_columns_stay_plain(spark, path):
    store = SealedStore(spark, path("open"), None)
    store.add(spark.createDataFrame(DOCS, SCHEMA))
    assert sorted(bytes(r["id_enc"]).decode() for r in store.read().collect()) == ["a", "b", "ü"]
    assert sorted(r[0] for r in store.ids(lenient=True).collect()) == ["a", "b", "ü"]


def test_adding_again_appends_and_latest_keeps_one(spark, key, path):
    store = SealedStore(spark, path("s"), key)
    many = spark.range(300).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("d"), F.col("id"))).alias("doc_id"),
        F.array(F.lit(1.0), F.lit(0.0)).alias("embedding"), F.lit("old").alias("content"),
    )
    store.add(many, version=1)
    store.add(spark.createDataFrame([("hot", [0.0, 2.0], "new")], SCHEMA), version=2)
    assert store.count() == 301
    latest = {r["doc_id"]: r["embedding"] for r in unpack_vectors(store.vectors(store.latest()).select("doc_id", "vector")).collect()}
    assert len(latest) == 201 and latest["hot"] == [0.0, 1.0] and latest["d1"] == [1.0, 0.0]


def test_last_row_of_a_batch_wins(spark, key, path):
    for made in (key, None):
        store = SealedStore(spark, path("s"), made)
        store.add(spark.createDataFrame([("a", [1.0, 0.0], "1"), ("b", [1.0, 0.0], "2"), ("a", [0.0, 1.0], "3")], SCHEMA))
        kept = unpack_vectors(store.vectors(store.latest()).select("doc_id", "vector")).collect()
        assert {r["doc_id"]: r["embedding"] for r in kept} == {"a": [0.0, 1.0], "b": [1.0, 0.0]} and len(kept) == 2


def test_repeating_a_batch_replaces_it(spark, key, path):
    for store in (SealedStore(spark, path("s"), key), PlainStore(spark, path("p"))):
        for _ in range(2):
            store.add(spark.createDataFrame(DOCS, SCHEMA), batch="b7")
        assert store.count() == 3


def test_defaults(spark, key, path):
    store = SealedStore(spark, path("s"), key)
    rows = spark.createDataFrame([(None, [1.0, 2.0], None), ("k", [1.0, 2.0], "t")], SCHEMA)
    store.add(rows)
    ids = [r[0] for r in store.ids().collect()]
    assert "k" in ids and all(ids) and len(set(ids)) == 2
    assert sorted(r[0] for r in store.content().collect()) == ["", "t"]
    with pytest.raises(ValueError, match="vectors"):
        store.add(rows.drop("embedding"))
    with pytest.raises(PySparkException, match="NaN"):
        store.add(spark.createDataFrame([("n", [float("nan")], "")], SCHEMA))


def test_unknown_store_is_empty(spark, key, path):
    for store in (SealedStore(spark, path("s"), key), PlainStore(spark, path("p"))):
        assert store.count() == 0 and store.is_empty() and store.ids().count() == 0
    queries = spark.createDataFrame([("q", [1.0, 1.0])], "query_id STRING, embedding ARRAY<DOUBLE>")
    assert search(queries, SealedStore(spark, path("s"), key).vectors(), 5).count() == 0


def test_sealed_results_equal_plain_results(spark, key, path):
    emb = spark.read.parquet(f"{SF_DIR}/embeddings.parquet")
    q = emb.select(F.col("vec_id").alias("query_id"), "embedding")
    d = emb.select(F.col("vec_id").cast("string").alias("doc_id"), "embedding")
    store = SealedStore(spark, path("s"), key)
    store.add(d)
    plain, sealed = search(q, d, 5), search(q, store.vectors(), 5)
    assert plain.exceptAll(sealed).count() == 0 and sealed.exceptAll(plain).count() == 0


def test_key_sizes(spark, path):
    with pytest.raises(ValueError):
        save_key(spark, b"short", path("key"))


def test_key_from_a_raw_file(spark, tmp_path):
    (tmp_path / "data.key").write_bytes(b"k" * 32)
    assert bytes(load_key(spark, str(tmp_path / "data.key")).first()[0]) == b"k" * 32


def tied_store(spark, key, path, corrupt=()):
    """Forty documents in the plane, three of each direction, ids out of order; the ids of ``corrupt`` do not open."""
    store = SealedStore(spark, path("late"), key)
    rows = [(f"d{(7 * i) % 40:02d}", [float(i // 3), 5.0], f"text {i}", 10 if i % 2 else 20) for i in range(40)]
    docs = spark.createDataFrame(rows, SCHEMA + ", first_size INT")
    sealed = materialize(store.seal_rows(docs, 0), "rows")
    broken = F.col("doc_key").isin([r[0] for r in spark.createDataFrame([(i,) for i in corrupt], "doc_id STRING").select(store._doc_key(F.col("doc_id"))).collect()])
    store._write(sealed.withColumn("id_enc", F.when(broken, F.reverse("id_enc").cast("binary")).otherwise(F.col("id_enc"))), "a|b-1")
    asked = spark.createDataFrame([(f"q{i}", [float(i), 4.0]) for i in range(9)], "query_id STRING, embedding ARRAY<DOUBLE>")
    return store, docs, asked


def hit_rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("k", [1, 3, 4, 50])
def test_late_opening_gives_the_hits_of_the_full_scan(spark, key, path, k):
    store, docs, asked = tied_store(spark, key, path)
    whole = search(asked, docs, k)
    assert hit_rows(evaluate_sealed(asked, store, k)) == hit_rows(whole)
    texts = whole.join(docs.select("doc_id", "content"), "doc_id").select("query_id", "rank", "doc_id", "score", "content")
    assert hit_rows(evaluate_sealed(asked, store, k, texts=True)) == hit_rows(texts)
    assert hit_rows(evaluate_sealed(asked, store, k, [10, 20])) == hit_rows(search(asked, docs, k, [10, 20]))


def test_ids_of_other_documents_stay_sealed(spark, key, path):
    """Three of each direction and k = 3: no tie at the end, so only the hits are opened."""
    asked = spark.createDataFrame([("q", [0.0, 1.0])], "query_id STRING, embedding ARRAY<DOUBLE>")
    others = [f"d{(7 * i) % 40:02d}" for i in range(3, 40)]
    store, docs, _ = tied_store(spark, key, path, others)
    assert hit_rows(evaluate_sealed(asked, store, 3)) == hit_rows(search(asked, docs, 3))
    with pytest.raises(PySparkException):
        search(asked, store.vectors(), 3).collect()
    with pytest.raises(PySparkException):  # the hits' own
        evaluate_sealed(asked, store, 6).collect()
    assert len(evaluate_sealed(asked, store, 6, lenient=True).collect()) == 6


def test_the_scan_under_the_search_reads_keys_and_vectors_only(spark, store):
    queries = spark.createDataFrame([("q", [1.0, 1.0])], "query_id STRING, embedding ARRAY<DOUBLE>")
    plan = search(queries, store.keyed_vectors(), 2)._jdf.queryExecution().executedPlan().toString()
    assert "vector_enc" in plan and "doc_key" in plan and "id_enc" not in plan and "text_enc" not in plan


def test_late_opening_of_the_latest_versions_and_of_nothing(spark, key, path):
    store = SealedStore(spark, path("s"), key)
    store.add(spark.createDataFrame(DOCS, SCHEMA), version=1)
    store.add(spark.createDataFrame(DOCS[:1], SCHEMA).withColumn("content", F.lit("new")), version=2)
    asked = spark.createDataFrame([("q", [1.0, 1.0])], "query_id STRING, embedding ARRAY<DOUBLE>")
    found = evaluate_sealed(asked, store, 10, latest=True, texts=True).collect()
    assert len(found) == 3 and sum(r["content"] == "new" for r in found) == 1
    assert len(evaluate_sealed(asked, store, 10).collect()) == 4
    assert evaluate_sealed(asked.limit(0), store, 10, texts=True).collect() == []
    empty = SealedStore(spark, path("none"), key)
    assert evaluate_sealed(asked, empty, 10).collect() == []
