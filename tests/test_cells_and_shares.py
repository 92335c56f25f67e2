import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sealrank.operators import answers, cells, shares
from sealrank.operators.cells import build_cells, search_cells
from sealrank.operators.packing import pack_vectors
from sealrank.operators.search import search
from sealrank.session import materialize
from tests.conftest import SF_DIR


@pytest.fixture(scope="module")
def skewed(spark):
    """Clustered vectors, a third of which are copies of one, with a zero vector."""
    rng = np.random.default_rng(11)
    centers = rng.normal(size=(6, 8))
    rows = [(i, [float(x) for x in centers[i % 6] + 0.3 * rng.normal(size=8)]) for i in range(400)]
    rows += [(1000 + i, [float(x) for x in centers[0]]) for i in range(200)] + [(5000, [0.0] * 8)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, embedding ARRAY<DOUBLE>")
    asked = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(30)] + [(99, [0.0] * 8), (98, rows[400][1])]
    return spark.createDataFrame(asked, "query_id BIGINT, embedding ARRAY<DOUBLE>"), docs


def rows(df):
    return [tuple(r) for r in df.orderBy("query_id", "rank").collect()]


@pytest.mark.parametrize("nprobe", [1, 3, 12])
def test_exact_form_equals_the_full_scan(skewed, path, nprobe):
    queries, docs = skewed
    build_cells(docs, place := path("cells"), 12)
    assert rows(search_cells(queries, place, 5, nprobe)) == rows(search(queries, docs, 5))
    small = {"query_rows": 24}
    assert rows(search_cells(queries, place, 5, nprobe, **small)) == rows(search(queries, docs, 5))
    probed = rows(search_cells(queries, place, 5, nprobe, exact=False))
    assert probed == rows(search_cells(queries, place, 5, nprobe, exact=False, **small))
    if nprobe == 12:
        assert probed == rows(search(queries, docs, 5))


def test_trained_centroids(skewed, path):
    queries, docs = skewed
    build_cells(docs, place := path("cells"), 12, rounds=4)
    assert rows(search_cells(queries, place, 5, 2)) == rows(search(queries, docs, 5))
    assert docs.sparkSession.read.parquet(f"{place}/vectors").count() == docs.count()
    build_cells(pack_vectors(docs), packed := path("cells"), 12, rounds=4)
    assert rows(search_cells(queries, packed, 5, 2)) == rows(search(queries, docs, 5))


def test_more_cells_than_vectors_is_refused_or_small(skewed, path):
    queries, docs = skewed
    with pytest.raises(ValueError, match="n_cells"):
        build_cells(docs, path("cells"), 0)
    few = docs.filter("doc_id < 3")
    build_cells(few, place := path("cells"), 16)
    assert rows(search_cells(queries, place, 5, 2)) == rows(search(queries, few, 5))
    assert search_cells(queries.limit(0), place, 5, 2).count() == 0


def test_cells_are_pruned(skewed, path, spark):
    queries, docs = skewed
    build_cells(docs, place := path("cells"), 12)
    plan = search_cells(queries.limit(1), place, 5, 1, exact=False)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan or "PartitionFilters: [cell" in plan


def test_queries_beyond_the_bound_meet_vectors_by_cell(skewed, path, monkeypatch):
    """Neither side is broadcast or collected: what is broadcast has a row per cell."""
    queries, docs = skewed
    build_cells(docs, place := path("cells"), 12)
    monkeypatch.setattr(cells, "GROUP_BYTES", 50 * 64)  # fifty vectors to a group
    found = search_cells(queries, place, 5, 4, exact=False, query_rows=3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "MapInArrow" not in plan.replace("FlatMapCoGroupsInArrow", "")
    assert "dynamicpruning" in plan and plan.count("BroadcastExchange") >= 1
    assert rows(found) == rows(search_cells(queries, place, 5, 4, exact=False))
    assert rows(search_cells(queries, place, 5, 2, query_rows=3)) == rows(search(queries, docs, 5))


def test_a_cell_of_copies_is_dealt_evenly(skewed, path, monkeypatch):
    """A third of all vectors are copies of one: groups of about 20 vectors and one query all the same."""
    queries, docs = skewed
    build_cells(docs, place := path("cells"), 3)
    monkeypatch.setattr(cells, "GROUP_BYTES", 20 * 64)
    groups, deal = [], cells._dealt
    monkeypatch.setattr(cells, "_dealt", lambda *given: groups.append(deal(*given)) or groups[-1])
    search_cells(queries, place, 5, 3, exact=False, query_rows=1).count()
    ((left, right),) = groups
    by = ("cell", "doc_part", "query_part")
    assert left.groupBy(*by).count().agg(F.max("count")).first()[0] <= 45
    assert right.groupBy(*by).count().agg(F.max("count")).first()[0] <= 8


def test_repeated_query_ids_are_an_error(skewed, path):
    queries, docs = skewed
    build_cells(docs, place := path("cells"), 4)
    with pytest.raises(ValueError, match="unique"):
        search_cells(queries.union(queries), place, 5, 2)


def test_samples_over_the_join(skewed, path):
    queries, docs = skewed
    sized = docs.withColumn("first_size", F.when(F.col("doc_id") % 3 == 0, 100).when(F.col("doc_id") % 3 == 1, 300))
    build_cells(sized, place := path("cells"), 6)
    one = search_cells(queries, place, 4, 6, exact=False, sizes=[100, 300])
    two = search_cells(queries, place, 4, 6, exact=False, sizes=[100, 300], query_rows=2)
    by = lambda df: sorted(map(tuple, df.collect()))
    assert by(one) == by(two) == by(search(queries, sized, 4, [100, 300]))


def test_share_search(skewed, key):
    queries, docs = skewed
    first, second = (materialize(shares.split_vectors(docs, key, i), "share") for i in (0, 1))
    want, got = rows(search(queries, docs, 5)), rows(shares.search_shares(queries, first, second, 5))
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want], abs=1e-8)
    assert sum(g[2] == w[2] for g, w in zip(got, want)) >= len(want) - 3


def test_many_queries_over_shares(skewed, key, monkeypatch):
    queries, docs = skewed
    first, second = (materialize(shares.split_vectors(docs, key, i), "share") for i in (0, 1))
    whole = rows(shares.search_shares(queries, first, second, 3))
    cut = shares.query_block
    monkeypatch.setattr(shares, "query_block", lambda q: cut(q, rows=10))
    monkeypatch.setattr(shares, "QUERY_ROWS", 10)
    assert rows(shares.search_shares(queries, first, second, 3)) == whole
    assert shares.search_shares(queries.limit(0), first, second, 3).count() == 0


def test_pieces_of_a_query_block(skewed, key, monkeypatch):
    queries, docs = skewed
    first, second = (materialize(shares.split_vectors(docs, key, i), "share") for i in (0, 1))
    block = shares.query_block(queries)
    assert shares.score_share(block, first).count() == docs.count()
    with pytest.raises(PySparkException, match="width"):
        narrow = shares.query_block(queries.withColumn("embedding", F.slice("embedding", 1, 4)))
        shares.score_share(narrow, first).collect()


def test_shares_hide_and_restore(spark, key):
    docs = spark.read.parquet(f"{SF_DIR}/embeddings.parquet").select(F.col("vec_id").alias("doc_id"), "embedding")
    tables = [materialize(shares.split_vectors(docs, key, i), "share") for i in (0, 1)]
    again = shares.split_vectors(docs.repartition(5), key, 1)
    assert tables[1].exceptAll(again).count() == 0, "a task that runs again makes the same share"
    vectors = {r["doc_id"]: np.array(r["embedding"], float) for r in docs.collect()}
    clear = np.concatenate([vectors[i] for i in sorted(vectors)])
    for table in tables:
        held = {r["doc_id"]: np.frombuffer(bytes(r["share"]), "<u4")[:64].astype(float) for r in table.collect()}
        share = np.concatenate([held[i] for i in sorted(held)])
        assert abs(np.corrcoef(share, clear)[0, 1]) < 0.03
        assert abs(share.mean() / shares.PRIMES[0] - 0.5) < 0.01
    back = {r["doc_id"]: np.array(r["embedding"]) for r in shares.join_shares(*tables).collect()}
    for i, v in vectors.items():
        assert np.allclose(back[i], v / np.linalg.norm(v), atol=2**-30)


def test_copies_and_versions_in_shares(spark, key):
    made = [("hot", [1.0, 0.0])] * 300 + [("hot", [0.0, 1.0]), ("other", [0.6, 0.8])]
    docs = spark.createDataFrame(made, "doc_id STRING, embedding ARRAY<DOUBLE>").repartition(4)
    first, second = (materialize(shares.split_vectors(docs, key, i), "share") for i in (0, 1))
    queries = spark.createDataFrame([("q", [0.0, 2.0])], "query_id STRING, embedding ARRAY<DOUBLE>")
    assert [r[2] for r in rows(shares.search_shares(queries, first, second, 5))] == ["hot", "other", "hot", "hot", "hot"]
    assert shares.join_shares(first, second).count() == 302


def test_modular_product_is_exact():
    rng = np.random.default_rng(5)
    for prime in shares.PRIMES:
        a, b = (rng.integers(0, prime, size=(7, 300)) for _ in range(2))
        a[0], b[0] = prime - 1, prime - 1
        want = [[sum(int(x) * int(y) for x, y in zip(r, c)) % prime for c in b] for r in a]
        assert shares._product_mod(a, b, prime).tolist() == want


def test_centroids_of_a_repeated_id(spark):
    rows = spark.range(3000).select(F.lit("same").alias("doc_id"), F.array(F.lit(1.0), F.lit(0.0)).alias("vector"))
    rows = rows.unionByName(spark.range(20).select(F.col("id").cast("string").alias("doc_id"), F.array(F.col("id") + 1.0, F.lit(1.0)).alias("vector")))
    assert len(cells.pick_centroids(rows, 8)) == 8


def test_share_search_keeps_copies(spark, key):
    rows = [("a", [1.0, 0.1])] * 3 + [("b", [0.9, 0.4])] + [("c", [0.0, 1.0])] * 7
    docs = spark.createDataFrame(rows, "doc_id STRING, embedding ARRAY<DOUBLE>")
    asked = spark.createDataFrame([("q", [1.0, 0.0]), ("r", [0.0, 1.0])], "query_id STRING, embedding ARRAY<DOUBLE>")
    split = [materialize(shares.split_vectors(docs, key, i), "share") for i in (0, 1)]
    found, exact = (
        sorted((r["query_id"], r["rank"], r["doc_id"]) for r in hits.collect())
        for hits in (shares.search_shares(asked, *split, 5), search(asked, docs, 5))
    )
    assert found == exact
    assert shares.join_shares(*split).count() == 11
    plan = shares.search_shares(asked, *split, 5)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan


def test_shares_by_cell(skewed, key, path, spark, monkeypatch):
    queries, docs = skewed
    shares.build_share_cells(docs, key, place := path("shares"), 12)
    both = [shares.share_table(spark, place, holder) for holder in (0, 1)]
    back = {r["doc_id"]: r["embedding"] for r in shares.join_shares(*both).collect()}
    assert len(back) == docs.count()
    want, got = rows(search(queries, docs, 5)), rows(shares.search_share_cells(queries, place, 5, 12))
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want], abs=1e-8)
    found = rows(shares.search_share_cells(queries, place, 5, 4))
    hit = {(q, round(s, 6)) for q, _, _, s in found}
    assert sum((q, round(s, 6)) in hit for q, _, _, s in want) >= 0.9 * len(want)
    cut = shares.query_block
    monkeypatch.setattr(shares, "query_block", lambda q: cut(q, rows=10))
    monkeypatch.setattr(shares, "QUERY_ROWS", 10)
    assert rows(shares.search_share_cells(queries, place, 5, 4)) == found
    assert shares.search_share_cells(queries.limit(0), place, 5, 4).count() == 0


def test_only_probed_cells_are_scored(skewed, key, path, spark):
    """A holder returns a row per document of the probed cells, and reads no other folder."""
    queries, docs = skewed
    shares.build_share_cells(docs, key, place := path("shares"), 12)
    block, table = shares.query_block(queries.filter("query_id = 3")), shares.share_table(spark, place, 0)
    sizes = {r["cell"]: r["count"] for r in table.groupBy("cell").count().collect()}
    for nprobe in (1, 3, 12):
        look = shares.queries_of_cells(block, cells.read_cells(spark, place), nprobe)
        scored = shares.score_share(block, table.filter(F.col("cell").isin(list(look))), look)
        assert scored.count() == sum(sizes[c] for c in look) and len(look) == min(nprobe, len(sizes))
        plan = scored._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [cell" in plan or "PartitionFilters: [isnotnull(cell" in plan


def test_answers_of_the_holders_do_not_go_through_the_driver(skewed, key, path):
    """Spark takes a holder's answer for as small as its share table; it must not broadcast it all the same."""
    queries, docs = skewed
    first, second = (materialize(shares.split_vectors(docs, key, i), "share") for i in (0, 1))
    shares.build_share_cells(docs, key, place := path("shares"), 12)
    for found in (shares.search_shares(queries, first, second, 3), shares.search_share_cells(queries, place, 3, 4)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "ShuffledHashJoin" in plan and "Broadcast" not in plan
    block = shares.query_block(queries)
    many = shares.reconstruct_hits(block, shares.score_share(block, first), shares.score_share(block, second), 3, n_scores=shares.PART_BYTES * 2)
    assert "REPARTITION_BY_NUM" in many._jdf.queryExecution().executedPlan().toString()
    assert rows(many) == rows(shares.search_shares(queries, first, second, 3))


@pytest.mark.parametrize("width", [1, 64, 300, 3000, 70_000])
def test_modular_product_of_any_width(width):
    """Where residues are largest and all of one sign."""
    for prime in shares.PRIMES:
        a = np.array([[prime - 1] * width, [prime // 2] * width, [prime // 2 + 1] * width])
        want = [[int(x) * int(y) * width % prime for y in a[:, 0]] for x in a[:, 0]]
        assert shares._product_mod(a, a, prime).tolist() == want


@pytest.mark.parametrize("width", [1, 2, 64, 100, 4097])
def test_modular_product_is_one_matrix_product_and_holds_at_its_bounds(width, monkeypatch):
    p, calls = shares.PRIMES[0], []
    remainder = shares._remainder
    monkeypatch.setattr(shares, "_remainder", lambda x, *rest: calls.append(np.abs(x).max()) or remainder(x, *rest))
    # Residues whose signed form is largest on either side, so that sums of products are, too.
    left, right = (np.full((2, width), [[v], [w]]) for v, w in ((p // 2, p // 2 + 1), (p // 2 + 1, p // 2)))
    found = shares._product_mod(left, right, p)
    assert found.tolist() == [[int(a[0]) * int(b[0]) * width % p for b in right] for a in left]
    assert max(calls) <= 1 << 53 and len(calls) == (1 if width <= shares.DIMENSIONS_AT_ONCE else 3)


def test_answers_to_many_queries_are_files(skewed, key, path, spark, monkeypatch):
    """Rows of the holders' jobs hold places only; the files are gone after each block, and the settings as before."""
    queries, docs = skewed
    first, second = (materialize(shares.split_vectors(docs, key, i), "share") for i in (0, 1))
    shares.build_share_cells(docs, key, place := path("shares"), 12)
    want = [rows(shares.search_shares(queries, first, second, 5)), rows(shares.search_share_cells(queries, place, 5, 4))]
    monkeypatch.setattr(shares, "ANSWER_BYTES", 16 * docs.count() * 7)
    monkeypatch.setattr(shares, "LEAST_QUERIES", 7)
    folders, blocks, score = set(), [], shares.score_share

    def seen(block, table, look=None, folder=None):
        scored = score(block, table, look, folder)
        folders.add(folder)
        blocks.append(len(block))
        assert scored.schema["partial"].dataType.simpleString() == "struct<file:string,at:bigint>"
        assert spark.conf.get("spark.sql.shuffle.partitions") == str(spark.sparkContext.defaultParallelism)
        return scored

    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        monkeypatch.setattr(shares, "score_share", seen)
        assert rows(shares.search_shares(queries, first, second, 5)) == want[0]
        assert max(blocks) <= 7 and sum(blocks) == 2 * queries.count()
        assert rows(shares.search_share_cells(queries, place, 5, 4)) == want[1]
        assert spark.conf.get("spark.sql.shuffle.partitions") == "13"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(folders) > 5 and not any(os.path.exists(f.removeprefix("file:")) for f in folders)
    # Where tasks cannot read the shared folder, answers are rows.
    monkeypatch.setattr(shares, "score_share", score)
    monkeypatch.setattr(shares, "tasks_can_read", lambda path: False)
    assert rows(shares.search_shares(queries, first, second, 5)) == want[0]
    cut = shares.query_block
    monkeypatch.setattr(shares, "query_block", lambda q: cut(q, rows=10))
    monkeypatch.setattr(shares, "QUERY_ROWS", 10)
    assert rows(shares.search_shares(queries, first, second, 5)) == want[0]


def test_files_of_answers(spark, monkeypatch):
    """Rows are found by their places, with few files open, and a short file is an error."""
    monkeypatch.setattr(answers, "OPEN_FILES", 2)
    numbers = np.arange(5 * 3 * 4, dtype="<u4").reshape(5, 3, 4)
    with pytest.raises(OSError, match="ends before"), answers.answer_folder(spark) as folder:
        places = []
        for part in numbers:
            writer = answers.AnswerWriter(folder)
            places += [writer.write(part[:1]), writer.write(part[1:])]
            writer.close()
        answers.AnswerWriter(folder).close()
        assert len(os.listdir(folder.removeprefix("file:"))) == 5
        reader, order = answers.AnswerReader(folder), np.random.default_rng(1).permutation(15)
        assert (reader.read(pa.concat_arrays(places).take(pa.array(order)), 4) == numbers.reshape(15, 4)[order]).all()
        assert len(reader.files) <= 2
        reader.read(places[-1], 5)
    assert not os.path.exists(folder.removeprefix("file:"))
