"""The two-level cell index."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sealrank.operators import cell_tree, cells
from sealrank.operators.cell_tree import build_tree, search_tree
from sealrank.operators.evaluation import recall_at_k
from sealrank.operators.search import search


@pytest.fixture(scope="module")
def clustered(spark):
    """Vectors around twenty centres, a third of all copies of one, and a zero vector."""
    rng = np.random.default_rng(21)
    centers = rng.normal(size=(20, 8))
    rows = [(i, [float(x) for x in centers[i % 20] + 0.05 * rng.normal(size=8)]) for i in range(500)]
    rows += [(1000 + i, [float(x) for x in centers[0]]) for i in range(250)] + [(5000, [0.0] * 8)]
    asked = [(i, [float(x) for x in centers[i % 20] + 0.05 * rng.normal(size=8)]) for i in range(40)] + [(99, [0.0] * 8)]
    return (
        spark.createDataFrame(asked, "query_id BIGINT, embedding ARRAY<DOUBLE>"),
        spark.createDataFrame(rows, "doc_id BIGINT, embedding ARRAY<DOUBLE>").repartition(4),
    )


@pytest.fixture(scope="module")
def tree(clustered, spark):
    from sealrank.session import new_path

    place = new_path(spark, "tree")
    build_tree(clustered[1], place, 100)
    return place


def rows(df):
    return [tuple(r) for r in df.orderBy("query_id", "rank").collect()]


def test_all_cells_give_the_full_scan(clustered, tree):
    queries, docs = clustered
    assert rows(search_tree(queries, tree, 5, 10, 100)) == rows(search(queries, docs, 5))


def test_each_vector_lies_in_one_cell_of_its_branch(clustered, tree, spark):
    _, docs = clustered
    placed = spark.read.parquet(f"{tree}/vectors")
    assert placed.count() == docs.count() and placed.select("doc_id").exceptAll(docs.select("doc_id")).isEmpty()
    assert placed.filter(F.shiftright("cell", cells.FOLDER_BITS) != F.col(cells.FOLDER)).isEmpty()
    held = spark.read.parquet(f"{tree}/cells")
    assert held.agg(F.sum("n_docs")).first()[0] == docs.count()


def test_few_cells_find_most_of_what_is_near(clustered, tree):
    queries, docs = clustered
    found = search_tree(queries, tree, 5, 2, 6)
    recall = recall_at_k(found, search(queries, docs, 5)).agg(F.avg("recall")).first()[0]
    assert recall >= 0.9


def test_both_ways_to_meet_give_the_same(clustered, tree, monkeypatch):
    queries, _ = clustered
    few = search_tree(queries, tree, 5, 2, 6)
    joined = search_tree(queries, tree, 5, 2, 6, query_rows=1)
    assert "FlatMapCoGroupsInArrow" in joined._jdf.queryExecution().executedPlan().toString()
    assert rows(few) == rows(joined)
    monkeypatch.setattr(cell_tree, "GROUP_BYTES", 10 * 64)
    monkeypatch.setattr(cells, "GROUP_BYTES", 10 * 64)
    assert rows(search_tree(queries, tree, 5, 2, 6, query_rows=1)) == rows(few)


def test_more_cells_than_one_broadcast_may_hold(clustered, path, monkeypatch):
    """A hundred centroids pass the bound, which the one-level index cannot; the ten branches do not."""
    queries, docs = clustered
    monkeypatch.setattr(cells, "QUERY_BYTES", 30 * 64)
    monkeypatch.setattr(cell_tree, "QUERY_BYTES", 30 * 64)
    with pytest.raises(ValueError, match="centroids"):
        cells.build_cells(docs, path("flat"), 100)
    build_tree(docs, place := path("tree"), 100)
    assert rows(search_tree(queries, place, 3, 10, 100)) == rows(search(queries, docs, 3))


def test_folders_are_pruned(clustered, tree):
    queries, _ = clustered
    for options in ({}, {"query_rows": 1}):
        plan = search_tree(queries.limit(2), tree, 3, 1, 2, **options)._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(branch" in plan or "PartitionFilters: [branch" in plan or "dynamicpruning" in plan


def test_empty_sides_and_small_tables(clustered, tree, path):
    queries, docs = clustered
    assert search_tree(queries.limit(0), tree, 5).count() == 0
    few = docs.filter("doc_id < 3")
    build_tree(few, place := path("tree"), 50)
    assert rows(search_tree(queries, place, 5, 9, 50)) == rows(search(queries, few, 5))
    with pytest.raises(ValueError, match="n_cells"):
        build_tree(docs, path("none"), 0)
    with pytest.raises(ValueError, match="unique"):
        search_tree(queries.union(queries), tree, 5)


def test_vectors_do_not_travel_once_per_cell(clustered, tree, monkeypatch):
    """A query goes to a bundle of cells once, and vectors are not copied for every few queries."""
    queries, _ = clustered
    groups, deal = [], cells._dealt
    monkeypatch.setattr(cells, "_dealt", lambda *given: groups.append(deal(*given)) or groups[-1])
    search_tree(queries, tree, 5, 10, 100, query_rows=1)
    ((left, right),) = groups
    assert right.count() == queries.count() * left.select("cell").distinct().count() <= queries.count() * 10
    assert left.count() == 751 * cells.QUERY_PARTS
