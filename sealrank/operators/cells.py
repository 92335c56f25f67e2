"""A cell index for cosine search: vectors grouped around sampled centroids.

``build_cells`` writes the vectors in one folder per cell with, per cell, how far its
vectors reach from the centroid. ``search_cells`` joins queries and vectors by cell: each query
goes to its nearest cells, and only the folders of those are read.
The exact form then also reads every cell whose reach could still hold a better hit, so
its result is that of the full scan; the approximate form stops at ``nprobe`` cells, which
is what an approximate collection does, and ``recall_at_k`` tells what that cost.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from sealrank.functions import arrow
from sealrank.functions.vectors import l2_norm, widen
from sealrank.operators.best import BestHits, offer_all
from sealrank.operators.packing import pack_vectors, unpack_vectors
from sealrank.operators.search import QUERY_BYTES, QUERY_ROWS, QueryBlock, emit, hit_fields, rank_hits, scan_hits
from sealrank.operators.selection import hash_rank, smallest
from sealrank.session import materialize

MAX_CELLS = 65_536
# Queries times cells that a task scores at once, and bytes of vectors that meet in one group.
SCORES_AT_ONCE = 1 << 22
GROUP_BYTES = 32 << 20
# A cell tree has folders of cells; a cell's number then begins with that of its folder.
FOLDER, FOLDER_BITS = "branch", 20
# Into how many parts the queries of a group of cells are dealt, unless bytes ask for more: each part copies the vectors.
QUERY_PARTS = 16
ASKED = [T.StructField("bundle", T.LongType()), T.StructField("cells", T.ArrayType(T.LongType()))]
CENTROIDS = "cell INT, centroid ARRAY<DOUBLE>, n_docs BIGINT, min_fit DOUBLE"


def pick_centroids(docs: DataFrame, n_cells: int, seed: int = 42) -> np.ndarray:
    """A vector of each of the ``n_cells`` ids of lowest hash rank, normalised, in id order.

    Ids are drawn without their copies, so at most ``n_cells`` rows are fetched.
    """
    ids = docs.select("doc_id").distinct().withColumn("order", hash_rank(F.col("doc_id"), seed))
    drawn = F.broadcast(smallest(ids, "order", "doc_id", n_cells).select("doc_id"))
    one = docs.select("doc_id", "vector").join(drawn, "doc_id").groupBy("doc_id").agg(F.min("vector").alias("vector"))
    picked = one.orderBy("doc_id").select("vector").toArrow()
    return arrow.unit_rows(arrow.as_matrix(picked["vector"]))


def train_centroids(docs: DataFrame, n_cells: int, rounds: int, seed: int = 42, per_cell: int | None = None) -> np.ndarray:
    """K-means centroids by cosine from all vectors, or from a repeatable sample of ``per_cell`` per cell."""
    ranked = docs.select("doc_id", "vector", hash_rank(F.col("doc_id"), seed).alias("order"))
    sample = materialize(ranked if per_cell is None else smallest(ranked, "order", "doc_id", per_cell * n_cells), "train")
    if isinstance(sample.schema["vector"].dataType, T.BinaryType):
        sample = unpack_vectors(sample.select("vector")).withColumnRenamed("embedding", "vector")
    points = sample.filter(l2_norm(F.col("vector")) > 0).select(array_to_vector("vector").alias("features"))
    model = KMeans(k=n_cells, maxIter=rounds, seed=seed, distanceMeasure="cosine").fit(points)
    return arrow.unit_rows(np.array(model.clusterCenters()))


def assign_cells(docs: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``cell``, the nearest centroid (the first of equals), and ``fit``, the cosine with it."""
    schema = T.StructType(list(docs.schema)).add("cell", T.IntegerType()).add("fit", T.DoubleType())
    sent = docs.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centers = sent.value
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                scores = arrow.unit_rows(arrow.as_matrix(batch.column("vector"), centers.shape[1])) @ centers.T
                cell = np.argmax(np.round(scores, 12), axis=1)
                yield arrow.replace_columns(
                    batch, (),
                    cell=pa.array(cell.astype(np.int32)),
                    fit=pa.array(scores[np.arange(len(cell)), cell]),
                )

    return docs.mapInArrow(run, schema)


def _docs(df: DataFrame) -> DataFrame:
    return df if "vector" in df.columns else df.withColumn("vector", widen(F.col("embedding"))).drop("embedding")


def build_cells(docs: DataFrame, path: str, n_cells: int, seed: int = 42, rounds: int = 0, mode: str = "error") -> None:
    """Write the index of ``docs`` (``doc_id`` and ``embedding`` or ``vector``) to ``path``.

    ``first_size`` is kept where there is one, for searches of samples. The centroids are written last.

    The index holds the vectors in the clear, like the plain store.

    Centroids are sampled vectors, or with ``rounds`` those of that many rounds of k-means.

    The rebalance hint groups rows by cell and splits the cells that are too large for a
    task, so a cell that holds a third of all vectors does not hold up the write.
    """
    if not 1 <= n_cells <= MAX_CELLS:
        raise ValueError(f"n_cells must lie between 1 and {MAX_CELLS}")
    spark = docs.sparkSession
    docs = _docs(docs)
    docs = docs.select("doc_id", "vector", *[c for c in docs.columns if c == "first_size"])
    centroids = train_centroids(docs, n_cells, rounds, seed) if rounds else pick_centroids(docs, n_cells, seed)
    if centroids.nbytes > QUERY_BYTES:
        raise ValueError("the centroids are too large to be sent to every task; use fewer cells")
    assigned = assign_cells(docs, centroids)
    assigned.hint("rebalance", "cell").write.mode(mode).partitionBy("cell").parquet(f"{path}/vectors")
    table = pa.table({
        "cell": pa.array(np.arange(len(centroids), dtype=np.int32)),
        "centroid": arrow.list_column(centroids),
    })
    reach = spark.read.parquet(f"{path}/vectors").groupBy("cell").agg(
        F.count("*").alias("n_docs"), F.min("fit").alias("min_fit")
    )
    spark.createDataFrame(table).join(reach, "cell", "left").select(
        "cell", "centroid", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), "min_fit"
    ).coalesce(1).write.mode(mode).parquet(f"{path}/centroids")


def _tagged(vectors: DataFrame, sizes: list[int] | None) -> DataFrame:
    """``cell, doc_id, vector`` and, with ``sizes`` (in ascending order), ``tag``: which is the smallest of the samples that
    hold the document. Documents of none are left out."""
    if sizes is None:
        return vectors.select("cell", "doc_id", "vector")
    smaller = F.size(F.filter(F.array(*map(F.lit, sizes)), lambda s: s < F.col("first_size")))
    rows = vectors.filter(F.col("first_size").isNotNull() & (smaller < len(sizes)))
    return rows.select("cell", "doc_id", "vector", smaller.alias("tag"))


@dataclass(frozen=True)
class CellTable:
    """The cells of an index as every task knows them."""

    centroids: np.ndarray
    n_docs: np.ndarray
    min_fit: np.ndarray

    def nearest(self, scores: np.ndarray, nprobe: int) -> np.ndarray:
        """The ``nprobe`` nearest cells with vectors of each query, the first of equals."""
        filled = np.flatnonzero(self.n_docs > 0)
        return filled[np.argsort(-np.round(scores[:, filled], 12), axis=1, kind="stable")[:, :nprobe]]

    def within_reach(self, scores: np.ndarray, floor: np.ndarray, nprobe: int) -> np.ndarray:
        """Which other cells may hold a vector that scores at least ``floor``, as a boolean matrix."""
        angle, reach = np.arccos(np.clip(scores, -1, 1)), np.arccos(np.clip(self.min_fit, -1, 1))
        bound = np.cos(np.maximum(0.0, angle - reach[None, :]))
        rest = (bound >= floor[:, None] - 1e-9) & (self.n_docs > 0)[None, :]
        np.put_along_axis(rest, self.nearest(scores, nprobe), False, axis=1)
        return rest


def read_cells(spark: SparkSession, path: str) -> CellTable:
    """At most ``MAX_CELLS`` rows and ``QUERY_BYTES`` of centroids, as ``build_cells`` sees to."""
    cells = spark.read.schema(CENTROIDS).parquet(f"{path}/centroids").orderBy("cell").toArrow()
    return CellTable(
        arrow.as_matrix(cells["centroid"]), cells["n_docs"].to_numpy(), cells["min_fit"].to_pandas().fillna(1.0).to_numpy()
    )


def group_rows(width: int) -> int:
    """Vectors, and queries, that meet in one group."""
    return max(1, GROUP_BYTES // (8 * max(1, width)))


def bundles(n_docs: np.ndarray, width: int) -> np.ndarray:
    """Per cell the first cell of its bundle: neighbours in number that hold about a group of vectors together."""
    place = (np.cumsum(n_docs) - n_docs) // group_rows(width)
    return np.unique(place, return_index=True)[1][np.searchsorted(np.unique(place), place)]


def probes(queries: DataFrame, table: CellTable, nprobe: int) -> DataFrame:
    """``query_id, vector, bundle, cells``: the cells each query looks at, a row per bundle of them, found in the tasks
    that hold the queries.

    ``queries`` has ``query_id`` and a packed unit ``vector``. Where it has ``floor``, the cells are those beyond
    the ``nprobe`` nearest that may still hold a vector of that score.
    """
    sent = queries.sparkSession.sparkContext.broadcast((table, bundles(table.n_docs, table.centroids.shape[1])))
    floored = "floor" in queries.columns
    step = max(1, SCORES_AT_ONCE // max(1, len(table.centroids)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, bundle = sent.value
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                scores = arrow.as_matrix(batch.column("vector"), cells.centroids.shape[1]) @ cells.centroids.T
                if floored:
                    row, cell = np.nonzero(cells.within_reach(scores, batch.column("floor").to_numpy(), nprobe))
                else:
                    near = cells.nearest(scores, nprobe)
                    row, cell = np.repeat(np.arange(len(near)), near.shape[1]), near.ravel()
                order = np.lexsort((cell, row))  # a bundle's cells are neighbours
                row, cell = row[order], cell[order]
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (bundle[cell[1:]] != bundle[cell[:-1]])
                starts = np.flatnonzero(new)
                ends = np.r_[starts, len(row)]
                for low in range(0, len(starts), 4096):
                    own = starts[low:low + 4096]
                    offsets = ends[low:low + len(own) + 1]
                    lists = pa.ListArray.from_arrays(pa.array((offsets - offsets[0]).astype(np.int32)), pa.array(cell[offsets[0]:offsets[-1]].astype(np.int64)))
                    rows = pa.array(row[own])
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("query_id").take(rows), batch.column("vector").take(rows), pa.array(bundle[cell[own]].astype(np.int64)), lists],
                        ["query_id", "vector", "bundle", "cells"],
                    )

    schema = T.StructType([queries.schema["query_id"], T.StructField("vector", T.BinaryType()), *ASKED])
    return queries.mapInArrow(run, schema)


def _scan_in_cells(asked: DataFrame, vectors: DataFrame, k: int, sizes: list[int] | None) -> DataFrame:
    """``meet_in_cells`` for few queries: a scan of their cells that knows which queries look at a cell."""
    pairs = asked.toArrow().combine_chunks()
    lists, ids = pairs["cells"].combine_chunks(), pairs["query_id"].combine_chunks().dictionary_encode()
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    if isinstance(ids, pa.ChunkedArray):
        ids = ids.combine_chunks()
    row = ids.indices.to_numpy(zero_copy_only=False)
    first = np.unique(row, return_index=True)[1]
    block = QueryBlock(ids.dictionary, arrow.as_matrix(pairs["vector"].take(pa.array(first))))
    cells, row = lists.flatten().to_numpy(), np.repeat(row, pc.list_value_length(lists).to_numpy())
    look = {int(c): row[cells == c] for c in np.unique(cells)}
    near = vectors.filter(F.col("cell").isin(list(look)))
    if FOLDER in vectors.columns:
        near = near.filter(F.col(FOLDER).isin(sorted({cell >> FOLDER_BITS for cell in look})))
    if sizes is None:
        return scan_hits(block, near.withColumnRenamed("cell", "tag"), k, subsets=look)
    n = len(sizes)
    groups = {cell * n + i: sizes[i:] for cell in look for i in range(n)}
    near = near.withColumn("tag", (F.col("cell") * n + F.col("tag")).cast("int"))
    return scan_hits(block, near, k, groups, {tag: look[tag // n] for tag in groups})


def _dealt(asked: DataFrame, vectors: DataFrame, loads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vectors and queries with the parts of their bundle, in ``cell``, that they go to; ``own_cell`` is a vector's cell."""
    within, keys = loads.filter(F.col("n_asked") > 0).drop("n_asked"), ["cell"]
    bundle = F.broadcast(within.select("bundle", "doc_parts", "query_parts").distinct())
    if FOLDER in vectors.columns:
        keys = ["cell", FOLDER]
        within = within.withColumn(FOLDER, F.shiftright("cell", FOLDER_BITS).cast("int"))
    within = F.broadcast(within)
    # Places within a task tell copies of a row apart, so a cell of copies is dealt evenly too.
    place = F.xxhash64(F.monotonically_increasing_id())
    others = [c for c in vectors.columns if c not in keys]
    left = vectors.join(within, keys).withColumn("place", place).select(
        F.col("bundle").alias("cell"), F.col("cell").alias("own_cell"), *others, F.pmod("place", "doc_parts").cast("int").alias("doc_part"),
        F.explode(F.sequence(F.lit(0), F.col("query_parts") - 1)).alias("query_part"),
    )
    right = asked.join(bundle, "bundle").withColumn("place", place).select(
        "query_id", F.col("vector").alias("query"), F.col("bundle").alias("cell"), "cells", F.pmod("place", "query_parts").cast("int").alias("query_part"),
        F.explode(F.sequence(F.lit(0), F.col("doc_parts") - 1)).alias("doc_part"),
    )
    return left, right


def meet_in_cells(
    asked: DataFrame, vectors: DataFrame, cells: DataFrame, k: int, width: int, sizes: list[int] | None = None, query_rows: int = QUERY_ROWS
) -> DataFrame:
    """The best k hits of each query among the vectors of its cells, per task or group that holds some of them.

    ``asked`` (``query_id, vector, bundle, cells``; written) and ``vectors`` (``cell, doc_id, vector[, tag]``) meet by
    bundle of cells. Up to 8 times ``query_rows`` cells asked for and ``QUERY_BYTES`` of ``asked`` go to the tasks that scan
    the vectors, which do not move. Beyond that both meet in groups: a query goes once to a bundle, with the cells
    that it looks at there. A bundle with more vectors or queries than a group may hold is dealt over several: each
    vector goes to one part of the vectors and every part of the queries, each query the other way round, so every
    pair meets once. Parts have ``query_rows`` queries, or more where that made over ``QUERY_PARTS`` copies of the
    vectors. ``cells`` (``cell, n_docs``) gives the sizes; its rows for the cells asked for are what the join
    broadcasts. Either way the cells asked for prune the folders of the vectors.
    """
    n_asked, volume = asked.agg(F.sum(F.size("cells")), F.sum(F.octet_length("vector"))).first()
    if (n_asked or 0) <= 8 * query_rows and (volume or 0) <= QUERY_BYTES:
        return _scan_in_cells(asked, vectors, k, sizes)
    most = F.lit(group_rows(width))
    wanted = asked.select("bundle", F.explode("cells").alias("cell")).distinct().join(cells.select("cell", "n_docs"), "cell")
    queries = asked.groupBy("bundle").agg(F.count("*").alias("n_asked"))
    parts = wanted.groupBy("bundle").agg(F.sum("n_docs").alias("n_docs")).join(queries, "bundle").select(
        "bundle", "n_asked", F.ceil(F.col("n_docs") / most).cast("int").alias("doc_parts"),
        F.greatest(
            F.ceil(F.col("n_asked") / most), F.least(F.ceil(F.col("n_asked") / F.lit(query_rows)), F.lit(QUERY_PARTS))
        ).cast("int").alias("query_parts"),
    )
    loads = materialize(wanted.drop("n_docs").join(parts, "bundle"), "loads")
    left, right = _dealt(asked, vectors, loads)
    query_type = asked.schema["query_id"].dataType
    schema = hit_fields(vectors, query_type, None if sizes is None else T.IntegerType())
    labels = [None] if sizes is None else list(sizes)

    def best(docs: pa.Table, queries: pa.Table) -> pa.Table:
        own = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema])
        ids, found = queries["query_id"].combine_chunks(), []
        if len(ids) and docs.num_rows:
            matrix, bests = arrow.as_matrix(queries["query"]), [BestHits(len(ids), k) for _ in labels]
            lists, place = queries["cells"].combine_chunks(), docs["own_cell"].to_numpy()
            asked_for, asking = lists.flatten().to_numpy(), np.repeat(np.arange(len(ids)), pc.list_value_length(lists).to_numpy())
            for cell in np.unique(place):
                look = asking[asked_for == cell]
                if len(look) == 0:
                    continue
                rows_asked, here = matrix[look], np.flatnonzero(place == cell)
                for low in range(0, len(here), 4096):
                    batch = docs.take(pa.array(here[low:low + 4096])).combine_chunks().to_batches()[0]
                    rows = arrow.unit_rows(arrow.as_matrix(batch.column("vector"), matrix.shape[1]))
                    if sizes is None:
                        offer_all(bests, rows_asked, look, rows, batch.column("doc_id"))
                        continue
                    tags = batch.column("tag").to_numpy()
                    for tag in np.unique(tags):
                        at = np.flatnonzero(tags == tag)
                        offer_all(bests[tag:], rows_asked, look, rows[at], batch.column("doc_id").take(pa.array(at)))
            for label, one in zip(labels, bests):
                found += emit(one, ids, label, sizes is not None)
        return pa.Table.from_batches([pa.RecordBatch.from_arrays(b.columns, schema=own) for b in found], own)

    keys = ["cell", "doc_part", "query_part"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(best, schema)


def search_cells(
    queries: DataFrame,
    path: str,
    k: int = 5,
    nprobe: int = 8,
    exact: bool = True,
    query_rows: int = QUERY_ROWS,
    sizes: list[int] | None = None,
) -> DataFrame:
    """Top-k through the index: ``query_id, rank, doc_id, score``, for a query table of any size in one pass.

    Queries find their cells in the tasks that hold them, and meet the vectors by cell; see ``meet_in_cells`` for
    ``query_rows``. With ``sizes``, in the approximate form only, there is one ranking per sample.
    """
    if sizes is not None and exact:
        raise ValueError("samples are searched in the approximate form only")
    sizes = None if sizes is None else sorted(sizes)
    spark, table = queries.sparkSession, read_cells(queries.sparkSession, path)
    width = table.centroids.shape[1]
    if not queries.groupBy("query_id").count().filter("count > 1").isEmpty():
        raise ValueError("query_id is not unique")
    packed = pack_vectors(queries.select("query_id", widen(F.col("embedding")).alias("embedding")))
    # Parquet gives the cell of a folder back as it was written.
    vectors = _tagged(spark.read.parquet(f"{path}/vectors").withColumn("cell", F.col("cell").cast("int")), sizes)
    cells = spark.read.schema(CENTROIDS).parquet(f"{path}/centroids")

    asked = materialize(probes(packed, table, nprobe), "probes")
    hits = rank_hits(meet_in_cells(asked, vectors, cells, k, width, sizes, query_rows), k)
    if not exact:
        return hits
    hits = materialize(hits, "probe")
    floor = hits.filter(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
    floored = packed.join(floor, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    more = materialize(probes(floored, table, nprobe), "probes")
    if more.isEmpty():
        return hits
    rest = meet_in_cells(more, vectors, cells, k, width, None, query_rows)
    return rank_hits(hits.drop("rank").unionByName(rest), k)
