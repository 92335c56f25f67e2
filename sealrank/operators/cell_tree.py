"""A cell index of two levels, for more cells than every task may hold.

The cells' centroids are a table, sampled from the vectors and grouped in branches around a few of
themselves. Only the branches' centroids are broadcast, about the square root of the number of cells. A
vector goes to its nearest branch and meets the centroids of that branch there, in cogrouped batches; a
query does the same with several branches, and then goes to the nearest cells of all of them, where
it meets the vectors as in ``cells``. Nothing on the driver or in a broadcast grows with the cells but a row
per cell that is asked for. Folders are branches, and rows lie sorted by cell within them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sealrank.functions import arrow
from sealrank.functions.vectors import widen
from sealrank.operators.cells import FOLDER, FOLDER_BITS, GROUP_BYTES, CellTable, assign_cells, group_rows, meet_in_cells, pick_centroids, probes
from sealrank.operators.packing import pack_vectors
from sealrank.operators.search import QUERY_BYTES, QUERY_ROWS, rank_hits
from sealrank.operators.selection import hash_rank, smallest
from sealrank.session import materialize

BRANCHES = f"{FOLDER} INT, centroid BINARY, n_cells BIGINT"
CELLS = "cell BIGINT, centroid BINARY, n_docs BIGINT"


def _dealt(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """Rows of a branch over its ``parts``, copies too; a row per branch is broadcast."""
    place = F.xxhash64(F.monotonically_increasing_id())
    return rows.join(F.broadcast(parts), FOLDER).withColumn("place", place).withColumn("part", F.pmod("place", "parts").cast("int")).drop("place", "parts")


def _at_each(rows: DataFrame, parts: DataFrame) -> DataFrame:
    return rows.join(F.broadcast(parts), FOLDER).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")


def _parts(rows: DataFrame, width: int) -> DataFrame:
    """In how many groups the rows of each branch meet its centroids."""
    most = max(1, GROUP_BYTES // (8 * max(1, width)))
    counted = rows.groupBy(FOLDER).count().select(FOLDER, F.ceil(F.col("count") / most).cast("int").alias("parts"))
    return materialize(counted, "parts")


def _meet(rows: DataFrame, cells: DataFrame, n: int, width: int, carried: bool = True) -> DataFrame:
    """Each row (``branch``, packed ``vector``, others) with its ``n`` nearest cells of its branch: ``cell`` and ``fit``.
    The vector is left out unless ``carried``."""
    parts = _parts(rows, width)
    left, right = _dealt(rows, parts), _at_each(cells.select(FOLDER, "cell", "centroid"), parts)
    kept = [f for f in rows.schema if f.name != FOLDER and (carried or f.name != "vector")]
    schema = T.StructType([*kept, T.StructField("cell", T.LongType()), T.StructField("fit", T.DoubleType())])

    def nearest(docs: pa.Table, centers: pa.Table) -> pa.Table:
        centers = centers.sort_by("cell")
        found = []
        numbers, matrix = centers["cell"].to_numpy(), arrow.as_matrix(centers["centroid"])
        step = max(1, (1 << 22) // max(1, len(numbers)))
        for batch in docs.combine_chunks().to_batches(max_chunksize=step) if len(numbers) else []:
            scores = np.round(arrow.as_matrix(batch.column("vector"), matrix.shape[1]) @ matrix.T, 12)
            order = np.argsort(-scores, axis=1, kind="stable")[:, :n]
            row = np.repeat(np.arange(len(order)), order.shape[1])
            own = batch.select([f.name for f in kept]).take(pa.array(row))
            found.append(pa.RecordBatch.from_arrays(
                [*own.columns, pa.array(numbers[order.ravel()]), pa.array(np.take_along_axis(scores, order, axis=1).ravel())],
                [*own.schema.names, "cell", "fit"],
            ))
        if found:
            return pa.Table.from_batches(found)
        names = {f.name: docs.schema.field(f.name).type for f in kept}
        return pa.schema([*names.items(), ("cell", pa.int64()), ("fit", pa.float64())]).empty_table()

    keys = [FOLDER, "part"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(nearest, schema)


def _branches(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The nearest branch of each row, the first of equals."""
    return assign_cells(rows, centroids).withColumnRenamed("cell", FOLDER).drop("fit")


def build_tree(docs: DataFrame, path: str, n_cells: int, n_branches: int | None = None, seed: int = 42, mode: str = "error") -> None:
    """Write the index of ``docs`` (``doc_id``, ``embedding``) to ``path``.

    Centroids are a vector of each of the ``n_cells`` ids of lowest hash rank. The branches are those of their
    ``n_branches`` lowest (the square root of ``n_cells`` where none is given).
    """
    if n_cells < 1:
        raise ValueError("n_cells must be at least 1")
    spark = docs.sparkSession
    wide = docs.select("doc_id", widen(F.col("embedding")).alias("embedding"))
    vectors = materialize(pack_vectors(wide), "vectors")
    ids = vectors.select("doc_id").distinct().withColumn("order", hash_rank(F.col("doc_id"), seed))
    drawn = materialize(smallest(ids, "order", "doc_id", n_cells).select("doc_id"), "drawn")
    centers = materialize(vectors.join(drawn, "doc_id").groupBy("doc_id").agg(F.min("vector").alias("vector")), "centers")
    top = pick_centroids(centers, n_branches or max(1, math.isqrt(n_cells)), seed)
    if top.nbytes > QUERY_BYTES:
        raise ValueError("the branches' centroids are too large to be sent to every task; use fewer branches")
    # Numbers within a branch; a branch holds about as many cells as there are branches.
    order = Window.partitionBy(FOLDER).orderBy("doc_id")
    number = F.shiftleft(F.col(FOLDER).cast("bigint"), FOLDER_BITS) + F.row_number().over(order) - 1
    cells = materialize(_branches(centers, top).withColumn("cell", number).select(FOLDER, "cell", F.col("vector").alias("centroid")), "cells")
    width = top.shape[1]
    placed = _meet(_branches(vectors, top), cells, 1, width).withColumn(FOLDER, F.shiftright("cell", FOLDER_BITS).cast("int"))
    placed.hint("rebalance", FOLDER).sortWithinPartitions(FOLDER, "cell").write.mode(mode).partitionBy(FOLDER).parquet(f"{path}/vectors")
    held = spark.read.parquet(f"{path}/vectors").groupBy("cell").agg(F.count("*").alias("n_docs"))
    cells.join(held, "cell").select("cell", "centroid", "n_docs", FOLDER).write.mode(mode).partitionBy(FOLDER).parquet(f"{path}/cells")
    sizes = spark.read.parquet(f"{path}/cells").groupBy(FOLDER).agg(F.count("*").alias("n_cells"))
    table = pa.table({FOLDER: pa.array(np.arange(len(top), dtype=np.int32)), "centroid": arrow.packed_column(top)})
    spark.createDataFrame(table).join(sizes, FOLDER, "left").select(
        FOLDER, "centroid", F.coalesce("n_cells", F.lit(0)).alias("n_cells")
    ).coalesce(1).write.mode(mode).parquet(f"{path}/branches")


def search_tree(
    queries: DataFrame, path: str, k: int = 5, n_branches: int = 4, nprobe: int = 8, query_rows: int = QUERY_ROWS
) -> DataFrame:
    """Approximate top-k: the ``nprobe`` nearest cells of the ``n_branches`` nearest branches of each query."""
    spark = queries.sparkSession
    if not queries.groupBy("query_id").count().filter("count > 1").isEmpty():
        raise ValueError("query_id is not unique")
    top = spark.read.schema(BRANCHES).parquet(f"{path}/branches").orderBy(FOLDER).toArrow()
    matrix = arrow.as_matrix(top["centroid"])
    table = CellTable(matrix, top["n_cells"].to_numpy(), np.ones(len(matrix)))
    packed = pack_vectors(queries.select("query_id", widen(F.col("embedding")).alias("embedding")))
    # Branches stand for cells here: a row per query and branch.
    at_branches = probes(packed, table, n_branches).select("query_id", "vector", F.explode("cells").alias(FOLDER))
    at_branches = materialize(at_branches.withColumn(FOLDER, F.col(FOLDER).cast("int")), "probes")
    cells = spark.read.parquet(f"{path}/cells").withColumn(FOLDER, F.col(FOLDER).cast("int"))
    width = matrix.shape[1]
    near = _meet(at_branches, cells, nprobe, width, carried=False)
    order = Window.partitionBy("query_id").orderBy(F.desc("fit"), "cell")
    chosen = near.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= nprobe)
    # Bundles of cells within a branch; a branch holds about as many cells as there are branches.
    earlier = Window.partitionBy(FOLDER).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    place = F.floor(F.coalesce(F.sum("n_docs").over(earlier), F.lit(0)) / group_rows(width))
    placed = cells.select("cell", "n_docs", FOLDER).withColumn("place", place)
    bundle = F.min("cell").over(Window.partitionBy(FOLDER, "place")).alias("bundle")
    at_cells = materialize(placed.select("cell", bundle), "bundles")
    grouped = chosen.select("query_id", "cell").join(at_cells, "cell").groupBy("query_id", "bundle").agg(F.collect_list("cell").alias("cells"))
    own = packed.select(F.col("query_id").alias("own"), "vector")  # a query's id may be null
    asked = grouped.join(own, grouped["query_id"].eqNullSafe(own["own"])).select("query_id", "vector", "bundle", "cells")
    vectors = spark.read.parquet(f"{path}/vectors").withColumn(FOLDER, F.col(FOLDER).cast("int")).select("cell", FOLDER, "doc_id", "vector")
    return rank_hits(meet_in_cells(materialize(asked, "asked"), vectors, cells, k, width, None, query_rows), k)
