"""Exact cosine top-k for a whole query table in one Spark job.

Every query meets every document, so the plan decides how the two sides meet:

* A query table within the bound below travels to the tasks as one matrix. Documents are
  scanned where they lie and never shuffled; each task multiplies its Arrow batches with
  the query matrix and emits at most k rows per query.
* A larger query table is cut into blocks within the bound, packed in files of the shared folder.
  A scan task gathers documents up to a bound, passes the blocks by them one after the other, and
  goes on with its next documents, so one pass over the documents answers many blocks: as many as
  the lists of best hits that a task may hold allow. Documents never move. The tasks' lists are
  merged in a tree. Where tasks cannot read the shared folder, each block is a pass.

All end with a window over the lists of each query.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type, to_arrow_type

from sealrank.functions import arrow
from sealrank.functions.vectors import distance, widen
from sealrank.operators.best import BestHits, offer_all
from sealrank.operators.packing import pack_vectors
from sealrank.session import materialize, new_path, work_root, written

# A block of queries is sent to the tasks only below both of these.
QUERY_ROWS = 8192
QUERY_BYTES = 64 << 20
# Past many blocks: bytes of documents that a task gathers, and hits that its lists may hold together.
DOC_BYTES = 64 << 20
HELD_HITS = 1 << 22
# Lists of a query that are merged with one another in the first step.
FAN_IN = 64


@dataclass(frozen=True)
class QueryBlock:
    """A query table small enough to be sent to every task."""

    ids: pa.Array
    matrix: np.ndarray

    def __len__(self) -> int:
        return len(self.ids)


def query_block(queries: DataFrame, rows: int = QUERY_ROWS, size: int = QUERY_BYTES) -> QueryBlock | None:
    """The query table as a block, or None where it is over the bound.

    Its rows and bytes are counted before anything is fetched.
    """
    wide = queries.select("query_id", widen(F.col("embedding")).alias("embedding"))
    n, volume = wide.agg(F.count("*"), F.sum(8 * F.size("embedding"))).first()
    if n > rows or (volume or 0) > size:
        return None
    rows_found = pack_vectors(wide).collect()
    ids = pa.array([r["query_id"] for r in rows_found], to_arrow_type(queries.schema["query_id"].dataType))
    if len(ids.unique()) < len(ids):
        raise ValueError("query_id is not unique")
    return QueryBlock(ids, arrow.as_matrix(pa.array([r["vector"] for r in rows_found], pa.binary())))


def cut_blocks(queries: DataFrame, rows: int, size: int, depth: int = 0) -> Iterator[QueryBlock]:
    """The blocks of a query table over the bound, by hash; a part that is still over it is cut again."""
    n, volume = queries.agg(F.count("*"), F.sum(8 * F.size("embedding"))).first()
    parts = max(2, -(-2 * n // rows), -(-2 * (volume or 0) // size))
    path = new_path(queries.sparkSession, "query-blocks")
    part = F.pmod(F.xxhash64("query_id", F.lit(depth)), F.lit(parts))
    queries.select("query_id", "embedding", part.alias("part")).hint("rebalance", "part").write.partitionBy("part").parquet(path)
    schema = T.StructType([queries.schema["query_id"], queries.schema["embedding"], T.StructField("part", T.LongType())])
    written = queries.sparkSession.read.schema(schema).parquet(path)
    for i in range(parts):
        own = written.filter(F.col("part") == i).select("query_id", "embedding")  # prunes folders
        block = query_block(own, rows, size)
        if block is None:
            yield from cut_blocks(own, rows, size, depth + 1)
        elif len(block):
            yield block


def in_blocks(
    queries: DataFrame, answer: Callable[[QueryBlock], DataFrame], rows: int = QUERY_ROWS, size: int = QUERY_BYTES
) -> DataFrame:
    """``answer`` for a query table over the bound, block by block, each written and its shuffle files freed."""
    queries = queries.select("query_id", widen(F.col("embedding")).alias("embedding"))
    return reduce(DataFrame.unionByName, [written(answer(block), "answers") for block in cut_blocks(queries, rows, size)])


@dataclass(frozen=True)
class StoredBlock:
    """A block of queries packed in a folder: ``query_id`` and unit ``vector``."""

    path: str
    rows: int

    def load(self) -> QueryBlock:
        system, root = fs.FileSystem.from_uri(self.path)
        table = pq.read_table(root, columns=["query_id", "vector"], filesystem=system, partitioning=None)
        return QueryBlock(table["query_id"].combine_chunks(), arrow.as_matrix(table["vector"]))


def tasks_can_read(path: str) -> bool:
    """Whether tasks reach the shared folder by themselves: not where only Spark's readers know its scheme."""
    try:
        fs.FileSystem.from_uri(path)
    except (OSError, ValueError):
        return False
    return True


def store_blocks(queries: DataFrame, rows: int, size: int, depth: int = 0, packed: bool = False) -> list[StoredBlock]:
    """The query table in folders within the bound, by hash; a part that is still over it is cut again."""
    spark = queries.sparkSession
    vectors = queries if packed else pack_vectors(queries.select("query_id", widen(F.col("embedding")).alias("embedding")))
    vectors = vectors if packed else materialize(vectors, "queries")
    n, volume = vectors.agg(F.count("*"), F.sum(F.octet_length("vector"))).first()
    parts = max(2, -(-2 * n // rows), -(-2 * (volume or 0) // size))
    path = new_path(spark, "query-blocks")
    part = F.pmod(F.xxhash64("query_id", F.lit(depth)), F.lit(parts)).cast("int")
    vectors.withColumn("part", part).hint("rebalance", "part").write.partitionBy("part").parquet(path)
    schema = T.StructType([*vectors.schema, T.StructField("part", T.IntegerType())])
    written = spark.read.schema(schema).parquet(path)
    blocks = []
    # A row per block.
    sizes = written.groupBy("part").agg(F.count("*"), F.sum(F.octet_length("vector"))).collect()
    for i, held, volume in sorted(map(tuple, sizes)):
        if held > 1 and (held > rows or volume > size):
            own = written.filter(F.col("part") == i).select("query_id", "vector")
            blocks += store_blocks(own, rows, size, depth + 1, packed=True)
        else:
            blocks.append(StoredBlock(f"{path}/part={i}", held))
    return blocks


def passes(blocks: list[StoredBlock], k: int) -> Iterator[list[StoredBlock]]:
    """Blocks that one pass over the documents answers: their lists hold at most ``HELD_HITS`` hits."""
    group: list[StoredBlock] = []
    for block in blocks:
        if group and k * (sum(b.rows for b in group) + block.rows) > HELD_HITS:
            yield group
            group = []
        group.append(block)
    if group:
        yield group


def scan_blocks(blocks: list[StoredBlock], docs: DataFrame, k: int, query_type: T.DataType, groups: dict[int, list[int]] | None = None) -> DataFrame:
    """``scan_hits`` for many blocks in one pass: the blocks are read beside documents gathered up to ``DOC_BYTES``."""
    grouped = groups is not None
    schema = hit_fields(docs, query_type, T.IntegerType() if grouped else None)
    labels = sorted({g for gs in groups.values() for g in gs}) if grouped else [None]
    bound = DOC_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bests: list[dict] = [{} for _ in blocks]
        ids: list[pa.Array] = [None for _ in blocks]
        gathered: list[tuple[np.ndarray, pa.Array, np.ndarray | None]] = []

        def pass_by() -> None:
            for i, stored in enumerate(blocks):
                block = stored.load()
                if not bests[i]:
                    ids[i] = block.ids
                    bests[i] = {label: BestHits(len(block), k) for label in labels}
                everyone = np.arange(len(block))
                for vectors, doc_ids, tags in gathered:
                    if vectors.shape[1] != block.matrix.shape[1]:
                        raise ValueError(f"vectors differ in width: {vectors.shape[1]}, expected {block.matrix.shape[1]}")
                    if not grouped:
                        offer_all([bests[i][None]], block.matrix, everyone, vectors, doc_ids)
                        continue
                    for tag in np.unique(tags):
                        at = np.flatnonzero(tags == tag)
                        targets = [bests[i][g] for g in groups.get(int(tag), [])]
                        if targets:
                            offer_all(targets, block.matrix, everyone, vectors[at], doc_ids.take(pa.array(at)))
                for best in bests[i].values():
                    best.settle()
            gathered.clear()

        size = 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            vectors = arrow.unit_rows(arrow.as_matrix(batch.column("vector")))
            gathered.append((vectors, batch.column("doc_id"), batch.column("tag").to_numpy() if grouped else None))
            size += vectors.nbytes
            if size >= bound:
                pass_by()
                size = 0
        if gathered:
            pass_by()
        for i, own in enumerate(bests):
            for label, best in own.items():
                yield from emit(best, ids[i], label, grouped)

    columns = ["doc_id", "vector"] + (["tag"] if grouped else [])
    return docs.select(*columns).mapInArrow(run, schema)


def merge_lists(hits: DataFrame, k: int) -> DataFrame:
    """The lists of the scan tasks, merged ``FAN_IN`` tasks at a time before the last window meets what is left."""
    keys = [c for c in ("sample_size", "query_id") if c in hits.columns]
    tagged = hits.withColumn("bucket", F.floor(F.spark_partition_id() / FAN_IN))
    order = Window.partitionBy(*keys, "bucket").orderBy(F.desc("score"), F.asc("doc_id"))
    merged = tagged.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)
    return rank_hits(merged.drop("bucket", "place"), k)


def hit_fields(docs: DataFrame, query_type: T.DataType, group_type: T.DataType | None) -> T.StructType:
    fields = [] if group_type is None else [T.StructField("sample_size", group_type)]
    return T.StructType(fields + [
        T.StructField("query_id", query_type),
        T.StructField("doc_id", docs.schema["doc_id"].dataType),
        T.StructField("score", T.DoubleType()),
    ])


def emit(best: BestHits, ids: pa.Array, group: int | None, grouped: bool) -> Iterator[pa.RecordBatch]:
    found = best.hits()
    if found is None:
        return
    q, score, doc_ids = found
    columns = {"query_id": ids.take(pa.array(q)), "doc_id": doc_ids, "score": pa.array(score)}
    if grouped:
        columns = {"sample_size": pa.array(np.full(len(q), group, np.int32)), **columns}
    yield from pa.table(columns).to_batches(max_chunksize=10_000)


def scan_hits(
    block: QueryBlock,
    docs: DataFrame,
    k: int,
    groups: dict[int, list[int]] | None = None,
    subsets: dict[int, np.ndarray] | None = None,
) -> DataFrame:
    """Local top-k of every scan task for a block of queries.

    ``docs`` has ``doc_id``, ``vector`` and, with ``groups`` or ``subsets``, an integer
    ``tag``. ``groups`` names the sample sizes a tag counts for, each ranked by itself
    from one matrix product; ``subsets`` names the queries that look at a tag. Both may be given.
    """
    grouped, tagged = groups is not None, groups is not None or subsets is not None
    schema = hit_fields(docs, from_arrow_type(block.ids.type), T.IntegerType() if grouped else None)
    sent = docs.sparkSession.sparkContext.broadcast((block.ids, block.matrix, groups, subsets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix, by_tag, look = sent.value
        everyone = np.arange(len(ids))
        labels = sorted({g for gs in by_tag.values() for g in gs}) if grouped else [None]
        bests = {label: BestHits(len(ids), k) for label in labels}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            vectors = arrow.unit_rows(arrow.as_matrix(batch.column("vector"), matrix.shape[1]))
            doc_ids = batch.column("doc_id")
            if not tagged:
                offer_all([bests[None]], matrix, everyone, vectors, doc_ids)
                continue
            tags = batch.column("tag").to_numpy()
            for tag in np.unique(tags):
                at = np.flatnonzero(tags == tag)
                rows = everyone if look is None else look.get(int(tag), everyone[:0])
                targets = [bests[g] for g in by_tag.get(int(tag), [])] if grouped else [bests[None]]
                if len(rows) and targets:
                    offer_all(targets, matrix[rows], rows, vectors[at], doc_ids.take(pa.array(at)))
        for label, best in bests.items():
            yield from emit(best, ids, label, grouped)

    columns = ["doc_id", "vector"] + (["tag"] if tagged else [])
    return docs.select(*columns).mapInArrow(run, schema)


def rank_hits(hits: DataFrame, k: int) -> DataFrame:
    """Global top-k and ranks from 1; equal scores are ordered by id. A hit keeps its ``content``, if it has one."""
    groups = ["sample_size"] if "sample_size" in hits.columns else []
    carried = ["content"] if "content" in hits.columns else []
    order = Window.partitionBy(*groups, "query_id").orderBy(F.desc("score"), F.asc("doc_id"))
    return (
        hits.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select(*groups, "query_id", "rank", "doc_id", "score", *carried)
    )


def no_hits(queries: DataFrame, docs: DataFrame, grouped: bool = False) -> DataFrame:
    """The empty result with the full schema."""
    schema = hit_fields(docs, queries.schema["query_id"].dataType, T.IntegerType() if grouped else None)
    return rank_hits(docs.sparkSession.createDataFrame([], schema), 1)


def search(
    queries: DataFrame,
    docs: DataFrame,
    k: int = 5,
    sizes: list[int] | None = None,
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """The k nearest documents of every query: ``query_id, rank, doc_id, score``.

    ``queries`` has ``query_id`` and ``embedding``; ``docs`` has ``doc_id`` and
    ``embedding`` (an array) or ``vector`` (packed or array). With ``sizes``, ``docs``
    also has ``first_size``, the smallest sample that holds the document (NULL: none does),
    and the result has one ranking per sample size.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    vector = F.col("vector") if "vector" in docs.columns else widen(F.col("embedding"))
    if sizes is None:
        docs = docs.select("doc_id", vector.alias("vector"))
    else:
        # Tag a document with the smallest of the asked sizes whose sample holds it.
        every = F.array(*[F.lit(s) for s in sizes])
        tag = F.array_min(F.filter(every, lambda s: s >= F.col("first_size")))
        docs = docs.filter(tag.isNotNull()).select("doc_id", vector.alias("vector"), tag.alias("tag"))
    groups = None if sizes is None else {s: [g for g in sizes if g >= s] for s in sizes}

    def answer(block: QueryBlock) -> DataFrame:
        return rank_hits(scan_hits(block, docs, k, groups), k)

    whole = query_block(queries, query_rows)
    if whole is not None:
        return answer(whole) if len(whole) else no_hits(queries, docs, sizes is not None)
    if not queries.groupBy("query_id").count().filter("count > 1").isEmpty():
        raise ValueError("query_id is not unique")
    if not tasks_can_read(work_root(queries.sparkSession)):
        return in_blocks(queries, answer, query_rows)
    rounds = list(passes(store_blocks(queries, query_rows, QUERY_BYTES), k))
    query_type = queries.schema["query_id"].dataType
    answers = [merge_lists(scan_blocks(blocks, docs, k, query_type, groups), k) for blocks in rounds]
    if len(answers) > 1:  # one pass at a time
        answers = [materialize(found, "answers") for found in answers]
    return reduce(DataFrame.unionByName, answers)


def as_distance(hits: DataFrame) -> DataFrame:
    """The same ranking with the cosine distance as score; smaller is nearer."""
    return hits.withColumn("score", distance(F.col("score")))


def without_self(hits: DataFrame, k: int) -> DataFrame:
    """Drop hits of a query on itself and rank again. Search with ``k + 1`` before."""
    return rank_hits(hits.filter(F.col("query_id") != F.col("doc_id")), k)
