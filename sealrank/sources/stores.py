"""The plain and the sealed vector store: parquet folders with one folder per batch.

A batch is written with overwrite, so repeating it replaces it instead of adding rows.
"""

from __future__ import annotations

import time
import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sealrank import schemas
from sealrank.functions.sealing import blind_index, open_text, seal, unseal
from sealrank.functions.text import first_text, id_or_new
from sealrank.functions.vectors import widen
from sealrank.operators.packing import pack_vectors
from sealrank.session import materialize
from sealrank.sources.readers import read_or_empty


class Loaded(NamedTuple):
    """What a load observed while it wrote: its batch, its wall-clock seconds, and sums over all rows and per sample size.

    The sums are ``n_docs``, ``embed_time`` and, of a sealed store, ``total_time``: the seconds its documents took their
    tasks. All sizes are loaded by one job; ``wall_clock_time`` of a size is the job's by the size's share of the rows.
    """

    batch: str
    seconds: float
    whole: dict[str, float]
    by_size: dict[int, dict[str, float]]


SUMS = ("embed_time", "total_time")


def _sums(columns: list[str], sizes: list[int]) -> list[Column]:
    """Aggregates to observe: rows and sums of all rows, and of those within each sample."""
    found = []
    for size in (None, *sizes):
        within = F.lit(True) if size is None else F.coalesce(F.col("first_size") <= size, F.lit(False))
        found.append(F.count_if(within).alias(f"n_docs {size}"))
        found += [F.sum(F.when(within, F.col(c))).alias(f"{c} {size}") for c in SUMS if c in columns]
    return found


def fill_defaults(df: DataFrame, carried: tuple[str, ...] = ("embed_time",)) -> DataFrame:
    """``doc_id, content, embedding, first_size`` with what is missing filled in: a new
    id, the text of ``content``, ``documents`` or ``texts``, else the empty text. ``carried`` columns are kept where there are any."""
    if "embedding" not in df.columns:
        raise ValueError("vectors are needed: embed the texts first")
    texts = [F.col(c) for c in ("content", "documents", "texts") if c in df.columns]
    doc_id = F.col("doc_id") if "doc_id" in df.columns else F.lit(None)
    size = F.col("first_size") if "first_size" in df.columns else F.lit(None)
    return df.select(
        id_or_new(doc_id).alias("doc_id"),
        first_text(*texts).alias("content"),
        widen(F.col("embedding")).alias("embedding"),
        size.cast("int").alias("first_size"),
        *[F.col(c) for c in df.columns if c in carried],
    )


class _Store:
    schema: str

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self) -> DataFrame:
        """All rows, or the empty table before the first batch."""
        return read_or_empty(self.spark, self.path, self.schema)

    def count(self) -> int:
        return self.read().count()

    def is_empty(self) -> bool:
        return self.read().isEmpty()

    def _write(self, rows: DataFrame, batch: str | None) -> str:
        batch = batch or uuid.uuid4().hex
        rows.drop(*SUMS).write.mode("overwrite").parquet(f"{self.path}/batch={batch}")
        return batch

    def _observe(self, rows: DataFrame, batch: str | None, sizes: list[int]) -> Loaded:
        """Write with the sums taken in the same pass."""
        watch = Observation()
        start = time.perf_counter()
        batch = self._write(rows.observe(watch, *_sums(rows.columns, sizes)), batch)
        seconds = time.perf_counter() - start
        found = watch.get
        n = found.get("n_docs None") or 0
        by_size = {}
        for size in (None, *sizes):
            own = {name: float(found.get(f"{name} {size}") or 0) for name in ("n_docs", *SUMS) if f"{name} {size}" in found}
            own["wall_clock_time"] = seconds * own.get("n_docs", 0) / n if n else 0.0
            by_size[size] = own
        return Loaded(batch, seconds, by_size.pop(None), by_size)


def _row_key() -> Column:
    """The key of a stored row: the 64 digits of ``doc_key``, its batch, its position there."""
    return F.concat_ws("|", "doc_key", "batch", F.col("pos").cast("string"))


class PlainStore(_Store):
    """Ids, texts and vectors in the clear, in cosine space."""

    schema = schemas.PLAIN_VECTORS

    def add(self, df: DataFrame, batch: str | None = None) -> str:
        return self._write(fill_defaults(df), batch)

    def load(self, df: DataFrame, sizes: list[int] = (), batch: str | None = None) -> Loaded:
        """``add`` with what it observed, also per sample size."""
        return self._observe(fill_defaults(df), batch, list(sizes))

    def vectors(self) -> DataFrame:
        return self.read().select("doc_id", "embedding", "first_size")

    def ids(self) -> DataFrame:
        return self.read().select("doc_id")

    def content(self) -> DataFrame:
        return self.read().select("content")


class SealedStore(_Store):
    """Ids, texts and unit vectors sealed column by column; see ``functions.sealing``.

    Without a key the columns hold plain bytes. Adding a document again appends a row, as
    ``read`` shows; ``latest`` keeps the row of the highest version per document.
    """

    schema = schemas.SEALED_VECTORS

    def __init__(self, spark: SparkSession, path: str, key: DataFrame | None):
        super().__init__(spark, path)
        self.key = key

    def _doc_key(self, doc_id):
        return F.sha2(doc_id, 256) if self.key is None else blind_index(doc_id, self.key)

    def seal_rows(self, df: DataFrame, version: int | None, timed: bool = False) -> DataFrame:
        """The stored form. Without ``version``, rows have their own in ``version``, or else all that of the moment."""
        carried = ("embed_time", "version") if version is None else ("embed_time",)
        filled = fill_defaults(df, carried).withColumn("pos", F.monotonically_increasing_id())
        moment = F.lit(time.time_ns() // 1000 if version is None else version)
        version = F.coalesce("version", moment) if "version" in filled.columns else moment
        packed = pack_vectors(filled, timed="total_time" if timed else None)
        keyed = packed.withColumn("doc_key", self._doc_key(F.col("doc_id")))
        tied = F.col("doc_key")
        return keyed.select(
            "doc_key",
            seal(F.col("doc_id"), self.key, tied).alias("id_enc"),
            seal(F.col("vector"), self.key, tied).alias("vector_enc"),
            seal(F.col("content"), self.key, tied).alias("text_enc"),
            version.cast("bigint").alias("version"),
            "pos",
            "first_size",
            *[F.col(c) for c in packed.columns if timed and c in SUMS],
        )

    def add(self, df: DataFrame, batch: str | None = None, version: int | None = None) -> str:
        """Normalise, seal and append; rows without an id get a new one."""
        return self._write(self.seal_rows(df, version), batch)

    def load(self, df: DataFrame, sizes: list[int] = (), batch: str | None = None, version: int | None = None) -> Loaded:
        """``add`` with what it observed, also per sample size."""
        return self._observe(self.seal_rows(df, version, timed=True), batch, list(sizes))

    def latest(self) -> DataFrame:
        """One row per document: of the highest version, there the last one added.

        A first job finds the documents that have several rows, from narrow columns and
        with a combine before the shuffle, so a document added very often sends one row
        per task. Their table is small unless most documents were added again, and then
        the sealed columns are filtered where they are read.
        """
        rows = self.read()
        order = F.struct("version", "batch", "pos")
        several = rows.groupBy("doc_key").agg(F.max(order).alias("last"), F.count("*").alias("n")).filter("n > 1")
        last = materialize(several.select("doc_key", "last"), "latest")
        keep = F.col("last").isNull() | (order == F.col("last"))
        return rows.join(last, "doc_key", "left").filter(keep).drop("last")

    def vectors(self, rows: DataFrame | None = None, lenient: bool = False) -> DataFrame:
        """``doc_id`` and packed ``vector``, opened; each vector once, below any join.

        A vector that does not open fails the job, and so does an id unless ``lenient``.
        """
        rows = self.read() if rows is None else rows
        tied = F.col("doc_key")
        return rows.select(
            open_text(F.col("id_enc"), self.key, tied, lenient).alias("doc_id"),
            unseal(F.col("vector_enc"), self.key, tied).alias("vector"),
            "first_size",
        )

    def keyed_vectors(self, rows: DataFrame | None = None) -> DataFrame:
        """``doc_id`` and packed ``vector`` with nothing opened but the vector: the id is the key of the stored row."""
        rows = self.read() if rows is None else rows
        opened = unseal(F.col("vector_enc"), self.key, F.col("doc_key")).alias("vector")
        return rows.select(_row_key().alias("doc_id"), opened, "first_size")

    def named_vectors(self, rows: DataFrame | None = None, lenient: bool = False) -> DataFrame:
        """``keyed_vectors`` in the order of the opened ids: id, a zero character, row key."""
        rows = self.read() if rows is None else rows
        tied = F.col("doc_key")
        name = F.concat(open_text(F.col("id_enc"), self.key, tied, lenient), F.lit("\0"), _row_key())
        return rows.select(name.alias("doc_id"), unseal(F.col("vector_enc"), self.key, tied).alias("vector"), "first_size")

    def open_hits(self, hits: DataFrame, rows: DataFrame | None = None, lenient: bool = False) -> DataFrame:
        """``hits`` (written, ``doc_id`` a row key) with the opened ``doc_id`` and ``content`` of their rows.

        The hits' keys meet the stored rows by batch and position. Ids and texts are opened above that
        join, so of these rows only; which form the join takes is left to the size of the hits.
        """
        rows = self.read() if rows is None else rows
        key = F.col("doc_id")
        wanted = hits.select(
            key.alias("row_key"),
            F.substring_index(key, "|", 1).alias("doc_key"),
            F.expr("substring(doc_id, 66, length(doc_id) - 66 - length(substring_index(doc_id, '|', -1)))").alias("batch"),
            F.substring_index(key, "|", -1).cast("bigint").alias("pos"),
        ).distinct()
        tied = F.col("doc_key")
        found = rows.select("doc_key", "batch", "pos", "id_enc", "text_enc").join(wanted, ["doc_key", "batch", "pos"])
        opened = found.select(
            "row_key",
            open_text(F.col("id_enc"), self.key, tied, lenient).alias("opened"),
            open_text(F.col("text_enc"), self.key, tied, lenient).alias("content"),
        )
        return hits.join(opened, hits["doc_id"] == opened["row_key"]).select(
            *[F.col("opened").alias("doc_id") if c == "doc_id" else hits[c] for c in hits.columns], "content"
        )

    def sealed_ids(self) -> DataFrame:
        return self.read().select("id_enc")

    def ids(self, lenient: bool = False) -> DataFrame:
        return self.read().select(open_text(F.col("id_enc"), self.key, F.col("doc_key"), lenient).alias("doc_id"))

    def content(self, lenient: bool = False) -> DataFrame:
        return self.read().select(
            open_text(F.col("text_enc"), self.key, F.col("doc_key"), lenient).alias("content")
        )
