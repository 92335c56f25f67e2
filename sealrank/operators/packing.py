"""Vectors as one binary value per row: small in storage, and one step from a matrix."""

from __future__ import annotations

import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sealrank.functions import arrow


def pack_vectors(df: DataFrame, name: str = "vector", timed: str | None = None) -> DataFrame:
    """Replace ``embedding`` by its unit vector as packed float64 bytes.

    ``timed`` names a column for the seconds a row took its task: those from one batch's arrival to the
    next one's, in which the rows before were read, packed and handed on, shared among the batch.
    """
    schema = T.StructType([f for f in df.schema if f.name != "embedding"]).add(name, T.BinaryType())
    if timed:
        schema = schema.add(timed, T.DoubleType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width, since = None, time.perf_counter()
        for batch in batches:
            if batch.num_rows:
                matrix = arrow.as_matrix(batch.column("embedding"), width)
                width = matrix.shape[1]
                new = {name: arrow.packed_column(arrow.unit_rows(matrix))}
                if timed:
                    now = time.perf_counter()
                    new[timed] = pa.array(np.full(batch.num_rows, (now - since) / batch.num_rows))
                    since = now
                yield arrow.replace_columns(batch, ("embedding",), **new)

    return df.mapInArrow(run, schema)


def unpack_vectors(df: DataFrame, name: str = "vector") -> DataFrame:
    """The inverse of ``pack_vectors``: ``embedding ARRAY<DOUBLE>``."""
    schema = T.StructType([f for f in df.schema if f.name != name]).add("embedding", T.ArrayType(T.DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                listed = arrow.list_column(arrow.as_matrix(batch.column(name)))
                yield arrow.replace_columns(batch, (name,), embedding=listed)

    return df.mapInArrow(run, schema)
