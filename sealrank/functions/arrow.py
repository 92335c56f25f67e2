"""Arrow batches as NumPy matrices and back, for the batch functions that run in tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def as_matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """A list column, or a column of packed float64 vectors, as an ``(n, width)`` matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        raise ValueError("a vector is missing")
    if len(column) == 0:
        return np.empty((0, width or 0))
    packed = pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)
    sizes = pc.binary_length(column) if packed else pc.list_value_length(column)
    low, high = (v.as_py() for v in pc.min_max(sizes).values())
    if packed:
        low, high = low / 8, high / 8
    if low != high or (width is not None and high != width):
        raise ValueError(f"vectors differ in width: {low} to {high}, expected {width}")
    if packed:
        offset_type = np.int64 if pa.types.is_large_binary(column.type) else np.int32
        offsets = np.frombuffer(column.buffers()[1], offset_type)[column.offset:]
        body = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[len(column)]]
        flat = body.view("<f8")
    else:
        values = column.flatten()
        if values.null_count:
            raise ValueError("a vector holds a missing element")
        flat = values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    if not np.isfinite(flat).all():
        raise ValueError("a vector holds NaN or infinity")
    return flat.reshape(len(column), int(high))


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    """Rows scaled to unit length; zero rows stay zero."""
    norms = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
    norms[norms == 0] = 1.0
    return matrix / norms[:, None]


def list_column(matrix: np.ndarray) -> pa.Array:
    rows, width = matrix.shape
    offsets = pa.array(np.arange(rows + 1, dtype=np.int32) * width)
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(matrix).ravel()))


def packed_column(matrix: np.ndarray) -> pa.Array:
    """One binary value per row, made without touching the rows one by one."""
    rows = matrix.shape[0]
    body = np.ascontiguousarray(matrix)
    step = body.itemsize * matrix.shape[1]
    offsets = np.arange(rows + 1, dtype=np.int64) * step
    wide = pa.Array.from_buffers(pa.large_binary(), rows, [None, pa.py_buffer(offsets), pa.py_buffer(body)])
    return wide.cast(pa.binary())


def replace_columns(batch: pa.RecordBatch, drop: tuple[str, ...], **new: pa.Array) -> pa.RecordBatch:
    """The batch without ``drop``, with the ``new`` columns at the end."""
    names = [n for n in batch.schema.names if n not in drop]
    arrays = [batch.column(n) for n in names]
    return pa.RecordBatch.from_arrays(arrays + list(new.values()), names + list(new))
