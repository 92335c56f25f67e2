"""Words of whole texts as arrays: the helper the Python-side operators share.

A word is a maximal run of bytes outside space and ``\\t\\n\\v\\f\\r``, which is what
``bytes.split()`` yields. A null text has no words.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

# Bytes of text handled at once, so that a batch of long texts needs no more memory than one text.
CHUNK_BYTES = 4 << 20


def texts_of(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null becomes empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [text or b"" for text in column.cast(kind).to_pylist()]


def strings(texts: list[bytes]) -> pa.Array:
    """The texts as strings; bytes that are not UTF-8 become U+FFFD."""
    try:
        return pa.array(texts, pa.binary()).cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([text.decode("utf-8", "replace") for text in texts], pa.string())


def chunks(texts: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``limit`` bytes together; a longer text stands alone."""
    start = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def slices(batches: Iterator[pa.RecordBatch], limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches with at most ``limit`` bytes of ``text``; a longer text stands alone."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0)
        ends = np.cumsum(np.asarray(sizes, np.int64))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


class Words(NamedTuple):
    """Hashes of all words of some texts in order, and where each text's words begin."""

    hashes: np.ndarray  # uint64
    bounds: np.ndarray  # len(texts) + 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def rows(self) -> np.ndarray:
        """The text each word belongs to."""
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)


def hash_words(texts: list[bytes], split: list[list[bytes]] | None = None) -> Words:
    split = [text.split() for text in texts] if split is None else split
    bounds = np.zeros(len(split) + 1, np.int64)
    np.cumsum([len(words) for words in split], out=bounds[1:])
    flat = (word for words in split for word in words)
    return Words(np.fromiter(map(xxhash.xxh3_64_intdigest, flat), np.uint64, int(bounds[-1])), bounds)


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit."""
    values = values ^ (values >> np.uint64(32))
    values = values * np.uint64(0x9E3779B97F4A7C15)
    values ^= values >> np.uint64(29)
    values *= np.uint64(0xD6E8FEB86659FD93)
    return values ^ (values >> np.uint64(32))


def gram_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words; entry i starts at word i."""
    n = max(0, len(hashes) - size + 1)
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out = mix(out + np.uint64(2 * i + 1)) ^ hashes[i : i + n] * np.uint64(0xBF58476D1CE4E5B9)
    return mix(out)


def chain_hashes(hashes: np.ndarray, size: int, stride: int) -> np.ndarray:
    """Hashes of ``size`` entries that lie ``stride`` apart: grams of grams."""
    n = max(0, len(hashes) - (size - 1) * stride)
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out = mix(out + hashes[i * stride : i * stride + n])
    return out


def covered(starts: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of ``n`` positions lie in a window of ``size`` that begins at a marked start."""
    steps = np.zeros(n + 1, np.int32)
    at = np.flatnonzero(starts)
    np.add.at(steps, at, 1)
    np.add.at(steps, np.minimum(at + size, n), -1)
    return np.cumsum(steps[:n]) > 0
