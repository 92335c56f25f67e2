"""Whitening of embeddings from exact second moments (bit-sliced scatter).

Entries become integers, ``floor(scale * c) + offset``. A block of rows is shifted by its least entry per
dimension, so that all are at least 0, and every bit of every dimension is packed across the rows into
words: one bit plane per (dimension, bit). The sum over rows of a product of two dimensions is then the
sum over pairs of their planes of ``2 ** (p + q) * popcount(plane & plane)``, which is exact. Blocks are
unshifted and added as integers; tasks send their sums, one row per pair of dimensions, split into 32-bit
limbs so that Spark's sums of them stay exact too. The driver holds one matrix of dimensions x dimensions,
centres it as integers (``n * M - S S'``) and decomposes it.

Defined cases: a vector that is null, empty, or holds a null or non-finite entry has no row in the result;
entries beyond 2**62 after scaling are held there; vectors of different width are an error; rows that
repeat count as often as they come, and a null id is kept. A component without variance (fewer
distinct vectors than dimensions) has a null ``whitened`` and is left out of ``identity_error``. Where
the exact ``deviation`` passes a long it is null; ``deviation_digits`` always has it, as text. An empty
table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sealrank.llm.tables import written

SCALE, OFFSET = 1024, 100_000
COMPONENTS = 8
# Rows whose planes are packed together, and the bound of an entry after scaling.
BLOCK_ROWS = 8192
MOST = 2.0**62
LIMBS, LIMB = 6, 32
# Eigenvalues below this share of the largest are rounding of zero.
ZERO = 1e-12


class Moments(NamedTuple):
    """Number of vectors, sums per dimension and sums of products, all exact."""

    n: int
    sums: list[int]
    products: np.ndarray  # object, width x width


def sound(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """The rows whose vector holds finite numbers only, as doubles."""
    wide = F.col(column).cast("array<double>")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return vectors.select("vec_id", wide.alias("vector")).filter((F.size("vector") > 0) & F.forall("vector", finite))


def as_integers(column: pa.Array, scale: int, offset: int) -> np.ndarray:
    """The list column as a matrix of int64 entries ``floor(scale * c) + offset``."""
    widths = pc.unique(pc.list_value_length(column)).to_pylist()
    if len(widths) > 1:
        raise ValueError(f"vectors differ in width: {sorted(widths)}")
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), widths[0] if widths else 0)
    return np.clip(np.floor(scale * flat), -MOST, MOST).astype(np.int64) + offset


def bit_planes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Planes (one row of words each) of a matrix of uint64, with the dimension and the bit of each."""
    bits = [int(top).bit_length() for top in values.max(axis=0)]
    columns = np.ascontiguousarray(values.T)
    planes, dims, places = [], [], []
    for bit in range(max(bits, default=0)):
        own = np.flatnonzero(np.array(bits) > bit)
        packed = np.packbits(((columns[own] >> np.uint64(bit)) & np.uint64(1)).astype(np.uint8), axis=1)
        packed = np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8)))
        planes.append(packed.view(np.uint64))
        dims.append(own)
        places.append(np.full(len(own), bit))
    if not planes:
        return np.zeros((0, 1), np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    dim, place = np.concatenate(dims), np.concatenate(places)
    order = np.lexsort((place, dim))
    return np.concatenate(planes)[order], dim[order], place[order]


def cross_products(values: np.ndarray) -> np.ndarray:
    """``values' values`` of a matrix of uint64, as exact Python integers, by popcounts of anded planes."""
    width = values.shape[1]
    planes, dim, place = bit_planes(values)
    counts = np.zeros((len(planes), len(planes)), np.int64)
    for r in range(len(planes)):
        counts[r, r:] = np.bitwise_count(planes[r] & planes[r:]).sum(axis=1, dtype=np.int64)
    counts += np.triu(counts, 1).T
    small = 2 * int(place.max(initial=0)) + len(values).bit_length() + 2 < 62
    if not small:
        counts = counts.astype(object)
    weights = np.array([1 << int(p) for p in place], counts.dtype)
    weighted = counts * weights[:, None] * weights[None, :]
    out = np.zeros((width, width), object)
    starts = np.flatnonzero(np.r_[True, dim[1:] != dim[:-1]]) if len(dim) else np.zeros(0, np.int64)
    if len(starts):
        folded = np.add.reduceat(np.add.reduceat(weighted, starts, axis=0), starts, axis=1)
        out[np.ix_(dim[starts], dim[starts])] = folded.astype(object)
    return out


def block_moments(x: np.ndarray) -> Moments:
    """Exact moments of a block of integer rows: those of the shifted rows, unshifted."""
    low = x.min(axis=0)
    shifted = x.astype(np.uint64) - low.astype(np.uint64)  # wraps to the right difference
    n, least = len(x), low.astype(object)
    above = np.array([int(c.sum(dtype=object)) if int(c.max()) > 2**48 else int(c.sum()) for c in shifted.T], object)
    sums = above + n * least
    products = cross_products(shifted) + np.outer(least, above) + np.outer(above, least) + n * np.outer(least, least)
    return Moments(n, list(sums), products)


def _limbs(value: int) -> list[int]:
    """``value`` in base 2**32, the last digit signed and holding all that is left."""
    digits = []
    for _ in range(LIMBS - 1):
        digits.append(value & (2**LIMB - 1))
        value >>= LIMB
    return [*digits, value]


def moments(vectors: DataFrame, scale: int = SCALE, offset: int = OFFSET, rows: int = BLOCK_ROWS) -> Moments:
    """Exact moments of all vectors (``vec_id``, ``vector``): one pass, one row per task and pair of dimensions."""
    names = [f"limb{k}" for k in range(LIMBS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Moments | None = None
        held: list[np.ndarray] = []

        def settle() -> None:
            nonlocal total
            own = block_moments(np.concatenate(held))
            held.clear()
            if total is not None:
                if len(total.sums) != len(own.sums):
                    raise ValueError("vectors differ in width")
                own = Moments(total.n + own.n, [a + b for a, b in zip(total.sums, own.sums)], total.products + own.products)
            total = own

        for batch in batches:
            if batch.num_rows:
                held.append(as_integers(batch.column("vector"), scale, offset))
                if len({part.shape[1] for part in held}) > 1:
                    raise ValueError("vectors differ in width")
            if sum(map(len, held)) >= rows:
                settle()
        if held:
            settle()
        if total is None:
            return
        width = len(total.sums)
        cells = [(-1, width, total.n)] + [(-2, i, s) for i, s in enumerate(total.sums)]
        cells += [(i, j, total.products[i, j]) for i in range(width) for j in range(i, width)]
        digits = np.array([_limbs(int(value)) for _, _, value in cells], np.int64).reshape(len(cells), LIMBS)
        left, right = (np.array([cell[k] for cell in cells], np.int32) for k in (0, 1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(left), pa.array(right), *(pa.array(digits[:, k]) for k in range(LIMBS))], ["i", "j", *names]
        )

    schema = "i int, j int, " + ", ".join(f"{name} long" for name in names)
    sent = vectors.select("vector").mapInArrow(run, schema)
    summed = sent.groupBy("i", "j").agg(*[F.sum(name).alias(name) for name in names]).collect()
    values = {(r["i"], r["j"]): sum(int(r[name]) << (LIMB * k) for k, name in enumerate(names)) for r in summed}
    widths = [j for i, j in values if i == -1]
    if not widths:
        return Moments(0, [], np.zeros((0, 0), object))
    if len(widths) > 1:
        raise ValueError(f"vectors differ in width: {sorted(widths)}")
    width = widths[0]
    products = np.zeros((width, width), object)
    for (i, j), value in values.items():
        if i >= 0:
            products[i, j] = products[j, i] = value
    return Moments(values[-1, width], [values[-2, i] for i in range(width)], products)


class Whitening(NamedTuple):
    """What maps an integer row to its components; bounded by width x components."""

    n: int
    sums: list[int]
    mean: np.ndarray
    axes: np.ndarray  # width x components, unit eigenvectors
    values: np.ndarray  # falling eigenvalues
    explained: np.ndarray


def fit(found: Moments, components: int = COMPONENTS) -> Whitening:
    """Eigenvectors of the covariance, whose numerator is centred in integers."""
    n, sums = found.n, np.array(found.sums, object)
    centred = n * found.products - np.outer(sums, sums)
    covariance = np.array([[int(v) / (n * n) for v in row] for row in centred], np.float64).reshape(centred.shape)
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    trace = sum(int(centred[i, i]) for i in range(len(sums))) / (n * n)
    values = np.where(values > ZERO * max(trace, 0.0), values, 0.0)
    explained = values / trace if trace > 0 else np.zeros_like(values)
    mean = np.array([int(s) / n for s in sums])
    return Whitening(n, found.sums, mean, axes, values, explained)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """The exact sum over dimensions of ``(n * x - sum) ** 2`` of each row."""
    total = np.array(sums, object)
    reach = max((max(abs(n * int(x[:, d].min()) - s), abs(n * int(x[:, d].max()) - s)) for d, s in enumerate(sums)), default=0)
    if reach * reach * len(sums) < 2**63 and n * int(np.abs(x).max()) < 2**63:
        apart = x * n - total.astype(np.int64)
        return np.einsum("ij,ij->i", apart, apart).tolist()
    apart = x.astype(object) * n - total
    return (apart * apart).sum(axis=1).tolist()


def project(vectors: DataFrame, found: Whitening, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """``vec_id, deviation, deviation_digits, whitened`` (an array, null without variance) of each vector."""
    kind = vectors.schema["vec_id"].dataType.simpleString()
    sent = vectors.sparkSession.sparkContext.broadcast(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        spread = np.sqrt(own.values)
        scaled = own.axes / np.where(spread > 0, spread, 1.0)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = as_integers(batch.column("vector"), scale, offset)
            exact = deviations(x, own.n, own.sums)
            points = (x - own.mean) @ scaled
            flat = pa.array(points.ravel(), mask=np.tile(spread == 0, len(points)))
            ends = pa.array(np.arange(len(points) + 1, dtype=np.int32) * points.shape[1])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id"),
                    pa.array([v if v < 2**63 else None for v in exact], pa.int64()),
                    pa.array(list(map(str, exact))),
                    pa.ListArray.from_arrays(ends, flat),
                ],
                ["vec_id", "deviation", "deviation_digits", "whitened"],
            )

    return vectors.mapInArrow(run, f"vec_id {kind}, deviation long, deviation_digits string, whitened array<double>")


def identity_error(points: DataFrame, held: list[int]) -> float:
    """Largest entry of the covariance of ``whitened`` less the identity, over the components ``held``."""
    if not held:
        return 0.0
    at = lambda c: F.col("whitened")[c]
    means = points.agg(*[F.avg(at(c)) for c in held]).first()
    apart = {c: at(c) - F.lit(mean) for c, mean in zip(held, means)}
    pairs = [(a, b) for a in held for b in held if a <= b]
    found = points.agg(*[F.avg(apart[a] * apart[b]) for a, b in pairs]).first()
    return max(abs(value - (a == b)) for (a, b), value in zip(pairs, found))


RESULT = (
    "vec_id {kind}, component int, n long, deviation long, deviation_digits string, "
    "whitened double, explained double, identity_error double"
)


def whiten(embeddings: DataFrame, components: int = COMPONENTS, column: str = "embedding") -> DataFrame:
    """One row per vector and component: vec_id, component, n, deviation, deviation_digits, whitened,
    explained, identity_error."""
    vectors = sound(embeddings, column)
    found = moments(vectors)
    if found.n == 0:
        kind = embeddings.schema["vec_id"].dataType.simpleString()
        return embeddings.sparkSession.createDataFrame([], RESULT.format(kind=kind))
    fitted = fit(found, components)
    points = written(project(vectors, fitted), "whitened")
    held = [c for c, value in enumerate(fitted.values) if value > 0]
    error = identity_error(points, held)
    shares = F.array(*[F.lit(float(share)) for share in fitted.explained])
    return points.select(
        "vec_id", "deviation", "deviation_digits", F.posexplode("whitened").alias("place", "whitened")
    ).select(
        "vec_id",
        (F.col("place") + 1).alias("component"),
        F.lit(fitted.n).cast("long").alias("n"),
        "deviation",
        "deviation_digits",
        "whitened",
        shares[F.col("place")].alias("explained"),
        F.lit(float(error)).alias("identity_error"),
    )

