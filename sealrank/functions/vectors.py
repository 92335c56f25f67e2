"""Vector arithmetic on ``ARRAY<DOUBLE>`` columns with built-in expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``.

    A lambda body is evaluated per element, so an outer expression written straight into
    it would be computed again for each element.
    """
    return F.transform(F.array(value), body)[0]


def widen(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Inner product; vectors of different width are an error, not a NULL."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(a) == F.size(b), total).otherwise(
        F.raise_error(F.lit("vectors differ in width")).cast("double")
    )


def l2_norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x * x))


def normalize(vector: Column) -> Column:
    """Scale to unit length; a zero vector stays as it is."""
    return bind(
        l2_norm(vector),
        lambda n: F.when(n > 0, F.transform(vector, lambda x: x / n)).otherwise(vector),
    )


def cosine(a: Column, b: Column) -> Column:
    return dot(normalize(a), normalize(b))


def distance(similarity: Column) -> Column:
    """Cosine distance of a cosine similarity, and back."""
    return F.lit(1.0) - similarity
