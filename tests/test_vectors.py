import math

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from hypothesis.extra import numpy as hnp
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sealrank.functions import arrow
from sealrank.functions.vectors import cosine, distance, dot, l2_norm, normalize, widen


def one(spark, **columns):
    return spark.createDataFrame([tuple(columns.values())], ", ".join(f"{c} ARRAY<DOUBLE>" for c in columns))


def test_normalize_and_norm(spark):
    row = one(spark, a=[3.0, 4.0], z=[0.0, 0.0]).select(
        normalize(F.col("a")), l2_norm(F.col("a")), normalize(F.col("z")), cosine(F.col("a"), F.col("z"))
    ).first()
    assert row[0] == pytest.approx([0.6, 0.8]) and row[1] == 5.0
    assert row[2] == [0.0, 0.0] and row[3] == 0.0


def test_dot_and_distance(spark):
    row = one(spark, a=[1.0, 2.0], b=[3.0, 4.0]).select(dot(F.col("a"), F.col("b")), distance(F.lit(0.25))).first()
    assert tuple(row) == (11.0, 0.75)


def test_width_mismatch_is_an_error(spark):
    with pytest.raises(PySparkException, match="differ in width"):
        one(spark, a=[1.0, 2.0], b=[1.0]).select(dot(F.col("a"), F.col("b"))).collect()


def test_widen_keeps_single_precision_values(spark):
    row = spark.createDataFrame([([0.1],)], "a ARRAY<FLOAT>").select(widen(F.col("a"))).first()
    assert row[0] == [float(np.float32(0.1))]


@settings(deadline=None, max_examples=50)
@given(hnp.arrays(float, st.tuples(st.integers(1, 8), st.integers(1, 8)), elements=st.floats(-1e6, 1e6)))
def test_packed_and_list_columns_keep_every_bit(matrix):
    for column in (arrow.packed_column(matrix), arrow.list_column(matrix)):
        assert np.array_equal(arrow.as_matrix(column), matrix)
        assert np.array_equal(arrow.as_matrix(column.slice(1)), matrix[1:]) or len(matrix) == 1
    units = arrow.unit_rows(matrix)
    for row in units:
        assert math.isclose(np.linalg.norm(row), 1.0, rel_tol=1e-9) or not row.any() or np.abs(row).max() < 1e-100


@pytest.mark.parametrize("rows, message", [
    ([[1.0], None], "missing"), ([[1.0], [1.0, 2.0]], "width"), ([[float("nan")]], "NaN"),
    ([[float("inf")]], "NaN"), ([[1.0, None]], "missing element"),
])
def test_bad_vectors_are_refused(rows, message):
    with pytest.raises(ValueError, match=message):
        arrow.as_matrix(pa.array(rows, pa.list_(pa.float64())))
