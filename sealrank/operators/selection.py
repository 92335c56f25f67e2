"""The n smallest rows of a table without sorting it and without one task holding n rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sealrank.session import materialize

# Rows that may be ordered on the driver at the end of the narrowing, and the number of
# histogram buckets fetched per step.
FEW_ROWS = 10_000
BUCKETS = 4096


def hash_rank(doc_id: Column, seed: int) -> Column:
    """A repeatable pseudo-random rank: the first 60 bits of the md5 of seed and id."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), doc_id.cast("string"))), 1, 15), 16, 10).cast("bigint")


def nth_smallest(df: DataFrame, value: str, tie: str, counts: list[int]) -> list[tuple | None]:
    """The key ``(value, tie)`` of the n-th smallest row for each n; None beyond the end.

    A histogram of the bigint ``value`` narrows the range until few rows are left; only
    counts and those few keys are fetched, whatever n is.
    """
    keys = df.select(value, tie).filter(F.col(value).isNotNull())
    low, high, total = keys.agg(F.min(value), F.max(value), F.count("*")).first()
    if total <= FEW_ROWS:
        ordered = _ordered(keys, value, tie)
        return [ordered[n - 1] if n <= total else None for n in counts]
    return [None if n > total else _narrow(keys, value, tie, n, low, high, total) for n in counts]


def _ordered(keys: DataFrame, value: str, tie: str) -> list[tuple]:
    return [tuple(r) for r in keys.orderBy(value, tie).collect()]


def _narrow(keys: DataFrame, value: str, tie: str, n: int, low: int, high: int, total: int) -> tuple:
    while total > FEW_ROWS and low < high:
        width = (high - low) // BUCKETS + 1
        bucket = F.expr(f"({value} - {low}L) div {width}L")
        histogram = (
            keys.filter(F.col(value).between(low, high)).groupBy(bucket.alias("bucket")).count().collect()
        )
        for at, count in sorted((r["bucket"], r["count"]) for r in histogram):
            if n <= count:
                low, high, total = low + at * width, min(high, low + (at + 1) * width - 1), count
                break
            n -= count
    inside = keys.filter(F.col(value).between(low, high))
    if total > FEW_ROWS:
        # More rows share one value than may be fetched.
        return _nth_tie(inside, value, tie, n)
    return _ordered(inside, value, tie)[n - 1]


def _nth_tie(inside: DataFrame, value: str, tie: str, n: int) -> tuple:
    """The n-th smallest tie among rows of one value: a range sort over all tasks, then
    the row is found by the counts of the sorted partitions."""
    ordered = materialize(
        inside.orderBy(tie).withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id()),
        "ties",
    )
    for part, start, count in sorted(map(tuple, ordered.groupBy("part").agg(F.min("place"), F.count("*")).collect())):
        if n <= count:
            return tuple(ordered.filter(F.col("place") == start + n - 1).select(value, tie).first())
        n -= count
    raise AssertionError("counts changed while they were read")


def smallest(df: DataFrame, value: str, tie: str, n: int) -> DataFrame:
    """The n smallest rows by ``(value, tie)``, exactly n where there are as many.

    A filter on the key of the n-th row; of the rows that repeat this key, the remaining
    number. Rows without a value come last, in the order of their ties; a missing tie comes
    before all others.
    """
    if n <= 0:
        return df.filter(F.lit(False))
    total, last, missing = df.agg(F.count("*"), F.max(value), F.count_if(F.col(value).isNull())).first()
    if n >= total:
        return df
    names = df.columns
    keyed = df.withColumn("__value", F.coalesce(F.col(value), F.lit((last or 0) + 1)).cast("bigint") if missing else F.col(value))
    (cut,) = nth_smallest(keyed.select("__value", tie), "__value", tie, [n])
    at = (F.col("__value") == F.lit(cut[0])) & F.col(tie).eqNullSafe(F.lit(cut[1]))
    before = F.coalesce((F.col("__value") < F.lit(cut[0])) | ((F.col("__value") == F.lit(cut[0])) & _less(tie, cut[1])), F.lit(False))
    n_before, n_at = keyed.agg(F.count_if(before), F.count_if(at)).first()
    if n_before + n_at == n:
        return keyed.filter(before | at).select(names)
    return keyed.filter(before).select(names).unionByName(_some(keyed.filter(at).select(names), n - n_before))


def _less(tie: str, last: object) -> Column:
    """Ties before ``last``; a missing tie is the first."""
    return F.lit(False) if last is None else F.col(tie).isNull() | (F.col(tie) < F.lit(last))


def _some(rows: DataFrame, n: int) -> DataFrame:
    """Any n of interchangeable rows: whole partitions, and the beginning of one more."""
    placed = materialize(
        rows.withColumn("__part", F.spark_partition_id()).withColumn("__place", F.monotonically_increasing_id()), "repeats"
    )
    chosen = F.lit(False)
    for part, start, count in sorted(map(tuple, placed.groupBy("__part").agg(F.min("__place"), F.count("*")).collect())):
        if n < count:
            chosen = (F.col("__part") < part) | ((F.col("__part") == part) & (F.col("__place") < start + n))
            break
        n -= count
    return placed.filter(chosen).drop("__part", "__place")


def up_to(value: str, tie: str, cut: tuple) -> Column:
    last_value, last_tie = F.lit(cut[0]), F.lit(cut[1])
    return (F.col(value) < last_value) | ((F.col(value) == last_value) & (F.col(tie) <= last_tie))


def first_rows(df: DataFrame, position: str, tie: str, n: int | None) -> DataFrame:
    """The first n rows by position: None keeps all, 0 keeps none."""
    return df if n is None else smallest(df, position, tie, n)
