"""Small DataFrame helpers of the operators: ordinal numbers and running sums without one big group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sealrank.session import bound_batches, ship_package, written  # noqa: F401

# Rows that one window group of ``running`` holds on average.
GROUP_ROWS = 10_000


def buckets_for(rows: int) -> int:
    """Into how many hash buckets a key's rows are spread so that each holds about GROUP_ROWS."""
    return max(1, -(-rows // GROUP_ROWS))


def running(df: DataFrame, keys: list[str], order: list[str], value: str, name: str, buckets: int) -> DataFrame:
    """Add ``name``: the sum of ``value`` over the rows that precede this one under the same keys.

    A key may hold a third of all rows, so rows are numbered inside hash buckets of ``order``
    and each bucket is shifted by the sum of the buckets before it. The order of rows is fixed by
    ``order``; rows equal in it are interchangeable.
    """
    bucket = F.pmod(F.xxhash64(*order), F.lit(buckets))
    rows = df.withColumn("__bucket", bucket)
    own = Window.partitionBy(*keys, "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__before", F.coalesce(F.sum(value).over(own), F.lit(0)))
    totals = df.groupBy(*keys, bucket.alias("__bucket")).agg(F.sum(value).alias("__sum"))
    earlier = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)],
        F.col("__bucket").alias("__b"),
        F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__shift"),
    )
    match = F.col("__bucket") == F.col("__b")
    for i, k in enumerate(keys):
        match = match & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    joined = rows.join(totals, match)
    out = [*df.columns, (F.col("__before") + F.col("__shift")).cast("long").alias(name)]
    return joined.select(*out)


def prepare(spark: SparkSession) -> None:
    """Send the package to the executors, and bound the rows of Arrow batches of texts."""
    ship_package(spark)
    bound_batches(spark)


def lower_ascii(text: Column) -> Column:
    """``text`` with A-Z, and nothing else, in lower case."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))
