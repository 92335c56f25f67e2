"""Connected components of a link table, by alternating large-star and small-star rounds.

Each round is grouped sums and joins; the rows stay in written tables and only two numbers a
round reach the driver, which tell whether anything changed. A vertex with very many links is
summed with map-side combining, and joined where Spark splits hot keys at run time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sealrank.llm.tables import written


def _round(links: DataFrame, small: bool) -> DataFrame:
    """Hang the larger (or, in a small-star round, the smaller) neighbours of each vertex on the least one."""
    swapped = links.select(F.col("b").alias("a"), F.col("a").alias("b"))
    if small:
        sides = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    else:
        sides = links.unionByName(swapped)
    least = sides.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")) if not small else sides.groupBy("a").agg(F.min("b").alias("m"))
    joined = sides.join(least, "a")
    if small:
        hung = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    else:
        hung = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(vertex, root) of every linked vertex; the root is the least vertex of its component."""
    links = written(links.select("a", "b").where("a <> b").distinct(), "links")
    seen = None
    while True:
        links = written(_round(_round(links, False), True), "stars")
        state = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    roots = links.select(F.col("b").alias("vertex")).distinct().select("vertex", F.col("vertex").alias("root"))
    return links.select(F.col("a").alias("vertex"), F.col("b").alias("root")).unionByName(roots)
