"""Site-relative line deduplication.

A line is boilerplate of a host when it stands on more than ``max_ratio`` of the host's pages, and
on at least ``min_pages`` of them. Pages are the rows of a host; a line repeated on one page
counts once. Lines are compared after trimming spaces; blank lines stay. With ``copies_once`` the
rows of a host that have one text are one page, so a group of exact copies does not make its own
lines boilerplate; ``clean_pages``, the stage of the pipeline, counts so.

Counting aggregates in the reading tasks first, so a host with a third of all pages sends at
most one row per task and line. Lines travel as two 64-bit hashes. What is dropped is small: a
host has at most (lines per page / max_ratio) such lines, so the lists are written, and Spark
broadcasts them if their files are small enough and joins them by host otherwise, splitting a
hot host at run time. Texts are cut where they are read.

Only DataFrame operations are used.

Defined cases: a null host is a host of its own; a null text has no lines and stays null; a row
that repeats another is a page of its own; an empty table gives no rows; other columns are kept,
whatever their names, but the two counts of ``drop_lines`` replace columns of their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sealrank.session import materialize

MAX_RATIO = 0.1
MIN_PAGES = 3


def _line_key(line: Column) -> Column:
    """A line's identity in 128 bits."""
    line = F.trim(line)
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b"))


def boilerplate(
    pages: DataFrame, host: str, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, copies_once: bool = False
) -> DataFrame:
    """Per host with boilerplate: __host, __drop (keys of its lines)."""
    rows = pages.select(F.col(host).alias("h"), F.col("text").alias("t"))
    if copies_once:
        same = F.xxhash64("t"), F.xxhash64(F.lit(1), "t")
        rows = rows.groupBy("h", same[0].alias("a"), same[1].alias("b")).agg(F.any_value("t").alias("t"))
    totals = rows.groupBy("h").agg(F.count(F.lit(1)).alias("pages"))
    lines = F.filter(F.split("t", "\n", -1), lambda line: F.trim(line) != "")
    keys = F.array_distinct(F.transform(lines, _line_key))
    counts = rows.select("h", F.explode(keys).alias("k")).groupBy("h", "k").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.where(F.col("n") >= min_pages)
    joined = counts.join(totals.withColumnRenamed("h", "g"), F.col("h").eqNullSafe(F.col("g")))
    found = joined.where(F.col("n") > F.col("pages") * F.lit(max_ratio))
    return found.groupBy(F.col("h").alias("__host")).agg(F.collect_list("k").alias("__drop"))


def drop_lines(
    pages: DataFrame, host: str, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, copies_once: bool = False
) -> DataFrame:
    """All pages without their host's boilerplate; adds n_lines, n_dropped_lines."""
    lists = materialize(boilerplate(pages, host, max_ratio, min_pages, copies_once), "boilerplate")
    # The caller's columns travel in one struct, so that none of their names can clash.
    rows = pages.select(F.struct(*pages.columns).alias("__page"), F.col(host).alias("__of"), F.col("text").alias("__text"))
    joined = rows.join(lists, F.col("__of").eqNullSafe(F.col("__host")), "left")
    lines = F.split("__text", "\n", -1)
    stay = F.filter(lines, lambda line: (F.trim(line) == "") | ~F.array_contains("__drop", _line_key(line)))
    stay = F.when(F.col("__drop").isNull(), lines).otherwise(stay)
    out = joined.withColumn("__stay", stay)
    text = F.when(F.size("__stay") == F.size(lines), F.col("__text")).otherwise(F.array_join("__stay", "\n"))
    n_lines = F.coalesce(F.when(F.col("__text").isNotNull(), F.size(lines)), F.lit(0)).cast("long")
    n_stay = F.coalesce(F.when(F.col("__text").isNotNull(), F.size("__stay")), F.lit(0)).cast("long")
    names = [name for name in pages.columns if name not in ("n_lines", "n_dropped_lines")]
    columns = [text.alias("text") if name == "text" else F.col("__page").getField(name).alias(name) for name in names]
    return out.select(*columns, n_lines.alias("n_lines"), (n_lines - n_stay).alias("n_dropped_lines"))


def clean_pages(pages: DataFrame, host: str, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """All pages without their host's boilerplate, in their own columns; n_chars follows the text."""
    out = drop_lines(pages.select(F.struct(*pages.columns).alias("__page"), F.col(host).alias("host"), "text"), "host", max_ratio, min_pages, copies_once=True)
    own = {"text": F.col("text")}
    if "n_chars" in pages.columns:
        own["n_chars"] = F.length("text").cast(pages.schema["n_chars"].dataType)
    return out.select(*[own.get(name, F.col("__page").getField(name)).alias(name) for name in pages.columns])


ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, text FROM documents),
l AS (
  SELECT rid, source, i, ls[i] AS line, trim(ls[i], ' ') AS k
  FROM (SELECT rid, source, ls, unnest(range(1, len(ls) + 1)) AS i
        FROM (SELECT rid, source, string_split(text, chr(10)) AS ls FROM d))
), p AS (SELECT source, count(*) AS pages FROM d GROUP BY source),
b AS (
  SELECT u.source, k FROM (SELECT DISTINCT rid, source, k FROM l WHERE k <> '') u JOIN p ON u.source IS NOT DISTINCT FROM p.source
  GROUP BY u.source, k, pages HAVING count(*) >= {MIN_PAGES} AND count(*) > pages * {MAX_RATIO}::DOUBLE
), m AS (
  SELECT l.*, b.k IS NOT NULL AS dropped FROM l LEFT JOIN b ON l.source IS NOT DISTINCT FROM b.source AND l.k = b.k
), t AS (
  SELECT rid, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '') AS text,
         count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped_lines
  FROM m GROUP BY rid
)
SELECT doc_id, source, t.text, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped_lines, 0) AS n_dropped_lines
FROM d LEFT JOIN t USING (rid)
"""
