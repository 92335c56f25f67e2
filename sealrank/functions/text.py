"""Content building, defaults, relevance and the fixed output formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The layout of the load-time log and of the run-metric time stamp.
LOAD_LOG_HEADER = "=== Embedding Load Times ==="
LOAD_LOG_LINE = "[%d] count=%d, time=%.2fs"
LOAD_LOG_PATTERN = r"^\[(\d+)\] count=(\d+), time=([\d.]+)s$"
RUN_AT_FORMAT = "yyyy-MM-dd'T'HH:mm:ss"


def content(title: Column, text: Column) -> Column:
    """Title, line feed, text; a missing part counts as empty but keeps the line feed."""
    return F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(text, F.lit("")))


def first_text(*candidates: Column) -> Column:
    """The first text that is present, else the empty string."""
    return F.coalesce(*candidates, F.lit(""))


def id_or_new(doc_id: Column) -> Column:
    """The given id, or a fresh one. Write the result before using it twice."""
    return F.coalesce(doc_id.cast("string"), F.uuid())


def is_relevant(relevance: Column) -> Column:
    """1 for a judgement above zero, 0 for the rest and for an unjudged pair."""
    return (F.coalesce(relevance, F.lit(0)) > 0).cast("int")


def load_line(size: Column, count: Column, seconds: Column) -> Column:
    return F.format_string(LOAD_LOG_LINE, size.cast("long"), count.cast("long"), seconds.cast("double"))


def six_places(value: Column) -> Column:
    return F.format_string("%.6f", value)


def run_at(moment: Column) -> Column:
    return F.date_format(moment, RUN_AT_FORMAT)
