"""Substring dedup: repeated runs of at least ``length`` words, found in prefix-partitioned subtrees.

A suffix tree over all word positions is never held. Its suffixes are split by prefixes of
growing length, and a suffix whose prefix occurs once is a leaf above every repeat and leaves
the work:

* Depth 8. Of the 8-word prefixes inside a window of ``length`` words, the one with the least hash
  is the window's anchor. Equal windows have equal anchors, so the windows of an anchor form a
  subtree that no other anchor shares; only anchors are shuffled, about one for seven words. The
  subtrees with one leaf end here.
* Depth of the context, the 20 to 32 words that the windows of one anchor cover together. Suffixes
  equal to that depth collapse to the first one and a number of leaves, before any shuffle moves
  them, so a passage in a third of all documents is one leaf.
* Depth ``length``. Only the distinct contexts below an anchor are extended window by window. An
  internal node this deep is a repeat: its first leaf is the original, its other leaves are repeats.

Repeated windows that follow each other are one maximal repeat. Every group is summed with
map-side combining and its members are joined back, where Spark splits hot keys at run time; no
group is gathered in a task. Grams and contexts are compared as 64-bit hashes, windows as the
pair of anchor and window hash.

Defined cases: a null text has no words. Rows that repeat id and text are one document, so neither
repeats the other. Rows of one id with different texts are documents of their own, ordered by the
text's hash; a null id comes first. Bytes that are not UTF-8 count as they are and become U+FFFD
in the kept text. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sealrank.llm.tables import written
from sealrank.llm.words import chain_hashes, chunks, covered, gram_hashes, hash_words, mix, slices, strings, texts_of

LENGTH = 20
PREFIX = 8
_STEP = 4  # grams of 4 words build both the 8-word prefixes and the windows


def _windows(hashes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the prefixes and of the windows that start at each word."""
    quads = gram_hashes(hashes, _STEP)
    parts, rest = divmod(length, _STEP)
    whole = chain_hashes(quads, parts, _STEP)
    if rest:
        tail = quads[length - _STEP :]
        whole = mix(whole[: len(tail)] + tail)
    return chain_hashes(quads, PREFIX // _STEP, _STEP), whole


def _anchor_runs(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """Row, first window, number of windows, anchor hash and context hash of each anchor."""
    words = hash_words(texts)
    n = len(words.hashes) - length + 1
    if n <= 0:
        return tuple(np.zeros(0, kind) for kind in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    prefixes, whole = _windows(words.hashes, length)
    span = length - PREFIX + 1
    view = sliding_window_view(prefixes, span)
    # In slices, because the view's comparison makes a copy.
    offset = np.concatenate([view[i : i + 65536].argmin(1) for i in range(0, n, 65536)])
    row = words.rows()
    inside = np.flatnonzero(row[:n] == row[length - 1 :])
    anchor = inside + offset[inside]
    # Anchors of different texts differ, and those of one text do not go back.
    first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]]) if len(anchor) else np.zeros(0, np.int64)
    last = np.r_[first[1:], len(anchor)] - 1 if len(anchor) else first
    start, count = inside[first], last - first + 1
    context = mix(whole[start] + mix(whole[inside[last]] + count.astype(np.uint64)))
    return row[start], start - words.bounds[row[start]], count, prefixes[anchor[first]], context


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), "text")


def anchors(docs: DataFrame, length: int) -> DataFrame:
    """One row per anchor: doc_id, th, first window, number of windows, prefix hash, context hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = texts_of(batch.column("text"))
            for a, b in chunks(texts):
                row, start, n, prefix, context = _anchor_runs(texts[a:b], length)
                at = pa.array(row + a)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(at), batch.column("th").take(at),
                        pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)),
                        pa.array(prefix.view(np.int64)), pa.array(context.view(np.int64)),
                    ],
                    ["doc_id", "th", "start", "n", "prefix", "context"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, th long, start int, n int, prefix long, context long")


def _leaves(texts: DataFrame, length: int) -> DataFrame:
    """The windows of the listed contexts: prefix, context, place in it, window hash, position."""
    kind = texts.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            lists = batch.column("runs")
            bounds = np.asarray(lists.offsets)
            starts, counts, prefixes, contexts = (np.asarray(lists.values.field(i)) for i in range(4))
            for i, text in enumerate(texts_of(batch.column("text"))):
                own = slice(bounds[i], bounds[i + 1])
                _, whole = _windows(hash_words([text]).hashes, length)
                n = counts[own]
                place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                start = np.repeat(starts[own], n) + place
                same = pa.array(np.full(len(start), i))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(same), batch.column("th").take(same), pa.array(start.astype(np.int32)),
                        pa.array(np.repeat(prefixes[own], n)), pa.array(np.repeat(contexts[own], n)),
                        pa.array(place.astype(np.int32)), pa.array(whole[start].view(np.int64)),
                    ],
                    ["doc_id", "th", "start", "prefix", "context", "place", "whole"],
                )

    return texts.mapInArrow(
        run, f"doc_id {kind}, th long, start int, prefix long, context long, place int, whole long"
    )


def _with_runs(docs: DataFrame, runs: DataFrame, how: str) -> DataFrame:
    """Texts beside the runs of their document."""
    own = runs.select(F.col("doc_id").alias("__d"), F.col("th").alias("__t"), "runs")
    return docs.join(own, docs["doc_id"].eqNullSafe(own["__d"]) & (docs["th"] == own["__t"]), how).drop("__d", "__t")


def repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per document with repeats: doc_id, th, runs of windows (start, n, mask) that start earlier elsewhere.

    Bit i of ``mask`` says that window ``start + i`` is a repeat.
    """
    if not PREFIX + 1 <= length <= 60 + PREFIX:
        raise ValueError("a window has 9 to 68 words, so that an anchor's windows fit a mask")
    docs = _keyed(docs)
    found = written(anchors(docs, length), "anchors")
    shared = written(found.groupBy("prefix").count().where("count > 1").select("prefix"), "prefixes")
    suffixes = written(found.join(shared, "prefix", "left_semi"), "suffixes")
    contexts = written(
        suffixes.groupBy("prefix", "context").agg(F.min(F.struct("doc_id", "th", "start", "n")).alias("first"), F.count(F.lit(1)).alias("leaves")),
        "contexts",
    )
    # Anchors over several contexts are extended to full depth; the others are settled.
    branching = contexts.groupBy("prefix").count().where("count > 1").select("prefix")
    open_ = contexts.join(branching, "prefix", "left_semi").select("first.*", "prefix", "context")
    listed = open_.groupBy("doc_id", "th").agg(F.collect_list(F.struct("start", "n", "prefix", "context")).alias("runs"))
    leaves = written(_leaves(_with_runs(docs, listed, "inner"), length), "leaves")
    position = F.struct("doc_id", "th", "start")
    nodes = leaves.groupBy("prefix", "whole").agg(F.min(position).alias("origin"), F.count(F.lit(1)).alias("size")).where("size > 1")
    later = leaves.join(nodes, ["prefix", "whole"]).where(~position.eqNullSafe(F.col("origin")))
    masks = later.groupBy("prefix", "context").agg(F.bit_or(F.expr("shiftleft(1L, place)")).alias("mask"))
    settled = contexts.join(masks, ["prefix", "context"], "left").where((F.col("leaves") > 1) | F.col("mask").isNotNull())
    marks = written(settled.select("prefix", "context", "first", F.coalesce("mask", F.lit(0)).alias("mask")), "marks")
    is_first = F.struct("doc_id", "th", "start").eqNullSafe(F.struct("first.doc_id", "first.th", "first.start"))
    mask = F.when(is_first, F.col("mask")).otherwise(F.expr("shiftleft(1L, n) - 1"))
    own = suffixes.join(marks, ["prefix", "context"]).select("doc_id", "th", "start", "n", mask.alias("mask")).where("mask <> 0")
    return own.groupBy("doc_id", "th").agg(F.collect_set(F.struct("start", "n", "mask")).alias("runs"))


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_text (kept words joined by a space), n_repeats, longest_repeat.

    ``n_repeats`` counts the maximal repeats that were cut and ``longest_repeat`` is the longest, in words.
    """
    runs = written(repeats(docs, length), "repeats")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            lists = batch.column("runs").to_pylist()
            kept, numbers = [], np.zeros((batch.num_rows, 4), np.int64)
            for i, text in enumerate(texts_of(batch.column("text"))):
                words = text.split()
                starts = np.zeros(len(words), bool)
                for item in lists[i] or ():
                    at = np.arange(item["n"])
                    starts[item["start"] + at] |= (item["mask"] >> at) & 1 == 1
                gone = covered(starts, length, len(words))
                edges = np.flatnonzero(np.diff(np.r_[False, gone, False]))
                cut = edges[1::2] - edges[::2]
                kept.append(b" ".join(word for word, out in zip(words, gone.tolist()) if not out) if len(cut) else b" ".join(words))
                numbers[i] = len(words), gone.sum(), len(cut), cut.max() if len(cut) else 0
            digests = [hashlib.sha256(text).hexdigest() for text in kept]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(numbers[:, 0]), pa.array(numbers[:, 1]), pa.array(digests),
                    strings(kept), pa.array(numbers[:, 2]), pa.array(numbers[:, 3]),
                ],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text", "n_repeats", "longest_repeat"],
            )

    return _with_runs(_keyed(docs), runs, "left").mapInArrow(
        run,
        f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, kept_text string, n_repeats long, longest_repeat long",
    )


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS gram
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM d WHERE len(ws) >= 20)
), r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY gram ORDER BY doc_id, i) AS k FROM w) WHERE k > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM r),
k AS (SELECT doc_id, ws[p] AS word, p FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS p FROM d) ANTI JOIN c USING (doc_id, p)),
t AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM k GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, len(ws) - coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id)
"""
