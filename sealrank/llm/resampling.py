"""Importance resampling of documents towards the texts of a target table.

Words and runs of words are hashed into buckets by CRC-32. Documents and target give each bucket its
counts, a bucket's gain is the scaled logarithm of the ratio of its smoothed shares, a document's weight
is the sum of the gains of its features, and seeded Gumbel noise on top of the weights turns "the highest
scores" into a draw without replacement.

CRC-32 is linear over bits, so the CRC of a span is the XOR of what each byte adds by itself, which
depends on the byte and on its distance from the end of the span only, and of a constant per length.
Both are tables; a batch looks all its bytes up at once and ``bitwise_xor.reduceat`` folds them per span.
Spans beyond ``BLOCK`` bytes are cut into blocks of that length, counted from the end, and the blocks'
values are folded from the first to the last, each time moving what came before by a block.

Two passes read the texts; each task of the first sends at most one row per bucket. What is broadcast is
one gain per bucket, a parameter. The ranks come from one range sort of narrow rows.

Defined cases: a null or empty text has no words, weight 0 and is not drawn; a null id counts as the
empty text in the noise and comes last among ties; rows that repeat each count, are drawn and ranked by
themselves; an empty table gives no rows, and an empty target leaves all its counts 0; other columns are
ignored, whatever their names. A byte that is not UTF-8 is a word's byte, as every byte from 0x80 is.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sealrank.llm.tables import written
from sealrank.llm.words import slices, texts_of

BUCKETS, MOST_BUCKETS = 10_000, 1 << 20
LONGEST = 1
SEED = 2024
LEAST_WORDS, PERCENT = 20, 10
# Bytes of a block of a long span, and bytes of text that are looked up at once.
BLOCK, AT_ONCE = 64, 2 << 20
CRC_POLYNOMIAL = 0xEDB88320
ONES = np.uint32(0xFFFFFFFF)


class CrcTables(NamedTuple):
    """By distance from the end and byte; by length; and a move by one block, by byte of the state."""

    parts: np.ndarray  # BLOCK x 256
    lengths: np.ndarray  # BLOCK + 1, the state all ones moved by that many bytes
    block: np.ndarray  # 4 x 256


@functools.cache
def crc_tables() -> CrcTables:
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(CRC_POLYNOMIAL), step >> 1).astype(np.uint32)

    def move(state: np.ndarray) -> np.ndarray:
        return (state >> np.uint32(8)) ^ step[state & np.uint32(255)]

    parts = np.empty((BLOCK, 256), np.uint32)
    parts[0] = step
    lengths = np.empty(BLOCK + 1, np.uint32)
    lengths[0] = ONES
    block = np.array([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)], np.uint32)
    for i in range(BLOCK):
        if i:
            parts[i] = move(parts[i - 1])
        lengths[i + 1] = move(lengths[i : i + 1])[0]
        block = move(block)
    return CrcTables(parts, lengths, block)


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions of all spans, one span after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def _block_values(body: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """What the bytes of each block (1 to ``BLOCK`` of them) add, in groups of bounded size."""
    parts = crc_tables().parts.ravel()
    out = np.empty(len(starts), np.uint32)
    ends = np.cumsum(lengths)
    first = 0
    while first < len(starts):
        stop = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + AT_ONCE, "right")))
        own, at = lengths[first:stop], _ranges(starts[first:stop], lengths[first:stop])
        begins = np.cumsum(own) - own
        distance = np.repeat(begins + own - 1, own) - np.arange(len(at))
        added = parts[(distance << 8) | body[at]]
        out[first:stop] = np.bitwise_xor.reduceat(added, begins)
        first = stop
    return out


def crc_spans(body: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of each span (at least one byte) of an array of bytes."""
    tables = crc_tables()
    n_blocks = -(-lengths // BLOCK)
    head = lengths - (n_blocks - 1) * BLOCK  # the first block is the one that may be short
    if (n_blocks <= 1).all():
        return (_block_values(body, starts, lengths) ^ tables.lengths[lengths] ^ ONES).astype(np.uint32)
    begins = np.cumsum(n_blocks) - n_blocks
    sizes = np.full(int(n_blocks.sum()), BLOCK)
    sizes[begins] = head
    places = np.cumsum(sizes) - sizes
    places += np.repeat(starts - places[begins], n_blocks)
    values = _block_values(body, places, sizes)
    state = tables.lengths[head] ^ values[begins]
    longer = np.flatnonzero(n_blocks > 1)
    k = 1
    while len(longer):
        old = state[longer]
        moved = np.zeros(len(old), np.uint32)
        for byte in range(4):
            moved ^= tables.block[byte][(old >> np.uint32(8 * byte)) & np.uint32(255)]
        state[longer] = moved ^ values[begins[longer] + k]
        k += 1
        longer = longer[n_blocks[longer] > k]
    return state ^ ONES


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[48:58] = _IN_WORD[97:123] = _IN_WORD[128:] = True


class Features(NamedTuple):
    """Buckets of all features of some texts, text after text, and the counts per text."""

    buckets: np.ndarray
    per_text: np.ndarray
    words: np.ndarray


def _word_spans(body: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = np.concatenate([[False], _IN_WORD[body], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2] - edges[::2]


def bucket_features(texts: list[bytes], longest: int = LONGEST, buckets: int = BUCKETS) -> Features:
    """The buckets of all runs of 1 to ``longest`` words of each text, joined by one space."""
    body = _LOWER[np.frombuffer(b"\n".join([*texts, b""]), np.uint8)]
    ends = np.cumsum([len(text) + 1 for text in texts])
    starts, lengths = _word_spans(body)
    owner = np.searchsorted(ends, starts, "right")
    words = np.bincount(owner, minlength=len(texts))
    if longest > 1:  # words one space apart, so that a run of words is one span
        whole = np.full(int((lengths + 1).sum()), 32, np.uint8)
        moved = np.cumsum(lengths + 1) - (lengths + 1)
        whole[_ranges(moved, lengths)] = body[_ranges(starts, lengths)]
        body, starts = whole, moved
    found, owners = [], []
    for size in range(1, longest + 1):
        first = np.arange(max(0, len(starts) - size + 1))
        first = first[owner[first] == owner[first + size - 1]]
        span = starts[first + size - 1] + lengths[first + size - 1] - starts[first]
        found.append(crc_spans(body, starts[first], span) % np.uint32(buckets) if len(first) else np.zeros(0, np.uint32))
        owners.append(owner[first])
    all_found, all_owners = np.concatenate(found), np.concatenate(owners)
    if longest > 1:
        all_found = all_found[np.argsort(all_owners, kind="stable")]
    return Features(all_found.astype(np.int64), np.bincount(all_owners, minlength=len(texts)), words)


def _bounded(longest: int, buckets: int) -> None:
    if not 1 <= buckets <= MOST_BUCKETS or longest < 1:
        raise ValueError(f"from 1 to {MOST_BUCKETS} buckets and runs of at least one word")


def bucket_counts(docs: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """``bucket, n`` over all features of all texts; a task sends one row per bucket it met."""
    _bounded(longest, buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in slices(batches):
            total += np.bincount(bucket_features(texts_of(batch.column("text")), longest, buckets).buckets, minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(total[met])], ["bucket", "n"])

    sent = docs.select("text").mapInArrow(run, "bucket int, n long")
    return sent.groupBy("bucket").agg(F.sum("n").alias("n"))


def _counts(docs: DataFrame, longest: int, buckets: int) -> list[int]:
    counts = [0] * buckets
    for row in bucket_counts(docs, longest, buckets).collect():  # at most ``buckets`` rows
        counts[row["bucket"]] = row["n"]
    return counts


def gains(source: list[int], target: list[int]) -> list[int]:
    """Per bucket 1000 times the logarithm of target share over source share, one added to each count."""
    n, all_source, all_target = len(source), sum(source), sum(target)
    return [
        math.floor(1000 * math.log(float((t + 1) * (all_source + n)) / float((s + 1) * (all_target + n))))
        for s, t in zip(source, target)
    ]


def weigh(docs: DataFrame, gain: list[int], longest: int = LONGEST) -> DataFrame:
    """``doc_id, n_words, n_features, weight`` of each text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(np.array(gain, np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = bucket_features(texts_of(batch.column("text")), longest, len(sent.value))
            running = np.concatenate([[0], np.cumsum(sent.value[found.buckets])])
            ends = np.cumsum(found.per_text)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(found.words.astype(np.int64)),
                    pa.array(found.per_text.astype(np.int64)),
                    pa.array(running[ends] - running[ends - found.per_text]),
                ],
                ["doc_id", "n_words", "n_features", "weight"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int) -> Column:
    """A thousand times a Gumbel variable that seed and id fix, rounded down."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def ranked(scored: DataFrame, drawn: int) -> DataFrame:
    """``rank`` 1 to ``drawn`` among the rows that are ``eligible``, by falling score and then id; null elsewhere.

    One range sort of narrow rows. The sorted rows are written with their task and their place in it, and
    a task's first rank is the number of rows in the tasks before it. The last key tells rows that repeat apart.
    """
    placed = scored.withColumn("__own", F.monotonically_increasing_id())
    in_order = placed.orderBy(
        F.desc("eligible"), F.desc("score"), F.asc_nulls_last("doc_id"), "n_features", "weight", "__own"
    )
    numbered = written(
        in_order.withColumn("__part", F.spark_partition_id()).withColumn("__place", F.monotonically_increasing_id()), "sorted"
    )
    shifts, before = [], 0
    for part, least, n in sorted(map(tuple, numbered.groupBy("__part").agg(F.min("__place"), F.count("*")).collect())):
        shifts.append((part, before + 1 - least))
        before += n
    # One row per task of the sort.
    offsets = F.broadcast(scored.sparkSession.createDataFrame(shifts, "__part int, __shift long"))
    rank = F.col("__place") + F.col("__shift")
    return numbered.join(offsets, "__part").withColumn(
        "rank", F.when(F.col("eligible") & (rank <= drawn), rank)
    ).drop("__own", "__part", "__place", "__shift")


def resample(
    docs: DataFrame,
    target: DataFrame,
    longest: int = LONGEST,
    buckets: int = BUCKETS,
    seed: int = SEED,
    least_words: int = LEAST_WORDS,
    percent: int = PERCENT,
) -> DataFrame:
    """Every document's doc_id, n_words, n_features, weight, score and rank (null where it is not drawn)."""
    gain = gains(_counts(docs, longest, buckets), _counts(target, longest, buckets))
    scored = weigh(docs, gain, longest).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = written(scored.withColumn("eligible", F.col("n_words") >= least_words), "scores")
    n = scored.filter("eligible").count()
    return ranked(scored, percent * n // 100).drop("eligible")


def take(docs: DataFrame, drawn: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id was drawn, each as often as it stands in ``docs``, with all their columns."""
    ids = drawn.filter(F.col("rank").isNotNull()).select(F.col("doc_id").alias("__drawn")).distinct()
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["__drawn"]), "left_semi")


ORACLE_SQL = """
WITH crc_step AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8),
           lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS step),
texts AS (
  SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 't', item_id, text FROM benchmark),
words AS (
  SELECT side, id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word FROM texts),
counted AS (SELECT side, id, word, count(*) AS n FROM words GROUP BY ALL),
hexed AS (SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM words)),
crcs AS (
  SELECT word, xor(list_reduce(list_transform(range(len(h) // 2), lambda k: CAST('0x' || substr(h, 2 * k + 1, 2) AS BIGINT)),
           lambda c, b: xor(c >> 8, step[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 10000 AS bucket
  FROM hexed, crc_step),
found AS (SELECT side, id, bucket, n FROM counted JOIN crcs USING (word)),
sums AS (
  SELECT bucket, CAST(sum(n) FILTER (WHERE side = 'd') AS BIGINT) AS s, CAST(sum(n) FILTER (WHERE side = 't') AS BIGINT) AS t
  FROM found GROUP BY bucket),
totals AS (SELECT CAST(coalesce(sum(s), 0) AS BIGINT) AS all_s, CAST(coalesce(sum(t), 0) AS BIGINT) AS all_t FROM sums),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST((coalesce(t, 0) + 1) * (all_s + 10000) AS DOUBLE)
                              / CAST((coalesce(s, 0) + 1) * (all_t + 10000) AS DOUBLE))) AS BIGINT) AS gain
  FROM sums, totals),
weights AS (
  SELECT id, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS weight
  FROM found JOIN gains USING (bucket) WHERE side = 'd' GROUP BY id),
scores AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE)
                                                      / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM documents LEFT JOIN weights ON id = doc_id),
places AS (
  SELECT *, n_features >= 20 AS eligible,
         row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place,
         count(*) FILTER (WHERE n_features >= 20) OVER () AS n
  FROM scores)
SELECT doc_id, n_features, weight, score, CASE WHEN eligible AND place <= 10 * n // 100 THEN place END AS rank FROM places
"""
