"""Best-fit packing of tokenised documents into sequences of fixed capacity.

Large-item matching: pieces above a third of the capacity meet at most two to a sequence,
matched greedily, the largest with the largest that still fits. Smaller pieces then go, longest
first, into the tightest remaining gap; a new sequence is opened only when none fits.

Pieces of equal length are interchangeable, so the matching works on the histogram of lengths,
which has ``capacity`` entries whatever the corpus holds. Its outcome is a list of runs: "of the
pieces of length l, those ranked r .. r+n go to sequences s .. s+n at offset o". Each piece finds
its run from its rank, in its own task. No piece visits the driver.

Ids are those that the vocabulary file gives by itself: the name of a special token in a text is its id.

Defined cases: a null text is empty and yields one piece holding id 0; repeated rows are packed
as often as they come; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import functools
import pathlib
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sealrank.llm.tables import buckets_for, running
from sealrank.llm.words import slices, texts_of
from sealrank.session import materialize

CAPACITY = 2048
END_ID = 0
SPECIAL = "<|endoftext|>"
SPECIAL_ID = 50256
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
# White space of this length goes to the slower library: the faster one backtracks over it and
# runs out of stack at about a million characters.
LONG_SPACE = re.compile(r"(?<!\s)\s{10000}")


@functools.cache
def encoding(path: str = RANKS) -> tiktoken.Encoding:
    """The byte-level BPE of ``byte_bpe_50k.json`` from its rank file: the same ids, a third of the time."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: SPECIAL_ID})


@functools.cache
def vocabulary(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


def encoder(ranks: str = RANKS) -> Callable[[str], list[int]]:
    """Ids of a text of any form; the vocabulary file lies beside its rank file."""
    faster, special = encoding(ranks), {SPECIAL}
    beside = str(pathlib.Path(ranks).with_suffix(".json"))

    def encode(text: str) -> list[int]:
        if len(text) > 10_000 and LONG_SPACE.search(text):
            return vocabulary(beside).encode(text, add_special_tokens=False).ids
        return faster.encode(text, allowed_special=special) if SPECIAL in text else faster.encode_ordinary(text)

    return encode


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids; only the first may be shorter than the capacity."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((start, capacity) for start in range(first, n, capacity))]


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, ranks: str = RANKS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(ranks)
        for batch in slices(batches):
            rows, found = [], []
            for row, text in enumerate(texts_of(batch.column("text"))):
                ids = np.array([*ids_of(text.decode("utf-8", "replace")), END_ID], "<u4")
                for piece, (start, length) in enumerate(cut(len(ids), capacity)):
                    rows.append(row)
                    found.append((piece, start, length, zlib.crc32(ids[start : start + length].tobytes())))
            numbers = np.array(found, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(rows, pa.int64())),
                    pa.array(numbers[:, 0].astype(np.int32)),
                    *(pa.array(numbers[:, i]) for i in (1, 2, 3)),
                ],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        encode, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    )


def plan(counts: np.ndarray, capacity: int) -> pd.DataFrame:
    """Runs of the packing: length, rank (first), n, sequence (first), offset.

    ``counts[l]`` is the number of pieces of length l. The number of runs depends on the
    capacity and not on the counts: each step uses up a length or a run of equal sequences.
    """
    left = [int(n) for n in counts]
    taken = [0] * (capacity + 1)
    runs: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}
    open_gaps: list[int] = []
    sequences = 0

    def place(length: int, n: int, sequence: int, offset: int) -> None:
        runs.append((length, taken[length], n, sequence, offset))
        taken[length] += n
        left[length] -= n

    def leave(gap: int, sequence: int, n: int) -> None:
        if gap and n:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(open_gaps, gap)
            gaps[gap].append((sequence, n))

    smallest_large = capacity // 3 + 1
    for length in range(capacity, smallest_large - 1, -1):
        partner = min(length, capacity - length)
        while left[length]:
            while partner >= smallest_large and left[partner] < (2 if partner == length else 1):
                partner -= 1
            if partner < smallest_large:
                n, used = left[length], length
                place(length, n, sequences, 0)
            else:
                n = left[length] // 2 if partner == length else min(left[length], left[partner])
                used = length + partner
                place(length, n, sequences, 0)
                place(partner, n, sequences, length)
            leave(capacity - used, sequences, n)
            sequences += n
    for length in range(smallest_large - 1, 0, -1):
        while left[length]:
            at = bisect.bisect_left(open_gaps, length)
            if at < len(open_gaps):
                gap = open_gaps[at]
                first, n = gaps[gap].pop()
                m = min(n, left[length])
                if m < n:
                    gaps[gap].append((first + m, n - m))
                if not gaps[gap]:
                    del gaps[gap]
                    open_gaps.pop(at)
                place(length, m, first, capacity - gap)
                leave(gap - length, first, m)
                continue
            full, rest = divmod(left[length], capacity // length)
            for n, held in ((full, capacity // length), (1, rest)):
                if n and held:
                    for i in range(held):
                        place(length, n, sequences, i * length)
                    leave(capacity - held * length, sequences, n)
                    sequences += n
    return pd.DataFrame(runs, columns=["length", "rank", "n", "sequence", "offset"]).sort_values(["length", "rank"])


def pack(docs: DataFrame, capacity: int = CAPACITY, ranks: str = RANKS) -> DataFrame:
    """Pieces of all documents with the sequence and the offset that hold them."""
    spark = docs.sparkSession
    pieces = materialize(token_pieces(docs, capacity, ranks), "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for row in pieces.groupBy("length").count().collect():  # at most ``capacity`` rows
        counts[row["length"]] = row["count"]
    runs = plan(counts, capacity)
    first = np.cumsum(counts) - counts
    shared = spark.sparkContext.broadcast(
        (first, *((first[runs["length"]] + runs["rank"]).to_numpy() if c == "start" else runs[c].to_numpy() for c in ("start", "sequence", "offset")))
    )

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        first, starts, sequences, offsets = shared.value
        at = first[length.to_numpy()] + rank.to_numpy()
        run = np.searchsorted(starts, at, "right") - 1
        return pd.DataFrame({"sequence_id": sequences[run] + at - starts[run], "offset": offsets[run]})

    ordered = running(
        pieces.withColumn("__one", F.lit(1)), ["length"], ["doc_id", "piece", "ids_crc32"], "__one", "__rank", buckets_for(int(counts.sum()))
    )
    return ordered.withColumn("__place", place("length", "__rank")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "__place.sequence_id", "__place.offset"
    )
