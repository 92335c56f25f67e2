"""Token counts that follow edits.

A document keeps a segment tree over runs of whole pre-tokens. Its leaves hold the characters and
tokens of about ``LEAF_CHARS`` characters each, its inner nodes the sums below. A leaf may end only
before a space that stands between a non-space and a letter: a pre-token begins there whatever
surrounds it, so leaves are encoded apart.

An edit re-encodes the leaves it touches, and a neighbour when it comes close enough to a leaf's
end to unmake the boundary. The new counts go up the tree; the rest of the text is not encoded
again. Only edited documents meet their trees, by key; the others keep their sum.

Defined cases: a null text has no tokens and no leaves; a text without boundaries is one leaf;
edits are in characters of the old text, sorted and apart; rows of one id and text share a tree; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sealrank.llm.packing import RANKS, encoder
from sealrank.llm.tables import written
from sealrank.llm.words import slices, texts_of

LEAF_CHARS = 512
# Characters beside a leaf's end that its boundary depends on.
CONTEXT = 2
_BOUNDARY = re.compile(r"(?<=\S)(?= [^\W\d_])")

Edit = tuple[int, int, str]

# Personal data that a corpus masks before training. The first part of an address takes its run whole.
_RUN = r"[A-Za-z0-9._%+-]"
MASKS = (
    (_RUN + r"++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "<EMAIL>"),
    (r"\b\d{1,3}(?:\.\d{1,3}){3}\b", "<IP>"),
    (r"\+?\d[\d ()-]{7,}\d", "<NUMBER>"),
)
# An address that is found at all is found from the beginning of its run; trying each of a run's
# characters would take the square of its length.
_SEARCHED = (f"(?<!{_RUN}){MASKS[0][0]}", MASKS[1][0], MASKS[2][0])
# Without \b, which takes every Unicode letter for a word character in Java: it may match more texts, never fewer.
ANY_MASK = "|".join(f"(?:{pattern})" for pattern in _SEARCHED).replace(r"\b", "")
_MASKS = re.compile("|".join(f"({pattern})" for pattern in _SEARCHED), re.ASCII)
_ADDRESS = re.compile(f"({MASKS[0][0]})", re.ASCII)
_RUN_END = re.compile(_RUN + "*+", re.ASCII)


def leaf_sizes(text: str, leaf_chars: int = LEAF_CHARS) -> list[int]:
    """Lengths in characters of the leaves of a text."""
    sizes, start = [], 0
    while start < len(text):
        found = _BOUNDARY.search(text, start + leaf_chars)
        end = found.start() if found else len(text)
        sizes.append(end - start)
        start = end
    return sizes


class Tree:
    """Sums of leaf characters and leaf tokens; node i has the children 2i and 2i + 1."""

    def __init__(self, chars: list[int], tokens: list[int]) -> None:
        self.n = 1 << max(0, (len(chars) - 1).bit_length())
        self.leaves = len(chars)
        self.sums = np.zeros((2 * self.n, 2), np.int64)
        self.sums[self.n : self.n + self.leaves] = np.stack([chars, tokens], axis=1).reshape(-1, 2)
        level = self.n
        while level > 1:
            half = level // 2
            self.sums[half:level] = self.sums[level : 2 * level].reshape(half, 2, 2).sum(axis=1)
            level = half

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    def leaf_at(self, char: int) -> tuple[int, int]:
        """The leaf that holds a character and the characters before that leaf."""
        node, before = 1, 0
        while node < self.n:
            node *= 2
            if char - before >= self.sums[node, 0]:
                before += int(self.sums[node, 0])
                node += 1
        return min(node - self.n, self.leaves - 1), before

    def start(self, leaf: int) -> int:
        node, before = leaf + self.n, 0
        while node > 1:
            if node % 2:
                before += int(self.sums[node - 1, 0])
            node //= 2
        return before

    def set(self, leaf: int, chars: int, tokens: int) -> None:
        node = leaf + self.n
        change = np.array([chars, tokens]) - self.sums[node]
        while node:
            self.sums[node] += change
            node //= 2


def apply_edits(text: str, chars: list[int], tokens: list[int], edits: list[Edit], count: Callable[[str], int]) -> tuple[int, int]:
    """Tokens after the edits, and how many characters were encoded for that."""
    if not edits:
        return sum(tokens), 0
    if not chars:
        new = "".join(edit[2] for edit in edits)
        return count(new), len(new)
    tree = Tree(chars, tokens)
    regions: list[list] = []  # first leaf, last leaf, edits
    for edit in edits:
        first, before = tree.leaf_at(max(0, edit[0] - CONTEXT))
        last, _ = tree.leaf_at(min(len(text) - 1, edit[1] + CONTEXT))
        if regions and first <= regions[-1][1]:
            regions[-1][1] = max(regions[-1][1], last)
            regions[-1][2].append(edit)
        else:
            regions.append([first, last, [edit]])
    encoded, plans = 0, []
    for first, last, own in regions:
        at = tree.start(first)
        end = tree.start(last) + chars[last]
        parts = []
        for lo, hi, new in own:
            parts += [text[at:lo], new]
            at = hi
        plans.append((first, last, "".join([*parts, text[at:end]])))
    for first, last, region in plans:
        encoded += len(region)
        tree.set(first, len(region), count(region))
        for leaf in range(first + 1, last + 1):
            tree.set(leaf, 0, 0)
    return tree.tokens, encoded


def mask_edits(text: str) -> list[Edit]:
    """Edits that mask personal data, in time linear in the text.

    After a match the rest of its run may begin an address too; a run is looked through for one once.
    """
    edits: list[Edit] = []
    at = checked = 0
    while True:
        found = None
        if at >= checked:
            found = _ADDRESS.match(text, at)
            checked = found.end() if found else _RUN_END.match(text, at).end()
        found = found or _MASKS.search(text, at)
        if not found:
            return edits
        edits.append((*found.span(), MASKS[found.lastindex - 1][1]))
        at = found.end()


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), "text")


def build_trees(docs: DataFrame, leaf_chars: int = LEAF_CHARS, ranks: str = RANKS) -> DataFrame:
    """Per document: doc_id, th (hash of the text), leaf chars and tokens, n_tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks)
        for batch in slices(batches):
            chars, tokens = [], []
            for text in texts_of(batch.column("text")):
                text = text.decode("utf-8", "replace")
                sizes, counts, at = leaf_sizes(text, leaf_chars), [], 0
                for size in sizes:
                    counts.append(len(encode(text[at : at + size])))
                    at += size
                chars.append(sizes)
                tokens.append(counts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("th"), pa.array(chars, pa.list_(pa.int32())), pa.array(tokens, pa.list_(pa.int32())), pa.array(list(map(sum, tokens)), pa.int64())],
                ["doc_id", "th", "chars", "tokens", "n_tokens"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _keyed(docs).mapInArrow(run, f"doc_id {kind}, th long, chars array<int>, tokens array<int>, n_tokens long")


def count_after_edits(docs: DataFrame, edits_of: Callable[[str], list[Edit]] = mask_edits, touched: str = ANY_MASK, leaf_chars: int = LEAF_CHARS, ranks: str = RANKS) -> DataFrame:
    """Per document: doc_id, n_tokens, n_edits, n_tokens_after, n_chars_encoded.

    ``edits_of`` gives the edits of a text, and ``touched`` is a pattern that every text with edits matches.
    """
    trees = written(build_trees(docs, leaf_chars, ranks), "trees")
    edited = _keyed(docs).where(F.col("text").rlike(touched)).dropDuplicates(["doc_id", "th"])
    own = trees.select(F.col("doc_id").alias("__d"), F.col("th").alias("__t"), "chars", "tokens").dropDuplicates(["__d", "__t"])
    pairs = edited.join(own, edited["doc_id"].eqNullSafe(own["__d"]) & (edited["th"] == own["__t"])).drop("__d", "__t")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks)
        for batch in slices(batches):
            found = []
            leaves = zip(batch.column("chars").to_pylist(), batch.column("tokens").to_pylist())
            for text, (chars, tokens) in zip(texts_of(batch.column("text")), leaves):
                text = text.decode("utf-8", "replace")
                edits = edits_of(text)
                found.append((len(edits), *apply_edits(text, chars, tokens, edits, lambda part: len(encode(part)))))
            numbers = np.array(found, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), *(pa.array(numbers[:, i]) for i in range(3))], ["e_id", "e_th", "n_edits", "after", "encoded"])

    changed = pairs.mapInArrow(run, f"e_id {kind}, e_th long, n_edits long, after long, encoded long")
    joined = trees.drop("chars", "tokens").join(changed, F.col("doc_id").eqNullSafe(F.col("e_id")) & (F.col("th") == F.col("e_th")), "left")
    zero = F.lit(0).cast("long")
    return joined.select(
        "doc_id", "n_tokens", F.coalesce("n_edits", zero).alias("n_edits"), F.coalesce("after", "n_tokens").alias("n_tokens_after"), F.coalesce("encoded", zero).alias("n_chars_encoded")
    )
