"""Scoring with a hashed maximum-entropy language model.

P(word | history) = P(class | history) * P(sub-class | class, history) * P(word | sub-class). The class
is a function of a word's last two letters, so that unseen words have one too, and the sub-class one of
the whole word; the end of a text is class 0. The first two factors are softmaxes of log-linear models
over hashed features. The class reads the word before, the two words before, the second and the third
word back (skips), and two pairs of earlier classes; the sub-class reads the first three of these
together with the class. In a sub-class a word has its relative frequency. An absolute discount moves
mass to the unseen words of a class, which count as one word beside its sub-classes.

Training. Word counts are summed over all training texts in one grouped aggregate. The weights
then see every training text once, in ``ROUNDS`` rounds over disjoint parts: a task starts from the
common weights, takes AdaGrad steps on mini-batches of its texts, and sends its change per block
of rows; the changes are averaged by how often each row was touched. Both softmaxes share a table of
rows that grows with the corpus, as the cube root of its tokens (``rows_for``): 16 MB at 0.5 GB of
text, 32 MB at 30 GB, 512 MB at 100 TB, which bounds what is broadcast and what a round sends to the driver. Training tasks are merged where their changes would outweigh what they read.

Scoring works on sparse batches: a token is ten row numbers, and its logits are sums of rows.
Counts of the frequent words, at most ``LEXICON`` of them, go to each task; all rarer words
of a text are joined with the whole table of counts.

Words are told apart by 64-bit hashes. A text beyond ``PIECE_BYTES`` is read in pieces, each after the
last words of the one before, so its tokens and features are those of the whole text. Defined cases: a
null text is empty and scores its end alone; a null id is not held out; repeated rows are trained on
and scored each; with no training text every class is equally likely and every word unseen; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sealrank.llm.tables import written
from sealrank.llm.words import chunks, mix, slices, texts_of

CLASSES = 16
SUBS = 16
FEATURES = 6
SUB_FEATURES = 3
# Words before a token that its features look at.
HISTORY = 4
LEAST_ROWS = 1 << 18
ROWS_FACTOR = 256
BLOCK_ROWS = 256
BATCH_BLOCKS = 64
ROUNDS = 3
# Tokens of one training step, and of one scoring batch, whose arrays stay in a core's cache.
STEP_TOKENS = 4096
BATCH_TOKENS = 4096
CHUNK_BYTES = 1 << 18
PIECE_BYTES = 1 << 20
LONG_WORD = 1 << 16
RATE = 0.3
LEXICON = 1 << 17
HELD_OUT_OF = 10
BASE_ADD = 0.1
_SPACE = re.compile(rb"[\x09-\x0d ]")


def rows_for(tokens: int) -> int:
    """Rows of the weight table: the power of two from ``ROWS_FACTOR`` times the cube root of the tokens."""
    return max(LEAST_ROWS, 1 << int(np.ceil(np.log2(ROWS_FACTOR * max(1, tokens) ** (1 / 3)))))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % HELD_OUT_OF == 0, F.lit(False))


_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)


@functools.lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def _word_sum(word: bytes) -> np.uint64:
    """The polynomial sum of a long word's bytes, block by block."""
    total, powers = 0, _powers(_BASE, LONG_WORD)
    for i in range(0, len(word), LONG_WORD):
        part = np.frombuffer(word[i : i + LONG_WORD], np.uint8).astype(np.uint64) + np.uint64(1)
        total += int((part * powers[: len(part)]).sum(dtype=np.uint64)) * pow(_BASE, i, 1 << 64)
    return np.uint64(total % (1 << 64))


class Tokens:
    """Tokens of some texts: word hashes, groups, and where each text begins; every text ends in END.

    Words are hashed from running polynomial sums over the bytes of all texts at once. A group is a
    class and a sub-class. Of a piece of a longer text, the first ``lead`` words are history only, and
    ``end`` tells whether the text ends in it.
    """

    def __init__(self, texts: list[bytes], lead: int = 0, end: bool = True) -> None:
        split = [text.lower().split() for text in texts]
        long: list[tuple[int, np.uint64]] = []
        sizes = np.zeros(len(split) + 1, np.int64)
        np.cumsum([len(words) + end for words in split], out=sizes[1:])
        for text, words, at in zip(texts, split, sizes):
            if len(text) > LONG_WORD:
                for i, word in enumerate(words):
                    if len(word) > LONG_WORD:
                        long.append((at + i, _word_sum(word)))
                        words[i] = word[-2:]
        # Each word is followed by a space and each text by a line end, itself the token END.
        last = b" \n " if end else b" "
        data = np.frombuffer(b"".join([b" ".join(words) + last if words else last[1:] for words in split]), np.uint8)
        stop = np.flatnonzero(data == 32)
        start = np.concatenate([[0], stop[:-1] + 1]).astype(np.int64)
        room = 1 << max(10, len(data).bit_length())
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, room)[: len(data)], out=sums[1:])
        values = (sums[stop] - sums[start]) * _powers(_INVERSE, room)[start]
        for at, value in long:
            values[at] = value
        every = mix(values)
        before = np.where(stop - start > 1, data[stop - 2], 0).astype(np.uint64)
        ends = before << np.uint64(8) | data[stop - 1]
        classes = (1 + (mix(ends) >> np.uint64(33)) % np.uint64(CLASSES - 1)).astype(np.int64)
        if end:
            classes[sizes[1:] - 1] = 0
        assert len(stop) == sizes[-1]
        self._place = np.arange(len(every)) - np.repeat(sizes[:-1], np.diff(sizes))
        self._hashes, self._classes, self._lead = every, classes, lead
        self.hashes, self.classes = every[lead:], classes[lead:]
        self.bounds = np.maximum(sizes - lead, 0)
        # The end of a text is alone in its class and needs no sub-class.
        self.subs = np.where(self.classes > 0, (mix(self.hashes + np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(40)) % np.uint64(SUBS), 0).astype(np.int64)
        self.groups = self.classes * SUBS + self.subs

    def features(self, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
        """FEATURES row numbers per token for its class and SUB_FEATURES for its sub-class.

        Places before a text's first word are empty.
        """
        n = len(self._hashes)

        def back(values: np.ndarray, steps: int) -> np.ndarray:
            out = np.zeros(n, np.uint64)
            out[steps:] = values[: n - steps] if steps < n else 0
            out[self._place < steps] = 0
            return out

        def rows(kinds: list[np.ndarray], first: int) -> np.ndarray:
            out = np.empty((len(kinds), n - self._lead), np.int64)
            for i, values in enumerate(kinds, first):
                out[i - first] = mix(values[self._lead :] + np.uint64((i * 0xA0761D6478BD642F) % (1 << 64))) >> np.uint64(64 - n_rows.bit_length() + 1)
            return out

        w1, w2, w3 = (back(self._hashes, i) for i in (1, 2, 3))
        c = [back(self._classes.astype(np.uint64) + np.uint64(1), i) for i in range(1, HISTORY + 1)]
        wide = np.uint64(CLASSES + 1)
        words = [w1, mix(w1) + w2, w2, w3]
        own = self._classes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        kinds = [*words, c[0] * wide + c[1], c[2] * wide + c[3]]
        return rows(kinds, 0), rows([values + own for values in words[:SUB_FEATURES]], FEATURES)


def token_runs(texts: list[bytes], limit: int) -> Iterator[tuple[int, int, Tokens]]:
    """(first text, text after the last, tokens): several whole texts, or a piece of one long text."""
    for a, b in chunks(texts, limit):
        if b - a > 1 or len(texts[a]) <= PIECE_BYTES:
            yield a, b, Tokens(texts[a:b])
            continue
        text, start, before = texts[a], 0, []
        while start < len(text):
            space = _SPACE.search(text, start + PIECE_BYTES)
            stop = space.end() if space else len(text)
            words = text[start:stop].split()
            if words or stop == len(text):
                yield a, b, Tokens([b" ".join([*before, text[start:stop]])], lead=len(before), end=stop == len(text))
            before = [*before, *words][-HISTORY:]
            start = stop


class Model(NamedTuple):
    """Weights of both softmaxes and the logits they start from."""

    weights: np.ndarray  # rows x CLASSES
    class_bias: np.ndarray  # CLASSES
    sub_bias: np.ndarray  # CLASSES x SUBS

    def chances(self, found: Tokens) -> np.ndarray:
        """Per token the probabilities of its class, and in it of its sub-class, after its history."""
        of_class, of_sub = found.features(len(self.weights))
        out = np.empty((2, len(found.hashes)))
        for i in range(0, out.shape[1], BATCH_TOKENS):
            cut = slice(i, i + BATCH_TOKENS)
            classes, subs = found.classes[cut], found.subs[cut]
            every = np.arange(len(classes))
            out[0, cut] = softmax(self.weights, self.class_bias, of_class[:, cut])[every, classes]
            inner = softmax(self.weights, self.sub_bias[classes], of_sub[:, cut])[every, subs]
            out[1, cut] = np.where(classes > 0, inner, 1)
        return out


def softmax(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray) -> np.ndarray:
    # Row numbers are within the weights, so "clip" changes none and only saves a check. Maxima and
    # sums of a row are taken column by column: along 16 entries numpy's own are slow.
    logits = np.take(weights, rows[0], axis=0, mode="clip")
    logits += bias
    part = np.empty_like(logits)
    for own in rows[1:]:
        np.take(weights, own, axis=0, out=part, mode="clip")
        logits += part
    most = logits[:, 0].copy()
    for column in logits.T[1:]:
        np.maximum(most, column, out=most)
    logits -= most[:, None]
    np.exp(logits, out=logits)
    logits /= (logits @ np.ones(logits.shape[1], logits.dtype))[:, None]
    return logits


def word_counts(train: DataFrame) -> DataFrame:
    """(h, g, c) of every word of the training texts, g its group; tasks add up what they read first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for _, _, tokens in token_runs(texts_of(batch.column("text")), PIECE_BYTES):
                hashes, first, n = np.unique(tokens.hashes, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes.view(np.int64)), pa.array(tokens.groups[first].astype(np.int32)), pa.array(n.astype(np.int64))], ["h", "g", "n"]
                )

    return train.select("text").mapInArrow(run, "h long, g int, n long").groupBy("h", "g").agg(F.sum("n").alias("c"))


def least_of(table: DataFrame, column: str, limit: int) -> float:
    """The smallest power of two that at most ``limit`` rows of a table reach in ``column``."""
    sizes = {r["e"]: r["count"] for r in table.groupBy(F.floor(F.log2(column)).alias("e")).count().collect()}
    return float(2 ** next(e for e in range(65) if sum(n for k, n in sizes.items() if k >= e) <= limit))


def _group_sums(values: np.ndarray, rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums, as 64-bit numbers, of the rows of ``values`` that ``rows`` names, group after group of ``sizes`` rows.

    Groups are filled up to fours with a row of zeros, so that most is added side by side.
    """
    fours = -(-sizes // 4)
    first = np.cumsum(fours) - fours
    filled = np.full(4 * fours.sum(), len(values))
    filled[np.repeat(4 * first - np.cumsum(sizes) + sizes, sizes) + np.arange(len(rows))] = rows
    wide = np.zeros((len(values) + 1, values.shape[1]))
    wide[:-1] = values
    parts = np.take(wide, filled, axis=0, mode="clip").reshape(-1, 4, values.shape[1])
    total = parts[:, 0] + parts[:, 1]
    total += parts[:, 2]
    total += parts[:, 3]
    return np.add.reduceat(total, first, axis=0)


class Steps:
    """AdaGrad steps of one task: its weights, squared gradients per row and how often a row was touched."""

    def __init__(self, model: Model) -> None:
        rows = len(model.weights)
        self.model = model._replace(weights=model.weights.copy())
        self.squares, self.touched = np.full(rows, 1e-6, np.float32), np.zeros(rows, np.float32)

    def step(self, rows: np.ndarray, bias: np.ndarray, targets: np.ndarray) -> None:
        """One step on the rows of some tokens towards their targets."""
        weights = self.model.weights
        error = softmax(weights, bias, rows)
        error[np.arange(len(targets)), targets] -= 1
        # The entries by row: row and place share one number that is sorted.
        bits = rows.size.bit_length()
        entries = np.sort(rows.ravel() << bits | np.arange(rows.size))
        which, token = entries >> bits, (entries & (1 << bits) - 1) % len(targets)
        first = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1]]))
        used, times = which[first], np.diff(first, append=len(which))
        # Most rows have one entry, whose error is their change.
        change = np.take(error, token[first], axis=0, mode="clip")
        several = np.flatnonzero(times > 1)
        if len(several):
            change[several] = _group_sums(error, token[np.repeat(times > 1, times)], times[several])
        squares = self.squares[used] + np.einsum("ij,ij->i", change, change) / CLASSES
        self.squares[used] = squares
        change *= (RATE / np.sqrt(squares))[:, None]
        weights[used] = np.subtract(np.take(weights, used, axis=0, mode="clip"), change, out=change)
        self.touched[used] += times

    def learn(self, found: Tokens) -> None:
        of_class, of_sub = found.features(len(self.model.weights))
        for i in range(0, len(found.hashes), STEP_TOKENS):
            cut = slice(i, i + STEP_TOKENS)
            self.step(of_class[:, cut], self.model.class_bias, found.classes[cut])
            words = i + np.flatnonzero(found.classes[cut])
            if len(words):
                self.step(of_sub[:, words], self.model.sub_bias[found.classes[words]], found.subs[words])


def _local_changes(model: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Learns from the task's texts; yields the change of each block and how often its rows were touched."""
    steps = Steps(model)
    for batch in slices(batches):
        for _, _, tokens in token_runs(texts_of(batch.column("text")), CHUNK_BYTES):
            steps.learn(tokens)
    blocks = np.flatnonzero(steps.touched.reshape(-1, BLOCK_ROWS).any(axis=1))
    for start in range(0, len(blocks), BATCH_BLOCKS):
        own, parts = blocks[start : start + BATCH_BLOCKS], ([], [])
        for block in own:
            part = slice(block * BLOCK_ROWS, (block + 1) * BLOCK_ROWS)
            parts[0].append((steps.model.weights[part] - model.weights[part]).astype(np.float16).tobytes())
            parts[1].append(steps.touched[part].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), *map(pa.array, parts)], ["block", "change", "touched"])


def _sum_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up the changes of each block; holds one sum per block."""
    sums: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for block, *parts in zip(*(batch.column(name).to_pylist() for name in ("block", "change", "touched"))):
            touched = np.frombuffer(parts[1], np.float32).astype(np.float64)
            values = [np.frombuffer(parts[0], np.float16).reshape(BLOCK_ROWS, -1) * touched[:, None], touched]
            if block in sums:
                for total, value in zip(sums[block], values):
                    total += value
            else:
                sums[block] = values
    for block, (change, touched) in sums.items():
        mean = (change / np.maximum(touched, 1)[:, None]).astype(np.float32)
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([mean.tobytes()])], ["block", "mean"])


def train_weights(train: DataFrame, model: Model, rounds: int = ROUNDS, tokens: int = 0) -> Model:
    """The model after each training text was seen once, a disjoint part per round.

    A task sends about the table's size whatever it reads, so there are at most as many tasks as have
    four times that to read (about six bytes a token), or as there are cores.
    """
    spark = train.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, 6 * tokens // (4 * model.weights.nbytes))
    for turn in range(rounds):
        shared = spark.sparkContext.broadcast(model)
        part = train.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(rounds)) == turn).select("text").coalesce(tasks)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            return _local_changes(shared.value, batches)

        changes = part.mapInArrow(run, "block int, change binary, touched binary")
        # As many rows as blocks: together one table of weights.
        means = changes.repartition("block").mapInArrow(_sum_blocks, "block int, mean binary").collect()
        weights = model.weights.copy()
        for row in means:
            part_rows = slice(row["block"] * BLOCK_ROWS, (row["block"] + 1) * BLOCK_ROWS)
            weights[part_rows] += np.frombuffer(row["mean"], np.float32).reshape(BLOCK_ROWS, CLASSES)
        model = model._replace(weights=weights)
        shared.unpersist()
    return model


def score(docs: DataFrame, rounds: int = ROUNDS, lexicon: int = LEXICON) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    train = rows.where(~F.col("held_out")).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    counts = written(word_counts(train), "counts")

    by_group = counts.groupBy("g").agg(
        F.sum("c").alias("n"), F.count(F.lit(1)).alias("v"), F.sum((F.col("c") == 1).cast("long")).alias("n1"), F.sum((F.col("c") == 2).cast("long")).alias("n2")
    ).toPandas()  # CLASSES x SUBS rows at most
    tokens, types = int(by_group["n"].sum()), int(by_group["v"].sum())
    ones, twos = int(by_group["n1"].sum()), int(by_group["n2"].sum())
    discount = float(np.clip(ones / (ones + 2 * twos), 0.1, 0.9)) if ones else 0.1
    n_group, told = np.zeros((CLASSES, SUBS)), np.zeros((CLASSES, SUBS))
    at = np.divmod(by_group["g"].to_numpy(np.int64), SUBS)
    n_group[at], told[at] = by_group["n"], by_group["n"] - discount * by_group["v"]
    n_class, told_class = n_group.sum(axis=1), told.sum(axis=1)
    # Within a class: the mass of its unseen words, and of each sub-class what is left of it by the discount.
    unseen = np.where(n_class > 0, 1 - told_class / np.maximum(n_class, 1), 1.0)
    log_unseen = np.repeat(np.log10(unseen), SUBS)
    log_group = np.log10(np.where(told > 0, told, 1) / np.where(unseen < 1, 1 - unseen, 1)[:, None]).ravel()
    class_bias = np.log((n_class + 1) / (tokens + CLASSES)).astype(np.float32)
    sub_bias = np.log((told + 1) / (told_class + SUBS)[:, None]).astype(np.float32)
    start = Model(np.zeros((rows_for(tokens), CLASSES), np.float32), class_bias, sub_bias)
    model = train_weights(train, start, rounds, tokens)

    least = least_of(counts, "c", lexicon)
    common = counts.where(F.col("c") >= least).select("h", "c").toPandas()
    lex_hash = common["h"].to_numpy().view(np.uint64)
    order = np.argsort(lex_hash)
    shared = spark.sparkContext.broadcast((model, lex_hash[order], common["c"].to_numpy()[order].astype(np.float64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, lex_hash, lex_count = shared.value
        for batch in slices(batches):
            for a, b, found in token_runs(texts_of(batch.column("text")), CHUNK_BYTES):
                of_class, of_sub = np.log10(model.chances(found))
                # Each different word is looked up once.
                words, place = np.unique(found.hashes, return_inverse=True)
                at = np.minimum(np.searchsorted(lex_hash, words), max(0, len(lex_hash) - 1))
                in_lexicon = lex_hash[at] == words if len(lex_hash) else np.zeros(len(words), bool)
                c = np.where(in_lexicon, lex_count[at] if len(lex_hash) else 0.0, 1.0)
                known = in_lexicon[place]
                base = np.where(in_lexicon, np.log10(c + BASE_ADD), 0.0)[place]
                in_group = np.log10(np.maximum(c - discount, 1e-9))[place] - log_group[found.groups]
                own = of_class + np.where(known, of_sub + in_group, 0.0)
                starts = found.bounds[:-1]
                # Per text and rare word one entry: how often it occurs, and the sum of its sub-class's logarithms.
                rare = np.flatnonzero(~known)
                text_of = np.repeat(np.arange(b - a), np.diff(found.bounds))
                pairs, at, of_pair, tf = np.unique(
                    text_of[rare] * len(words) + place[rare], return_index=True, return_inverse=True, return_counts=True
                )
                splits = np.searchsorted(pairs, np.arange(b - a + 1) * len(words))
                sums = np.bincount(of_pair, weights=of_sub[rare], minlength=len(pairs)).astype(float)
                rare_words = pa.StructArray.from_arrays(
                    [pa.array(words[pairs % len(words)].view(np.int64)), pa.array(found.groups[rare[at]].astype(np.int32)), pa.array(tf), pa.array(sums)],
                    ["h", "g", "tf", "s"],
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("row").slice(a, b - a), batch.column("doc_id").slice(a, b - a), batch.column("held_out").slice(a, b - a),
                        pa.array(np.diff(found.bounds)), pa.array(np.add.reduceat(known, starts, dtype=np.int64)),
                        pa.array(np.add.reduceat(base, starts)), pa.array(np.add.reduceat(own, starts)),
                        pa.ListArray.from_arrays(pa.array(splits.astype(np.int32)), rare_words),
                    ],
                    ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "own", "rare"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"row long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, own double, rare array<struct<h:long,g:int,tf:long,s:double>>"
    numbered = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", "text")
    parts = written(numbered.mapInArrow(run, schema), "scores")

    per_group = F.array(*map(F.lit, map(float, log_group))), F.array(*map(F.lit, map(float, log_unseen)))
    in_group, if_unseen = (F.element_at(values, F.col("g") + 1) for values in per_group)
    words = parts.select("row", F.explode("rare").alias("w")).select("row", "w.*")
    looked = words.join(counts.where(F.col("c") < least).select("h", "c"), "h", "left")
    c = F.coalesce("c", F.lit(0)).cast("double")
    per_row = looked.groupBy("row").agg(
        F.sum(F.when(c > 0, F.col("tf")).otherwise(0)).alias("r_known"),
        F.sum(F.col("tf") * F.log10(c + BASE_ADD)).alias("r_base"),
        F.sum(F.when(c > 0, F.col("tf") * (F.log10(c - discount) - in_group) + F.col("s")).otherwise(F.col("tf") * if_unseen)).alias("r_own"),
    )
    # A long text has a row for each piece, and its rare words are looked up once.
    sums = parts.groupBy("row", "doc_id", "held_out").agg(*(F.sum(name).alias(name) for name in ("n_tokens", "n_known", "base", "own")))
    total = sums.join(per_row, "row", "left")
    return total.select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_known") + F.coalesce("r_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("r_base", F.lit(0.0)) - F.col("n_tokens") * float(np.log10(tokens + BASE_ADD * (types + 1)))).alias("base_score"),
        (F.col("own") + F.coalesce("r_own", F.lit(0.0))).alias("score"),
    )
