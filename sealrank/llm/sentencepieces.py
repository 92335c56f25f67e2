"""SentencePiece encoding (pieces that merge by score) and decoding.

The result of merging is a list of pieces in which every neighbouring pair, merged by itself, stays the
pair it is; and the pieces of a prefix's result are those of the whole, so each prefix of a text has one
last piece. The table of these last pieces is filled from left to right: an automaton (a trie that is
walked from all positions at once) names the pieces that end at a position, and the one that fits the
last piece before it is the entry. The ids are then read backwards from the end of the table.

Whether a pair fits is found by undoing its merges, latest first: at each step the two pieces that meet
must not have had a better merge than the one that came next. Answers are kept in a table of fixed size,
as are the ids of words, so that a batch encodes the words it has not met, all of them side by side.

A text is cut where no merge can cross: before white space that follows something else, and around line
breaks, as far as the model's pieces allow it. What is longer than ``LONG`` is encoded in overlapping
blocks that are joined where both have a piece boundary and the two pieces there fit; blocks without such
a place are encoded as one.

Defined cases: a null or empty text has the begin and end ids only and decodes to the empty text; a byte
that is not UTF-8 counts as U+FFFD; characters without a piece become their bytes' ids; rows that repeat
each have a result; an empty table gives no rows; other columns are ignored, whatever their names.
Models other than merging ones with identity normalisation and byte pieces are an error.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from sentencepiece import sentencepiece_model_pb2

from sealrank.llm.words import slices, texts_of

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SPACE = "▁"
# Segments are encoded by themselves up to this many characters, else in blocks that share OVERLAP.
LONG, OVERLAP = 256, 64
# Characters of a text that are cut into segments at once, and segments encoded side by side.
CHUNK, SIDE_BY_SIDE = 1 << 19, 1 << 17
# Entries of the tables of words and of pairs.
WORDS, PAIRS = 1 << 18, 1 << 20
NONE, UNKNOWN = -1, -2


class Lookup:
    """A fixed map from int64 to int32 for whole arrays; ``NONE`` where a key is missing."""

    def __init__(self, entries: dict[int, int]):
        keys = np.array(sorted(entries), np.int64)
        self.values = np.array([entries[int(k)] for k in keys], np.int32)
        bits = max(4, int(4 * len(keys)).bit_length())
        self.shift, self.slots = np.uint64(64 - bits), np.full(1 << bits, NONE, np.int64)
        self.held = np.full(1 << bits, NONE, np.int32)
        self.steps, left = 0, np.arange(len(keys))
        while len(left):  # open addressing, a round per step away from the home slot
            slot = (self._home(keys[left]) + self.steps) & (len(self.slots) - 1)
            free = np.flatnonzero(self.slots[slot] == NONE)
            _, first = np.unique(slot[free], return_index=True)
            placed = free[first]
            self.slots[slot[placed]], self.held[slot[placed]] = keys[left[placed]], self.values[left[placed]]
            left = np.delete(left, placed)
            self.steps += 1

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        slot = self._home(keys)
        met = self.slots[slot]
        out = np.where(met == keys, self.held[slot], NONE).astype(np.int32)
        open_ = np.flatnonzero((met != keys) & (met != NONE))
        for step in range(1, self.steps):
            if not len(open_):
                break
            at = (slot[open_] + step) & (len(self.slots) - 1)
            met = self.slots[at]
            right = met == keys[open_]
            out[open_[right]] = self.held[at[right]]
            open_ = open_[~right & (met != NONE)]
        return out


def merge(text: str, rank: dict[str, int]) -> list[str]:
    """Pieces of ``text`` by merging the best neighbours, the leftmost of equals, until none is a piece."""
    parts = list(text)
    while len(parts) > 1:
        best = min((rank.get(parts[i] + parts[i + 1], len(rank)), i) for i in range(len(parts) - 1))
        if best[0] == len(rank):
            break
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


class PieceTable:
    """The model's pieces as arrays, by number: its ids, then characters that are in pieces but are none."""

    def __init__(self, path: str):
        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            proto.ParseFromString(file.read())
        kinds = sentencepiece_model_pb2.ModelProto.SentencePiece
        trainer, normalizer = proto.trainer_spec, proto.normalizer_spec
        if (
            trainer.model_type != trainer.BPE or not trainer.byte_fallback or trainer.treat_whitespace_as_suffix
            or normalizer.precompiled_charsmap or normalizer.remove_extra_whitespaces or not normalizer.escape_whitespaces
            or any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in proto.pieces)
        ):
            raise ValueError("a merging model with identity normalisation and byte pieces is needed")
        self.prefix = SPACE if normalizer.add_dummy_prefix else ""
        ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == kinds.NORMAL}
        self.bytes = np.zeros(256, np.uint32)
        for i, p in enumerate(proto.pieces):
            if p.type == kinds.BYTE:
                self.bytes[int(p.piece[3:5], 16)] = i
        scores = np.array([-proto.pieces[i].score for i in ids.values()])
        rank = dict(zip(ids, np.unique(scores, return_inverse=True)[1].tolist()))
        self.rank_of = rank
        chars = sorted(set("".join(ids)))
        self.names = [p.piece for p in proto.pieces]
        for char in chars:
            if char not in ids:
                ids[char] = len(self.names)
                self.names.append(char)
        self.base = len(proto.pieces)  # numbers from here on are characters without an id
        self.n = len(self.names)
        self.length = np.array([len(name) for name in self.names], np.int64)
        self._derive(ids, rank)
        self._grow(ids, chars)
        between = {name[i : i + 2] for name in ids for i in range(len(name) - 1)}
        self.segments = self._pattern(between, chars)
        self.pair_keys, self.pair_fits = np.full(PAIRS, NONE, np.int64), np.zeros(PAIRS, bool)
        self.words: dict[str, bytes] = {}

    def _derive(self, ids: dict[str, int], rank: dict[str, int]) -> None:
        """How each piece comes about: its two parts, and whether each merge on the way has a worse rank than
        those before it; pieces that merging never yields are left out."""
        self.left, self.right = np.full(self.n, NONE, np.int32), np.full(self.n, NONE, np.int32)
        self.rank, self.regular = np.full(self.n, -1, np.int64), np.ones(self.n, bool)
        several = np.bincount(list(rank.values()), minlength=1)
        self.valid = {}
        meets: dict[int, int] = {}
        for name in sorted(ids, key=len):
            number = ids[name]
            if len(name) == 1:
                self.valid[name] = number
                continue
            splits = [(ids[name[:i]], ids[name[i:]]) for i in range(1, len(name)) if name[:i] in ids and name[i:] in ids]
            for left, right in splits:
                meets[left * self.n + right] = rank[name]
            self.rank[number] = rank[name]
            last = self._last_merge(name, rank)
            if last is None:
                continue
            left, right = ids[last[0]], ids[last[1]]
            self.valid[name] = number
            self.left[number], self.right[number] = left, right
            self.regular[number] = bool(
                self.regular[left] and self.regular[right] and several[rank[name]] == 1
                and rank[name] > max(self.rank[left], self.rank[right])
            )
        self.meets = Lookup(meets)

    @staticmethod
    def _last_merge(name: str, rank: dict[str, int]) -> tuple[str, str] | None:
        parts = list(name)
        while len(parts) > 2:
            best = min((rank.get(parts[i] + parts[i + 1], len(rank)), i) for i in range(len(parts) - 1))
            if best[0] == len(rank):
                return None
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts[0], parts[1]

    def _grow(self, ids: dict[str, int], chars: list[str]) -> None:
        """The trie of all valid pieces: transitions by node and class of character, and the piece at a node."""
        self.classes = np.zeros(0x110000, np.int32)
        self.classes[[ord(char) for char in chars]] = np.arange(1, len(chars) + 1)
        n_classes, nodes, edges, ends = len(chars) + 1, {"": 0}, {}, [NONE]
        for name, number in self.valid.items():
            for i in range(1, len(name) + 1):
                if name[:i] not in nodes:
                    edges[nodes[name[: i - 1]] * n_classes + int(self.classes[ord(name[i - 1])])] = len(nodes)
                    nodes[name[:i]] = len(nodes)
                    ends.append(NONE)
            ends[nodes[name]] = number
        self.n_classes, self.edges, self.ends = n_classes, Lookup(edges), np.array(ends, np.int32)
        self.deepest = max(map(len, self.valid), default=0)

    @staticmethod
    def _pattern(between: set[str], chars: list[str]) -> tuple[re.Pattern, re.Pattern]:
        """Segments of a text, and the places where a long text may be cut."""
        line = "\n" not in chars
        if any(pair[1] == SPACE and pair[0] != SPACE for pair in between):
            return (re.compile(r"[^\n]+|\n"), re.compile(r"\n")) if line else (re.compile(r"(?s).+"), re.compile(r"(?!)"))
        if line:
            return re.compile(rf"{SPACE}*[^{SPACE}\n]+|\n|{SPACE}+"), re.compile(rf"\n|(?<=[^{SPACE}]){SPACE}")
        return re.compile(rf"{SPACE}*[^{SPACE}]+|{SPACE}+"), re.compile(rf"(?<=[^{SPACE}]){SPACE}")

    # Pairs

    def fits(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether merging the text of a pair of pieces yields that pair, for arrays of pairs."""
        keys = left.astype(np.int64) * self.n + right
        slot = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64) & (PAIRS - 1)
        out = self.pair_fits[slot]
        fresh = np.flatnonzero(self.pair_keys[slot] != keys)
        if len(fresh):
            new, back = np.unique(keys[fresh], return_inverse=True)
            found = self._undo(new // self.n, new % self.n)
            out[fresh] = found[back]
            self.pair_keys[slot[fresh]], self.pair_fits[slot[fresh]] = keys[fresh], found[back]
            # Two new keys of one slot: the last key written is the one that stands, so is its answer.
        return out

    def _undo(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        fit = np.ones(len(left), bool)
        odd = np.flatnonzero(~(self.regular[left] & self.regular[right]))
        for i in odd:
            a, b = self.names[left[i]], self.names[right[i]]
            fit[i] = merge(a + b, self.rank_of) == [a, b]
        open_ = np.flatnonzero(self.regular[left] & self.regular[right])
        a, b = left[open_].astype(np.int64), right[open_].astype(np.int64)
        until = np.full(len(open_), np.iinfo(np.int64).max)
        while len(open_):
            crossing = self.meets(a * self.n + b)
            crossed = (crossing != NONE) & (crossing < until)
            fit[open_[crossed]] = False
            ahead = ~crossed & ((self.left[a] != NONE) | (self.left[b] != NONE))
            open_, a, b = open_[ahead], a[ahead], b[ahead]
            later = self.rank[a] > self.rank[b]  # of one rank, the left one merged first
            until = np.where(later, self.rank[a], self.rank[b] + 1)
            a, b = np.where(later, self.right[a], a), np.where(later, b, self.left[b])
        return fit

    # Segments

    def _fill(self, cls: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The last piece of each prefix, for segments side by side; indexed by the prefix's last character."""
        segment_end, segment_start = np.repeat(ends, ends - starts), np.repeat(starts, ends - starts)
        alive, node = np.arange(len(cls)), np.zeros(len(cls), np.int64)
        begins, pieces = [], []
        for depth in range(self.deepest):
            node = self.edges(node * self.n_classes + cls[alive + depth])
            on = node != NONE
            alive, node = alive[on], node[on].astype(np.int64)
            piece = self.ends[node]
            hit = piece != NONE
            begins.append(alive[hit])
            pieces.append(piece[hit])
            on = alive + depth + 1 < segment_end[alive]
            alive, node = alive[on], node[on]
            if not len(alive):
                break
        begin, piece = np.concatenate(begins), np.concatenate(pieces).astype(np.int64)
        last = begin + self.length[piece] - 1
        local = last - segment_start[last]
        order = np.argsort(local, kind="stable")
        begin, piece, last, local = begin[order], piece[order], last[order], local[order]
        table = np.where(cls == 0, UNKNOWN, NONE).astype(np.int64)
        bounds = np.searchsorted(local, np.arange(int(local[-1]) + 2 if len(local) else 1))
        first = begin == segment_start[begin]
        for low, high in zip(bounds[:-1], bounds[1:]):
            if low == high:
                continue
            own, at, to = piece[low:high], begin[low:high], last[low:high]
            before = np.where(first[low:high], UNKNOWN, table[at - 1])
            right = before == UNKNOWN
            ask = np.flatnonzero(before >= 0)
            right[ask] = self.fits(before[ask], own[ask])
            table[to[right]] = own[right]
        return table

    def _back(self, table: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the pieces of all segments end and what they are, in the order of the text."""
        at, low, where, what = ends - 1, starts, [], []
        while len(at):
            piece = table[at]
            if (piece == NONE).any():
                raise AssertionError("a prefix has no last piece")
            where.append(at)
            what.append(piece)
            at = at - np.where(piece == UNKNOWN, 1, self.length[piece])
            on = at >= low
            at, low = at[on], low[on]
        where_all, what_all = np.concatenate(where), np.concatenate(what)
        order = np.argsort(where_all)
        return where_all[order], what_all[order]

    def _pieces(self, cls: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self._back(self._fill(cls, starts, ends), starts, ends)

    def _long(self, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pieces of one long segment from overlapping blocks, joined where their pieces fit."""
        n = len(cls)
        starts = np.arange(0, max(1, n - OVERLAP), LONG)
        ends = np.minimum(starts + LONG + OVERLAP, n)
        at = np.concatenate([np.arange(s, e) for s, e in zip(starts, ends)])
        sizes = ends - starts
        offsets = np.cumsum(sizes) - sizes
        where, what = self._pieces(cls[at], offsets, offsets + sizes)
        cuts = np.searchsorted(where, np.r_[offsets, len(at)])
        blocks = [(where[cuts[k] : cuts[k + 1]] - offsets[k] + starts[k], what[cuts[k] : cuts[k + 1]]) for k in range(len(starts))]
        done_where, done_what, begin = [], [], 0
        where, what = blocks[0]
        for k in range(1, len(blocks)):
            next_where, next_what = blocks[k]
            next_begin = int(starts[k])
            joint = self._joint(where, what, next_where, next_what)
            if joint is None:  # no place fits: encode what is open and this block as one
                end = int(ends[k])
                own_where, own_what = self._pieces(cls[begin:end], np.array([0]), np.array([end - begin]))
                where, what = own_where + begin, own_what
                continue
            left, right = joint
            # What lies well before the next block's begin never changes again.
            done_where.append(where[:left])
            done_what.append(what[:left])
            begin = int(where[left - 1]) + 1 if left else next_begin
            where, what = next_where[right:], next_what[right:]
        return np.concatenate([*done_where, where]), np.concatenate([*done_what, what])

    def _joint(self, where, what, next_where, next_what) -> tuple[int, int] | None:
        """How many pieces of the first block and from which of the next on, so that the pieces that meet fit."""
        _, left, right = np.intersect1d(where, next_where, return_indices=True)
        ok = (right + 1 < len(next_what)) & (left + 1 <= len(what))
        left, right = left[ok], right[ok] + 1
        if not len(left):
            return None
        a, b = what[left], next_what[right]
        fit = (a == UNKNOWN) | (b == UNKNOWN)
        ask = np.flatnonzero(~fit)
        fit[ask] = self.fits(a[ask], b[ask])
        found = np.flatnonzero(fit)
        return (int(left[found[0]]) + 1, int(right[found[0]])) if len(found) else None

    def _as_ids(self, points: np.ndarray, where: np.ndarray, what: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces, characters without one as their bytes; and the number of ids of each piece."""
        out = what.astype(np.int64)
        without = np.flatnonzero((what == UNKNOWN) | (what >= self.base))
        sizes = np.ones(len(what), np.int64)
        if not len(without):
            return out.astype("<u4"), sizes
        chars = points[where[without]]
        sizes[without] = 1 + (chars >= 0x80).astype(int) + (chars >= 0x800) + (chars >= 0x10000)
        ids = np.repeat(out, sizes).astype("<u4")
        raw = np.frombuffer(chars.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
        ids[np.repeat((what == UNKNOWN) | (what >= self.base), sizes)] = self.bytes[raw]
        return ids, sizes

    def encode_segments(self, segments: list[str]) -> list[bytes]:
        """The ids of each segment as little-endian 32-bit numbers."""
        out: list[bytes] = [b""] * len(segments)
        short = [i for i, segment in enumerate(segments) if len(segment) <= LONG + OVERLAP]
        for i, segment in enumerate(segments):
            if len(segment) > LONG + OVERLAP:
                points = np.frombuffer(segment.encode("utf-32-le"), "<u4")
                out[i] = self._as_ids(points, *self._long(self.classes[points]))[0].tobytes()
        short.sort(key=lambda i: len(segments[i]))  # neighbours in a group then have similar lengths
        group: list[int] = []
        size = 0
        for place, i in enumerate(short):
            group.append(i)
            size += len(segments[i])
            if size >= SIDE_BY_SIDE or place == len(short) - 1:
                points = np.frombuffer("".join([segments[k] for k in group]).encode("utf-32-le"), "<u4")
                lengths = np.array([len(segments[k]) for k in group], np.int64)
                ends = np.cumsum(lengths)
                where, what = self._pieces(self.classes[points], ends - lengths, ends)
                ids, sizes = self._as_ids(points, where, what)
                upto = np.cumsum(sizes)[np.searchsorted(where, ends - 1)] * 4
                raw, begin = ids.tobytes(), 0
                for k, end in zip(group, upto.tolist()):
                    out[k], begin = raw[begin:end], end
                group, size = [], 0
        return out

    def encode_all(self, segments: list[list[str]]) -> list[bytes]:
        """The ids of lists of segments, each list's joined; words met before come from the table of words."""
        if len(self.words) > WORDS:
            self.words.clear()
        known, own = self.words, {}
        missing = [s for s in {s for listed in segments for s in listed} if s not in known]
        for segment, ids in zip(missing, self.encode_segments(missing)):
            (known if len(segment) <= LONG else own)[segment] = ids
        if own:
            return [b"".join([own[s] if len(s) > LONG else known[s] for s in listed]) for listed in segments]
        return [b"".join([known[s] for s in listed]) for listed in segments]

    def chunks(self, text: str) -> Iterator[str]:
        """The text as the model sees it, in chunks that no merge crosses."""
        if not text:
            return
        text = self.prefix + text.replace(" ", SPACE)
        start = 0
        while len(text) - start > 2 * CHUNK:
            cut = self.segments[1].search(text, start + CHUNK)
            if cut is None:
                break
            yield text[start : cut.start()]
            start = cut.start()
        yield text[start:]


@functools.cache
def piece_table(path: str = MODEL) -> PieceTable:
    return PieceTable(path)


class Decoder(NamedTuple):
    """The library's decode for texts whose ids come in chunks."""

    processor: sentencepiece.SentencePieceProcessor

    def __call__(self, ids: bytes, first: bool) -> str:
        listed = np.frombuffer(ids, "<u4").tolist()
        if first:
            return self.processor.decode([self.processor.bos_id(), *listed])
        lead = self.processor.piece_to_id("a")  # else the chunk's first space would go as the text's
        return self.processor.decode([lead, *listed])[1:]


@functools.cache
def decoder(path: str = MODEL) -> Decoder:
    return Decoder(sentencepiece.SentencePieceProcessor(model_file=path))


class Encoded:
    """What is gathered of a text while its chunks go by."""

    def __init__(self, begin: int, end: int, wanted: frozenset[str]):
        self.wanted, self.end, self.n, self.first = wanted, end, 0, True
        self.sha, self.text_sha = hashlib.sha256(), hashlib.sha256()
        self.parts: list[bytes] = []
        self.texts: list[str] = []
        self._ids(np.array([begin], "<u4").tobytes())

    def _ids(self, ids: bytes) -> None:
        self.n += len(ids) // 4
        self.sha.update(ids)
        if "ids" in self.wanted:
            self.parts.append(ids)

    def add(self, ids: bytes, decode: Decoder) -> None:
        self._ids(ids)
        if "decoded" in self.wanted or "decoded_sha256" in self.wanted:
            text = decode(ids, self.first)
            self.text_sha.update(text.encode())
            if "decoded" in self.wanted:
                self.texts.append(text)
        self.first = False

    def result(self) -> dict[str, object]:
        self._ids(np.array([self.end], "<u4").tobytes())
        return {
            "n_tokens": self.n,
            "ids_sha256": self.sha.hexdigest(),
            "decoded_sha256": self.text_sha.hexdigest(),
            "ids": np.frombuffer(b"".join(self.parts), "<u4").astype(np.int32),
            "decoded": "".join(self.texts),
        }


KINDS = {
    "n_tokens": (pa.int64(), "long"),
    "ids_sha256": (pa.string(), "string"),
    "decoded_sha256": (pa.string(), "string"),
    "ids": (pa.list_(pa.int32()), "array<int>"),
    "decoded": (pa.string(), "string"),
}
DIGESTS = ("n_tokens", "ids_sha256", "decoded_sha256")


def encode(docs: DataFrame, columns: tuple[str, ...] = ("n_tokens", "ids", "decoded"), model: str = MODEL) -> DataFrame:
    """``doc_id`` and of each text the named columns: n_tokens, ids (begin and end included), decoded, and
    the digests ids_sha256 and decoded_sha256. One pass; texts stay where they are."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    wanted = frozenset(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, decode = piece_table(model), decoder(model)
        begin, end = decode.processor.bos_id(), decode.processor.eos_id()
        for batch in slices(batches):
            texts = texts_of(batch.column("text"))
            gathered = [Encoded(begin, end, wanted) for _ in texts]
            rows: list[int] = []
            held: list[list[str]] = []
            size = 0

            def settle() -> None:
                for row, ids in zip(rows, table.encode_all(held)):
                    gathered[row].add(ids, decode)
                rows.clear()
                held.clear()

            for row, text in enumerate(texts):
                for chunk in table.chunks(text.decode("utf-8", "replace")):
                    rows.append(row)
                    held.append(table.segments[0].findall(chunk))
                    size += len(chunk)
                    if size >= CHUNK:
                        settle()
                        size = 0
            settle()
            found = [one.result() for one in gathered]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array([one[c] for one in found], KINDS[c][0]) for c in columns)], ["doc_id", *columns]
            )

    schema = f"doc_id {kind}, " + ", ".join(f"{c} {KINDS[c][1]}" for c in columns)
    return docs.select("doc_id", "text").mapInArrow(run, schema)
