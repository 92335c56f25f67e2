"""SimHash near-dedup with pivot distance tables.

A fingerprint has a bit set where over half of the text's 4-word shingles have it. Fingerprints
link at ``max_bits`` or fewer differing bits, and the links' connected components are the groups.

1. Equal fingerprints are one class from here on, so copies cost nothing.
2. Candidates. 64 bits are cut into m blocks; two fingerprints that differ in at most 4 bits agree
   in m - 4 of them. Each class goes to one bucket for every choice of m - 4 blocks. m grows with
   the number of classes and keeps the expected bucket small; it changes no result.
3. In a bucket the Hamming distances to many reference fingerprints are tabled. A pair whose
   distances to any reference differ by more than ``max_bits`` cannot link and is discarded; the
   survivors are compared bit by bit. The first references are members of the bucket: whatever lies
   within reach of one joins its group at once, and only pairs of different groups go on. A bucket
   therefore reports a spanning forest, never all pairs.
4. A bucket with over ``TILE`` members is worked by pairs of its tiles, in separate groups.

Defined cases: texts without words have fingerprint zero and link like others; fewer than four
words are one shingle; rows of one id are one document; a null id is never the smallest; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sealrank.llm.components import components
from sealrank.llm.tables import written
from sealrank.llm.words import mix, slices, texts_of

SHINGLE = 4
SEED = 42
MAX_BITS = 4
# References per bucket: members first, then fixed pseudorandom fingerprints.
MEMBER_PIVOTS, FIXED_PIVOTS = 16, 16
BUCKET = 256  # classes expected in a bucket at most
TILE = 16_384

_FIXED = mix(np.arange(1, FIXED_PIVOTS + 1, dtype=np.uint64) << np.uint64(40))


def fingerprint(text: bytes) -> int:
    joined = b" ".join(text.lower().split())
    if not joined:
        return 0
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts, ends = [0, *(gaps + 1).tolist()], [*gaps.tolist(), len(joined)]
    size = min(SHINGLE, len(starts))
    spans = zip(starts, ends[size - 1 :])
    n = len(starts) - size + 1
    hashes = np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans), "<u8", n)
    counts = np.zeros(64, np.int64)
    for i in range(0, n, 65536):
        part = hashes[i : i + 65536].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text) and the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = np.array([fingerprint(text) for text in texts_of(batch.column("text"))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(found.view(np.int64))], ["doc_id", "th", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("th"), "text").mapInArrow(run, f"doc_id {kind}, th long, fp long")


def blocks_for(classes: int) -> int:
    """The fewest blocks whose choices spread ``classes`` evenly drawn fingerprints to BUCKET or fewer."""
    for m in range(MAX_BITS + 1, 13):
        if classes / 2 ** (64 * (m - MAX_BITS) / m) <= BUCKET:
            return m
    return 13


def bucket_keys(fp: Column, blocks: int) -> Column:
    """One key for each choice of blocks that two linked fingerprints could share."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in itertools.pairwise(edges)]
    keys = []
    for i, choice in enumerate(itertools.combinations(masks, blocks - MAX_BITS)):
        mask = sum(choice)
        signed = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.struct(F.lit(i).alias("table"), fp.bitwiseAND(F.lit(signed)).alias("bits")))
    return F.array(*keys)


def spanning_links(fps: np.ndarray, max_bits: int = MAX_BITS) -> list[tuple[int, int]]:
    """Pairs of indices that connect what links within ``max_bits`` connect, and nothing else."""
    n = len(fps)
    group = np.arange(n)
    links: list[tuple[int, int]] = []

    def join(a: int, b: int) -> None:
        if group[a] != group[b]:
            links.append((a, b))
            group[group == group[b]] = group[a]

    table = []
    for _ in range(MEMBER_PIVOTS if n > 2 * MEMBER_PIVOTS else 0):
        alone = np.flatnonzero(np.bincount(group, minlength=n)[group] == 1)
        if not len(alone):
            break
        pivot = int(alone[0])
        distance = np.bitwise_count(fps ^ fps[pivot]).astype(np.int8)
        table.append(distance)
        near = np.flatnonzero(distance <= max_bits)
        for b in near[np.unique(group[near], return_index=True)[1]].tolist():
            join(pivot, b)
    table.extend(np.bitwise_count(fps ^ pivot).astype(np.int8) for pivot in _FIXED[: FIXED_PIVOTS if n > 8 else 0])
    sizes = np.bincount(group, minlength=n)
    rest = np.flatnonzero(group != sizes.argmax())
    if sizes.max() == 1:
        rest = np.arange(n)
    done = np.zeros(n, bool)
    step = max(1, (1 << 20) // max(1, n))
    for i in range(0, len(rest), step):
        rows = rest[i : i + step]
        ok = (group[rows][:, None] != group[None, :]) & ~done[None, :]
        ok[np.arange(len(rows)), rows] = False
        x, y = np.nonzero(ok)
        x = rows[x]
        for distance in table:
            close = np.abs(distance[x] - distance[y]) <= max_bits
            x, y = x[close], y[close]
        close = np.bitwise_count(fps[x] ^ fps[y]) <= max_bits
        for a, b in zip(x[close].tolist(), y[close].tolist()):
            join(a, b)
        done[rows] = True
    return links


def _bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each bucket of a partition that is sorted by bucket; holds one bucket and one batch."""

    def links_of(fps: np.ndarray) -> np.ndarray:
        fps = np.unique(fps)
        pairs = np.array(spanning_links(fps.view(np.uint64)), np.int64).reshape(-1, 2)
        return fps[pairs]

    def send(found: list[np.ndarray]) -> pa.RecordBatch:
        rows = np.concatenate([np.zeros((0, 2), np.int64), *found])
        return pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1])], ["a", "b"])

    names = ["table", "bits", "tile_a", "tile_b"]
    held: list[np.ndarray] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [np.asarray(batch.column(name)) for name in names]
        fps = np.asarray(batch.column("fp"))
        edges = [0, *(np.flatnonzero(np.logical_or.reduce([key[1:] != key[:-1] for key in keys])) + 1).tolist(), len(fps)]
        found = []
        for a, b in itertools.pairwise(edges):
            key = tuple(int(k[a]) for k in keys)
            if key != last and held:
                found.append(links_of(np.concatenate(held)))
                held = []
            last = key
            held.append(fps[a:b])
        # All but the bucket that may go on are finished; single members have no links.
        yield send([pairs for pairs in found if len(pairs)])
    if held:
        yield send([links_of(np.concatenate(held))])


def links(classes: DataFrame) -> DataFrame:
    """Links (a, b) of fingerprints that give the same components as all links within MAX_BITS."""
    blocks = blocks_for(classes.count())
    keyed = classes.select("fp", F.explode(bucket_keys(F.col("fp"), blocks)).alias("k")).select("fp", "k.table", "k.bits")
    sizes = keyed.groupBy("table", "bits").count().where("count > 1")
    tiles = F.ceil(F.col("count") / TILE).cast("int")
    tile = F.pmod(F.xxhash64("fp"), tiles).cast("int")
    other = F.explode(F.sequence(F.lit(0), tiles - 1))
    rows = keyed.join(sizes, ["table", "bits"]).select("fp", "table", "bits", tile.alias("tile"), other.alias("other"))
    rows = rows.select("fp", "table", "bits", F.least("tile", "other").alias("tile_a"), F.greatest("tile", "other").alias("tile_b"))
    keys = ["table", "bits", "tile_a", "tile_b"]
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_bucket_links, "a long, b long")


def _grouped(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, th, fp, component_id, and root, which tells groups apart that lack an id."""
    prints = written(fingerprints(docs), "fingerprints")
    classes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    roots = components(links(classes))
    rooted = classes.join(roots, classes["fp"] == roots["vertex"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    membership = written(rooted.select("fp", "root").join(named, "root").select("fp", "root", "component_id"), "membership")
    return prints.join(membership, "fp").select("doc_id", "th", "fp", "root", "component_id")


def near_groups(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, fp (signed long), component_id."""
    return _grouped(docs).select("doc_id", "fp", "component_id")


def near_dedup(docs: DataFrame) -> DataFrame:
    """One row of each group, of the smallest id and then the smallest hash of the text; all columns stay.

    A row without an id stays only where no document of its group has one. Of rows that repeat id and text any one stays.
    """
    rows = _grouped(docs).groupBy("root", "doc_id", "th").count()
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "th", "count")).alias("f")
    stay = written(rows.groupBy("root").agg(first).select(F.col("f.doc_id").alias("__keep"), F.col("f.th").alias("__kept"), F.col("f.count").alias("__n")), "stay")

    def held(rows: DataFrame, stay: DataFrame) -> DataFrame:
        return rows.join(stay, rows["doc_id"].eqNullSafe(stay["__keep"]) & (rows["__th"] == stay["__kept"]), "left_semi")

    # The caller's columns travel in one struct, so that none of their names can clash.
    rows = docs.select(F.struct(*docs.columns).alias("__row"), "doc_id", F.xxhash64("text").alias("__th"))
    several = stay.where("__n > 1")
    if several.isEmpty():
        found = held(rows, stay)
    else:
        once = held(rows, several).dropDuplicates(["doc_id", "__th"])
        found = held(rows, stay.where("__n = 1")).unionByName(once)
    return found.select(*[F.col("__row").getField(name).alias(name) for name in docs.columns])


def digests(groups: DataFrame) -> DataFrame:
    """The groups with the fingerprint as 16 hex digits."""
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
