"""Mixing sources to target weights.

Each source's words, document after document, are packed into blocks of fixed length. Output shards
draw how many blocks they take from every source from a multinomial with the target weights. The
draws of a source are numbered across shards; number k of an epoch maps to a block through the
source's pseudorandom permutation of block indices, and blocks are joined by index.

Draws scatter around the targets. Draws of a source beyond its target become vacancies, and
sources drawn too rarely fill the vacancies, number by number, so every source ends at its target
to the word: the last block of the last epoch is cut. A source's remainder of fewer words than a
block comes last in each epoch.

All numbering is done in hash buckets (``tables.running``), so a source with a third of all words
is no group of its own. A shard draws down a tree of sources, so there may be any number of them;
sources, documents, blocks and draws are never gathered. Everything follows from ``seed`` and the
rows, so reruns agree.

Defined cases: a null text has no words; null is a source of its own and comes last; a document
without words is never taken; repeated rows are taken independently; no words at all make all
targets zero; an empty table gives no rows; bytes that are not UTF-8 become U+FFFD;
``mixed_documents`` keeps all columns, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sealrank.llm.tables import buckets_for, running, written
from sealrank.llm.words import mix as scramble
from sealrank.llm.words import slices, texts_of

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MAX_EPOCHS = 2
BLOCK_WORDS = 128
SHARD_BLOCKS = 1024
SEED = 20_240_101
# Children of a node in the tree of sources that shards draw from.
FAN_OUT = 64
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ordered(df: DataFrame, by: str, name: str) -> DataFrame:
    """``df`` with ``name``, the place of a row in the order of ``by``, nulls last. Written once."""
    order = F.col(by).asc_nulls_last()
    parts = df.repartitionByRange(order).sortWithinPartitions(order)
    rows = written(
        parts.select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("__row")), "ordered"
    )
    counts = rows.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    before = counts.select("__part", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__shift"))
    return rows.join(before, "__part").select(*df.columns, (F.col("__row") + F.col("__shift")).alias(name))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MAX_EPOCHS) -> DataFrame:
    """Per source: source, src (its place), source_size, target. ``sizes`` has source and size."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("src") % len(weights) + 1).cast("int"))
    rows = written(ordered(totals, "source", "src").withColumn("weight", weight), "sources")
    cap = F.col("source_size") * most
    whole = rows.agg(F.sum("source_size")).first()[0] or 0
    level, before = 0.0, None
    while level != before:
        # Each round reshares what capped sources cannot take; capped sources stay capped.
        before = level
        capped = cap <= F.lit(level) * F.col("weight")
        taken, free = rows.agg(F.sum(F.when(capped, cap)), F.sum(F.when(~capped, F.col("weight")))).first()
        level = max(level, (share * whole - (taken or 0)) / free) if free else level
    return rows.select("source", "src", "source_size", F.least(cap.cast("double"), F.lit(level) * F.col("weight")).alias("target"))


def permute(k: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The place of k in a pseudorandom permutation of 0 .. n-1 chosen by ``key``: a Feistel walk."""
    bits = np.ceil(np.log2(np.maximum(n, 2)) / 2).astype(np.uint64)
    out, todo = k.astype(np.uint64), np.arange(len(k))
    while len(todo):
        half = bits[todo]
        mask = (np.uint64(1) << half) - np.uint64(1)
        left, right = out[todo] >> half, out[todo] & mask
        for turn in range(4):
            left, right = right, left ^ (scramble(right + scramble(key[todo] + np.uint64(turn + 1))) & mask)
        out[todo] = left << half | right
        todo = todo[out[todo] >= n[todo].astype(np.uint64)]
    return out.astype(np.int64)


def _draws(sources: DataFrame, shard_blocks: int, seed: int) -> DataFrame:
    """(shard, src, n): multinomial source counts of each shard.

    Sources are leaves of a tree in which a node has at most ``FAN_OUT`` children. A multinomial over all
    sources is one over the root's children, then one within each child that got any, and so on down, so no
    task holds more than the children of a node.
    """
    spark = sources.sparkSession
    slotted = sources.select("src", "slots").where("slots > 0")
    total, last = slotted.agg(F.sum("slots"), F.max("src")).first()
    if not total:
        return spark.createDataFrame([], "shard long, src long, n long")
    levels = 1
    while FAN_OUT**levels <= last:
        levels += 1

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = []
            for level, shard, node, n, children, sizes in batch.itertuples(index=False):
                children, sizes = np.asarray(children, np.int64), np.asarray(sizes, np.float64)
                took = np.random.default_rng([seed, level, shard, node]).multinomial(n, sizes / sizes.sum())
                got = took > 0
                parts.append(pd.DataFrame({"shard": np.int64(shard), "node": children[got], "n": took[got].astype(np.int64)}))
            if parts:
                yield pd.concat(parts)

    size = F.least(F.lit(shard_blocks).cast("long"), F.lit(total) - F.col("id") * shard_blocks)
    draws = spark.range(-(-total // shard_blocks)).select(F.col("id").alias("shard"), F.lit(0).cast("long").alias("node"), size.alias("n"))
    for level in reversed(range(levels)):
        width = F.lit(FAN_OUT**level)
        below = slotted.groupBy(F.floor(F.col("src") / width).alias("child")).agg(F.sum("slots").alias("size"))
        # At most FAN_OUT children a node.
        nodes = below.groupBy(F.floor(F.col("child") / FAN_OUT).alias("node")).agg(F.sort_array(F.collect_list(F.struct("child", "size"))).alias("c"))
        nodes = nodes.select("node", F.col("c.child").alias("children"), F.col("c.size").alias("sizes"))
        rows = draws.join(nodes, "node").select(F.lit(level).alias("level"), "shard", "node", "n", "children", "sizes")
        draws = rows.mapInPandas(split, "shard long, node long, n long")
    return draws.select("shard", F.col("node").alias("src"), "n")


def _units(df: DataFrame, first: Column, n: Column, name: str, *columns: Column | str) -> DataFrame:
    """A row for each number first .. first+n-1."""
    return df.where(n > 0).select(*columns, F.explode(F.sequence(first, first + n - 1)).alias(name))


def mix(sized: DataFrame, block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS, seed: int = SEED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sources, placed documents and slots of the mix of ``sized`` (row columns, source, size).

    Placed documents have src and ``at``, their first word in the source. A slot (shard, src, epoch,
    block, n) is the first n words of a block.
    """
    size, quota, block = F.col("source_size"), F.col("quota"), F.lit(block_words)
    words = [F.greatest(F.least(size, quota - size * e), F.lit(0)) for e in range(MAX_EPOCHS)]
    per_epoch = [F.ceil(w / block).cast("long") for w in words]
    # A full epoch has a slot per block; the remainder is a block of its own.
    sources = written(
        targets(sized).withColumn("quota", F.floor(F.col("target") + 0.5)).withColumn("slots", sum(per_epoch[1:], per_epoch[0])).withColumn("first_epoch", per_epoch[0]),
        "targets",
    )
    own = sources.select("src", F.col("source").alias("__source"))
    rows = sized.join(own, sized["source"].eqNullSafe(own["__source"])).drop("__source")
    rows = written(rows, "sized")
    placed = running(rows, ["src"], ["doc_id", "th"], "size", "at", buckets_for(rows.count()))

    draws = written(_draws(sources, shard_blocks, seed), "draws")
    numbered = running(draws, ["src"], ["shard"], "n", "first", buckets_for(draws.count()))
    limits = sources.select("src", "slots")
    numbered = numbered.join(limits, "src").withColumn("good", F.greatest(F.least("n", F.col("slots") - F.col("first")), F.lit(0)))
    numbered = written(numbered, "numbered")
    good = _units(numbered, F.col("first"), F.col("good"), "slot", "shard", "src")
    vacant = numbered.where("n > good").select("shard", "src", (F.col("n") - F.col("good")).alias("n"))
    vacant = _units(running(vacant, [], ["shard", "src"], "n", "first", buckets_for(vacant.count())), F.col("first"), F.col("n"), "number", "shard")
    drawn = numbered.groupBy("src").agg(F.sum("n").alias("drawn"))
    short = sources.join(drawn, "src", "left").select("src", F.coalesce("drawn", F.lit(0)).alias("drawn"), (F.col("slots") - F.coalesce("drawn", F.lit(0))).alias("n")).where("n > 0")
    short = _units(running(short, [], ["src"], "n", "first", buckets_for(short.count())), F.col("first"), F.col("n"), "number", "src", "drawn", F.col("first").alias("base"))
    filled = vacant.join(short, "number").select("shard", "src", (F.col("drawn") + F.col("number") - F.col("base")).alias("slot"))

    @F.pandas_udf("long")
    def block_of(k: pd.Series, blocks: pd.Series, src: pd.Series, epoch: pd.Series) -> pd.Series:
        keys = scramble(src.to_numpy().astype(np.uint64) * np.uint64(2 * MAX_EPOCHS) + epoch.to_numpy().astype(np.uint64) + np.uint64(seed))
        k, blocks = k.to_numpy(), blocks.to_numpy()
        out = blocks.copy()  # the remainder
        inside = k < blocks
        out[inside] = permute(k[inside], blocks[inside], keys[inside])
        return pd.Series(out)

    slots = good.unionByName(filled).join(sources.select("src", "source_size", "quota", "first_epoch"), "src")
    epoch = F.when(F.col("slot") < F.col("first_epoch"), 0).otherwise(1)
    k = F.col("slot") - F.when(epoch == 0, F.lit(0)).otherwise(F.col("first_epoch"))
    slots = slots.select("shard", "src", epoch.alias("epoch"), k.alias("k"), F.floor(size / block).alias("blocks"), F.when(epoch == 0, words[0]).otherwise(words[1]).alias("words"))
    slots = slots.select("shard", "src", "epoch", block_of("k", "blocks", "src", "epoch").alias("block"), F.least(block, F.col("words") - F.col("k") * block).alias("n"))
    return sources, written(placed, "placed"), slots


def _taken_spans(placed: DataFrame, slots: DataFrame, block_words: int) -> DataFrame:
    """(src, at, epoch, lo, hi): the words of a document, counted from its first, that a slot takes."""
    block = F.lit(block_words)
    last = F.floor((F.col("at") + F.col("size") - 1) / block)
    pieces = placed.where("size > 0").select("src", "at", "size", F.explode(F.sequence(F.floor(F.col("at") / block), last)).alias("block"))
    start = F.col("block") * block
    lo, hi = F.greatest(start, F.col("at")), F.least(start + F.col("n"), F.col("at") + F.col("size"))
    joined = pieces.join(slots, ["src", "block"]).where(hi > lo)
    return joined.select("src", "at", "epoch", (lo - F.col("at")).alias("lo"), (hi - F.col("at")).alias("hi"))


def _sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), "source", n_words(F.col("text")).alias("size"))


def mix_report(docs: DataFrame, block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS, seed: int = SEED) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken."""
    sources, placed, slots = mix(written(_sized(docs), "sizes"), block_words, shard_blocks, seed)
    taken = _taken_spans(placed, slots, block_words).groupBy("src", "at").agg(F.sum(F.col("hi") - F.col("lo")).alias("taken"))
    # Words lie at places of their own, so (src, at) names a document that has any.
    rows = placed.withColumn("__at", F.when(F.col("size") > 0, F.col("at")))
    joined = rows.join(taken.withColumnRenamed("at", "__at"), ["src", "__at"], "left").join(sources.select("src", "source_size", "target"), "src")
    return joined.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


_WORDS = re.compile(WORD)


def _cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The spans of words of a text, white space inside them unchanged; all words give the text itself."""
    merged: list[list[int]] = []
    for lo, hi in sorted(spans):
        if merged and merged[-1][1] == lo:
            merged[-1][1] = hi
        else:
            merged.append([lo, hi])
    at = [match.span() for match in _WORDS.finditer(text)]
    if merged == [[0, len(at)]]:
        return text
    return "\n".join(text[at[lo][0] : at[hi - 1][1]] for lo, hi in merged)


def mixed_documents(docs: DataFrame, block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS, seed: int = SEED) -> DataFrame:
    """The mixed corpus with the columns of ``docs``: a row for each epoch that takes words of a document.

    Its text is what that epoch takes, and n_chars follows.
    """
    _, placed, slots = mix(written(_sized(docs), "sizes"), block_words, shard_blocks, seed)
    spans = _taken_spans(placed, slots, block_words).groupBy("src", "at", "epoch").agg(F.collect_list(F.struct("lo", "hi")).alias("__spans"))
    named = placed.where("size > 0").select("src", "at", F.col("doc_id").alias("__d"), F.col("th").alias("__t"), F.col("source").alias("__s"))
    own = spans.join(named, ["src", "at"]).select("__d", "__t", "__s", "__spans")
    names = docs.columns
    others = [name for name in names if name != "text"]
    # The caller's columns travel in one struct, so that none of their names can clash, and the text once beside it.
    texts = docs.select(F.struct(*others).alias("__row"), F.col("text").alias("__text"), "doc_id", "source", F.xxhash64(F.coalesce("text", F.lit(""))).alias("__th"))
    texts = texts.dropDuplicates(["doc_id", "source", "__th"])
    joined = texts.join(own, texts["doc_id"].eqNullSafe(own["__d"]) & (texts["__th"] == own["__t"]) & texts["source"].eqNullSafe(own["__s"]))
    joined = joined.select("__row", "__spans", F.col("__text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            lists = batch.column("__spans").to_pylist()
            texts = [_cut(text.decode("utf-8", "replace"), [(s["lo"], s["hi"]) for s in spans]) for text, spans in zip(texts_of(batch.column("text")), lists)]
            own = {"text": pa.array(texts, pa.string())}
            if "n_chars" in names:
                own["n_chars"] = pa.array(list(map(len, texts)), pa.int64())
            fields = {**dict(zip(others, batch.column("__row").flatten())), "text": batch.column("text")}
            yield pa.RecordBatch.from_arrays([own[name].cast(field.type) if name in own else field for name, field in ((name, fields[name]) for name in names)], names)

    return joined.mapInArrow(run, docs.schema)
