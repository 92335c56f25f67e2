"""Text embedding in Arrow batches with the caller's model, and an offline default."""

from __future__ import annotations

import functools
import hashlib
import string
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sealrank.functions import arrow
from sealrank.functions.vectors import bind, normalize
from sealrank.session import materialize

Model = Callable[[list[str]], np.ndarray]

# A-Z as a-z, and every byte but these and 0-9 as a blank; bytes of longer UTF-8 characters are among them.
_TOKEN_BYTES = bytes(ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else 32 for b in range(256))
# Text that goes to a model at once, and tokens whose buckets the hashed model keeps: what a task holds does not grow with the corpus.
BATCH_BYTES = 4 << 20
KEPT_TOKENS = 1 << 16
# Rows of one text that meet its vector in one group, and a bound of the texts with more.
PART_ROWS = 10_000
HOT_TEXTS = 100_000


def deal_out(df: DataFrame) -> DataFrame:
    """At least two parts per core: rows in fewer parts are dealt out evenly, whatever their
    keys; more parts stay as they are. For tables read from files."""
    wanted = 2 * df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= wanted else df.repartition(wanted)


def embed(
    df: DataFrame, text: str, make_model: Callable[[], Model], batch_texts: int = 256, spread: bool = False
) -> DataFrame:
    """``df`` with ``embedding`` and ``embed_time``, the seconds a text took.

    ``make_model`` runs once per task and returns a function from texts to an
    ``(n, width)`` array. Rows stay in their task and nothing is shuffled, unless
    ``spread`` deals them out evenly over all tasks first: worth it where the input comes
    in few or uneven splits, as embedding costs far more than moving a text.
    """
    if spread:
        df = deal_out(df)
    schema = T.StructType(list(df.schema)).add("embedding", T.ArrayType(T.DoubleType())).add("embed_time", T.DoubleType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for whole in batches:
            ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(whole.column(text)), 0), np.int64))
            at = 0
            while at < whole.num_rows:
                fits = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BATCH_BYTES, "right")) - at
                batch = whole.slice(at, max(1, min(batch_texts, fits)))
                at += batch.num_rows
                model = model or make_model()
                start = time.perf_counter()
                vectors = np.asarray(model([t or "" for t in batch.column(text).to_pylist()]), dtype=float)
                each = (time.perf_counter() - start) / batch.num_rows
                yield arrow.replace_columns(
                    batch, (),
                    embedding=arrow.list_column(vectors),
                    embed_time=pa.array(np.full(batch.num_rows, each)),
                )

    return df.mapInArrow(run, schema)


def embed_distinct(
    df: DataFrame, text: str, make_model: Callable[[], Model], batch_texts: int = 256, part_rows: int = PART_ROWS
) -> DataFrame:
    """``embed`` with one call of the model per distinct text, however many rows hold it; null counts as empty.

    Texts are told apart by their SHA-256, by an aggregate that combines copies before it moves them. The vectors meet
    the rows by hash; a text with more than ``part_rows`` rows, and a share of one in ``HOT_TEXTS`` or more, meets them in
    several parts, so that a text of a third of all rows does not end in one task. ``embed_time`` of a text is shared
    among its rows. ``df`` is read twice: write it first where that costs much.
    """
    key, own = "__text_key", F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    texts = df.groupBy(own.alias(key)).agg(F.any_value(F.coalesce(F.col(text), F.lit(""))).alias("__text"), F.count("*").alias("__rows"))
    vectors = materialize(embed(deal_out(materialize(texts, "texts")), "__text", make_model, batch_texts).drop("__text"), "vectors")
    n_rows = vectors.agg(F.sum("__rows")).first()[0] or 0
    most = max(part_rows, -(-n_rows // HOT_TEXTS))
    parts = F.ceil(F.col("__rows") / F.lit(most)).cast("int")
    # Fewer than HOT_TEXTS texts can have that many rows each.
    hot = F.broadcast(vectors.filter(F.col("__rows") > most).select(F.col(key).alias("__hot"), parts.alias("__parts")))
    placed = df.withColumn(key, own).join(hot, F.col(key) == F.col("__hot"), "left")
    place = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.coalesce("__parts", F.lit(1))).cast("int")
    placed = placed.withColumn("__part", place).drop("__hot", "__parts")
    dealt = vectors.withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).withColumn("embed_time", F.col("embed_time") / F.col("__rows"))
    return placed.join(dealt.drop("__rows"), [key, "__part"]).select(*df.columns, "embedding", "embed_time")


def token_counts(text: Column, width: int = 64) -> Column:
    """Counts of the alphanumeric tokens (A-Z folded, no other letters) of a text in ``width`` hash buckets.

    The whole text is counted inside its own row, so long texts cost time but no shuffle.
    """
    def bucket(token: Column) -> Column:
        return F.conv(F.substring(F.md5(token.cast("binary")), 1, 8), 16, 10).cast("bigint") % width

    tokens = F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase), "[^a-z0-9]+"), lambda t: t != "")
    places = F.sequence(F.lit(0).cast("bigint"), F.lit(width - 1).cast("bigint"))
    return bind(
        F.transform(tokens, bucket),
        lambda hit: F.transform(
            places, lambda b: (F.size(hit) - F.size(F.array_remove(hit, b))).cast("double")
        ),
    )


def hashed_embedding(text: Column, width: int = 64) -> Column:
    """Unit vector of token counts: repeatable and model-free, not semantic."""
    return bind(token_counts(text, width), normalize)


def hashed_model(width: int = 64) -> Callable[[], Model]:
    """The same vectors as a model for ``embed``.

    A batch is split at once and each distinct token hashed once, which takes a fraction of
    the time of the expression form on long texts.
    """
    def make() -> Model:
        @functools.lru_cache(maxsize=KEPT_TOKENS)
        def bucket(token: str) -> int:
            return int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % width if token else -1

        def model(texts: list[str]) -> np.ndarray:
            low = pa.array(texts, pa.string())
            body = pa.py_buffer(bytes(low.buffers()[2] or b"").translate(_TOKEN_BYTES))
            blanked = pa.Array.from_buffers(low.type, len(low), [None, low.buffers()[1], body], offset=low.offset)
            split = pc.ascii_split_whitespace(blanked)
            rows = np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy())
            words = split.flatten().dictionary_encode()
            place = np.array([bucket(w) for w in words.dictionary.to_pylist()], dtype=np.int64)
            hit = place[words.indices.to_numpy()]
            cells = (rows * width + hit)[hit >= 0]
            counts = np.bincount(cells, minlength=len(texts) * width).reshape(len(texts), width)
            return arrow.unit_rows(counts.astype(float))

        return model

    return make


def embed_hashed(df: DataFrame, text: str, width: int = 64, spread: bool = False) -> DataFrame:
    return embed(df, text, hashed_model(width), batch_texts=4096, spread=spread)
