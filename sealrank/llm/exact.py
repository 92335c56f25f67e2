"""Exact deduplication through an extendible-hash index in shared files.

1. Every row becomes (key, doc_id, digest, length): the key is a 64-bit hash of the text. These rows are
   written; texts stay where they are.
2. The directory maps slots, the leading bits of a key, to buckets. It starts at the depth at which
   buckets could fit and is doubled while a bucket holds more than ``bucket_rows`` keys; a bucket that
   fits keeps its depth and is shared by all slots below it.
3. Keys are inserted into their buckets. A key of one row is an entry as it is. The texts of a key with
   several rows follow it into the bucket and are compared there, byte by byte: each different text is a
   link of the key's chain, with its surviving row and its number of rows. A task that reads copies sends
   their text once, so a text on a third of all rows is no hot group.
4. Buckets are written in ranges, one range of keys to each owner task. Every row then looks up its
   bucket, its key and, in a chain, its link.

A text whose key no other row has is never shuffled while the shared keys are few enough to be broadcast
(Spark decides); beyond, texts move once to be told apart. Only DataFrame operations are used.

Defined cases: null text equals empty text; the row with the largest doc_id stays; rows that
repeat id and text are one document and share its fate; a null doc_id never wins against another
id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sealrank.llm.tables import lower_ascii
from sealrank.session import materialize

# Keys an index bucket may hold before the directory is doubled for it.
BUCKET_ROWS = 50_000


def _key(body: Column) -> Column:
    return F.xxhash64(body)


def _bodies(docs: DataFrame) -> DataFrame:
    body = lower_ascii(F.coalesce("text", F.lit("")))
    return docs.select("doc_id", body.alias("body")).withColumn("key", _key(F.col("body")))


def _digest(body: Column) -> Column:
    return F.unhex(F.sha2(body, 256))


def _slot(key: Column, depth: int) -> Column:
    """The leading ``depth`` bits of the key, at most 63. In two shifts, since a shift by 64 is none."""
    return F.shiftrightunsigned(F.shiftrightunsigned(key, 63 - depth), 1)


def _fullest(entries: DataFrame, depth: int) -> int:
    """Entries of the fullest slot."""
    return entries.groupBy(_slot(F.col("key"), depth)).count().agg(F.max("count")).first()[0] or 0


def build_directory(entries: DataFrame, bucket_rows: int = BUCKET_ROWS) -> tuple[DataFrame, int]:
    """(slot, local_depth, bucket) of every used slot, and the directory's depth. ``entries`` has different keys.

    Doubling ends at 40 bits, or earlier when no bucket is overfull; keys are mixed 64-bit
    hashes, so a bucket that still overflows then is only a larger one.
    """
    # A directory of fewer slots than full buckets has an overfull one, so it is doubled past those unseen.
    entries_found = entries.count()
    depth = min(40, (-(-entries_found // bucket_rows) - 1).bit_length()) if entries_found else 0
    while depth < 40 and _fullest(entries, depth) > bucket_rows:
        depth += 1
    slots = entries.groupBy(_slot(F.col("key"), depth).alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    # A slot's bucket is its shortest prefix that is not overfull.
    above = slots.select("slot", "n", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("local_depth"))
    above = above.withColumn("prefix", F.expr(f"shiftrightunsigned(slot, {depth} - local_depth)"))
    held = above.withColumn("held", F.sum("n").over(Window.partitionBy("local_depth", "prefix")))
    fits = held.where((F.col("held") <= bucket_rows) | (F.col("local_depth") == depth))
    found = fits.groupBy("slot").agg(F.min(F.struct("local_depth", "prefix")).alias("b"))
    bucket = F.expr(f"shiftleft(b.prefix, {depth} - b.local_depth)")
    return found.select("slot", F.col("b.local_depth").alias("local_depth"), bucket.alias("bucket")), depth


def _in_buckets(rows: DataFrame, directory: DataFrame, depth: int) -> DataFrame:
    """``rows`` with the bucket that the directory names for their key."""
    slots = directory.select(F.col("slot").alias("__slot"), "bucket")
    return rows.join(slots, _slot(F.col("key"), depth) == F.col("__slot")).drop("__slot")


def build_index(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """The rows (doc_id, key, digest, n_bytes), the index in shared files, its directory and the directory's depth.

    An index entry is (bucket, key, chain, digest, n_bytes, keep_id, group_size); the digest and length of a key
    with one row are null, since nothing is to be told apart.
    """
    rows = materialize(_bodies(docs).select("doc_id", "key", _digest(F.col("body")).alias("digest"), F.octet_length("body").alias("n_bytes")), "exact-rows")
    keys = materialize(rows.groupBy("key").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n")), "exact-keys")
    directory, depth = build_directory(keys, bucket_rows)
    directory = materialize(directory, "exact-directory")
    owned = _in_buckets(keys, directory, depth)
    single = owned.where("n = 1").select(
        "bucket", "key", F.lit(1).alias("chain"), F.lit(None).cast("binary").alias("digest"), F.lit(None).cast("int").alias("n_bytes"),
        "keep_id", F.col("n").alias("group_size"),
    )
    # Written, so that Spark knows its size when it chooses whether texts have to move to it.
    shared = materialize(owned.where("n > 1").select("bucket", "key"), "exact-shared")
    texts = _bodies(docs).join(shared, "key")
    links = texts.groupBy("bucket", "key", "body").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    links = links.select("bucket", "key", _digest(F.col("body")).alias("digest"), F.octet_length("body").alias("n_bytes"), "keep_id", "group_size")
    chain = F.row_number().over(Window.partitionBy("bucket", "key").orderBy("digest", "n_bytes"))
    entries = single.unionByName(links.withColumn("chain", chain))
    index = entries.repartitionByRange("bucket", "key").sortWithinPartitions("bucket", "key")
    return rows, materialize(index, "exact-index"), directory, depth


def dedup_exact(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Per document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows, index, directory, depth = build_index(docs, bucket_rows)
    link = index.select(
        F.col("bucket").alias("__b"), F.col("key").alias("__k"), F.col("digest").alias("__digest"), F.col("n_bytes").alias("__n"), "keep_id", "group_size"
    )
    same = F.col("__digest").isNull() | ((F.col("__digest") == F.col("digest")) & (F.col("__n") == F.col("n_bytes")))
    found = _in_buckets(rows, directory, depth).join(link, (F.col("bucket") == F.col("__b")) & (F.col("key") == F.col("__k")) & same)
    return found.select(
        "doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )


ORACLE_SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents
)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY body) AS keep_id,
       count(*) OVER (PARTITION BY body) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY body) AS kept,
       sha256(body) AS text_sha256
FROM d
"""
