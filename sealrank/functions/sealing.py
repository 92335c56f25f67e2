"""Authenticated column encryption with the key kept out of every plan.

The key is a one-row table read through a scalar subquery, so plans, the UI and event
logs show only where it is stored. Each value is sealed with AES-GCM under a random
nonce, with the row's blind index as associated data: a value moved to another row no
longer opens.

Sealing draws a fresh nonce per evaluation: write a sealed frame before using it twice,
and never join or group by a sealed column; ``blind_index`` is there for that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def save_key(spark: SparkSession, key: bytes, path: str) -> str:
    """Store a 16, 24 or 32 byte key as a one-row table and return its path."""
    if len(key) not in (16, 24, 32):
        raise ValueError("an AES key has 16, 24 or 32 bytes")
    spark.createDataFrame([(bytearray(key),)], "content BINARY").coalesce(1).write.parquet(path)
    return path


def load_key(spark: SparkSession, path: str) -> DataFrame:
    """The key table; a raw key file is read as it is."""
    if path.endswith(".key"):
        return spark.read.format("binaryFile").load(path).select("content")
    return spark.read.schema("content BINARY").parquet(path)


def _key(key: DataFrame) -> Column:
    return key.select("content").scalar()


def blind_index(doc_id: Column, key: DataFrame) -> Column:
    """A keyed, repeatable hash of the id, for joins and for latest-row-wins."""
    inner = F.unhex(F.sha2(F.concat(_key(key), doc_id.cast("string").cast("binary")), 256))
    return F.sha2(F.concat(_key(key), inner), 256)


def seal(value: Column, key: DataFrame | None, doc_key: Column) -> Column:
    """Seal a text or binary column; without a key the bytes stay plain."""
    raw = value.cast("binary")
    if key is None:
        return raw
    return F.aes_encrypt(raw, _key(key), F.lit("GCM"), F.lit("DEFAULT"), F.lit("").cast("binary"), F.unhex(doc_key))


def unseal(value: Column, key: DataFrame | None, doc_key: Column) -> Column:
    """Open to bytes; a wrong key, moved or altered value fails the job."""
    if key is None:
        return value
    return F.aes_decrypt(value, _key(key), F.lit("GCM"), F.lit("DEFAULT"), F.unhex(doc_key))


def open_text(value: Column, key: DataFrame | None, doc_key: Column, lenient: bool = False) -> Column:
    """Open to text. Lenient: what does not open is kept, as text where it is valid
    UTF-8 and in base64 otherwise."""
    if not lenient:
        return unseal(value, key, doc_key).cast("string")
    kept = F.coalesce(
        F.try_validate_utf8(value.cast("string")),
        F.regexp_replace(F.base64(value), "[\r\n]", ""),
    )
    if key is None:
        return kept
    opened = F.try_aes_decrypt(value, _key(key), F.lit("GCM"), F.lit("DEFAULT"), F.unhex(doc_key))
    return F.coalesce(opened.cast("string"), kept)
