"""Jump consistent hashing: stable keys to shards without a ring table.

Adding a shard moves only the rows that go into it.  Defined results: a null key
is a key like any other; repeated rows share a shard; an empty table gives no
rows; other columns are carried along untouched.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.llm._spark import numbered, staged

#: Parts that a shard is numbered by, whatever the session; fixed, so that slots are the same everywhere.
BUCKETS = 1024

_STEP = np.uint64(2862933555777941757)


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key, for all keys at once."""
    key = keys.astype(np.int64).view(np.uint64).copy()
    shard = np.zeros(len(key), np.int64)
    ahead = np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    while len(live):
        shard[live] = ahead[live]
        key[live] = key[live] * _STEP + np.uint64(1)
        ahead[live] = ((shard[live] + 1) * (float(1 << 31) / ((key[live] >> np.uint64(33)) + np.uint64(1)).astype(np.float64))).astype(np.int64)
        live = live[ahead[live] < shards]
    return shard


def shard_of(key: F.Column, shards: int) -> F.Column:
    """A column with the shard of a long key."""

    @F.pandas_udf("int")
    def assign(k: pd.Series) -> pd.Series:
        return pd.Series(jump(k.to_numpy(np.int64), shards).astype(np.int32))

    return assign(key)


def assign_shards(df: DataFrame, keys: list[str], shards: int) -> DataFrame:
    """``df`` with its shard, and its shard if there were one more."""
    key = F.xxhash64(*keys)
    return df.withColumns({"shard": shard_of(key, shards), "grown_shard": shard_of(key, shards + 1)})


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row.

    Size is the UTF-8 bytes of the text plus one.  Slots count up from 0 in each shard.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    narrow = docs.select(F.col("doc_id").cast("long"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"))
    placed = staged(assign_shards(narrow, ["doc_id"], shards), "shards")
    out = numbered(placed, ["shard"], ["doc_id", "text_crc32", "size"], ["doc_id", "text_crc32", "size"], BUCKETS, "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
