"""Bloom filters of what a store holds, so that only possible repeats meet its rows.

A filter is cut into shards of ``SHARD_BITS``, one row each, built where its shard's
hashes are.  A filter never misses what it holds; what it lets through by mistake
(about 3 in 1,000) is settled by the join after it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARD_BITS, BITS_EACH, PROBES = 1 << 18, 12, 8
#: Bytes of filters that may be broadcast; a larger store is joined without them.
MOST_BYTES = 64 << 20
#: Keys that may be broadcast.
KEYS = 2_000_000


def _places(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bit places of entries in their shards, one row for each."""
    step = b.astype(np.uint64) | np.uint64(1)
    i = np.arange(PROBES, dtype=np.uint64)
    return ((a.astype(np.uint64)[:, None] >> np.uint64(20)) + i * step[:, None]) & np.uint64(SHARD_BITS - 1)


def _hashed(values: DataFrame, column: str) -> DataFrame:
    return values.select(F.xxhash64(column).alias("a"), F.xxhash64(F.lit("second"), F.col(column)).alias("b"))


def shards_for(n: int) -> int:
    """A power of two, so that shards hold ``BITS_EACH`` bits or more for each entry."""
    return 1 << max(0, (max(n, 1) * BITS_EACH - 1) // SHARD_BITS).bit_length()


def filter_of(values: DataFrame, column: str, n: int) -> DataFrame:
    """shard, shards, bits: a filter of about ``n`` distinct values."""
    shards = shards_for(n)

    def make(rows: pd.DataFrame) -> pd.DataFrame:
        on = np.zeros(SHARD_BITS, bool)
        on[_places(rows["a"].to_numpy(np.int64), rows["b"].to_numpy(np.int64)).ravel()] = True
        return pd.DataFrame({"shard": rows["shard"].iloc[:1].to_numpy(), "shards": [shards], "bits": [np.packbits(on).tobytes()]})

    dealt = _hashed(values.where(F.col(column).isNotNull()), column).distinct().withColumn("shard", F.pmod("a", F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").applyInPandas(make, "shard int, shards int, bits binary")


def possible(values: DataFrame, column: str, filters: DataFrame) -> DataFrame | None:
    """Those of the rows whose value some filter may hold; None where the filters are too large to be broadcast."""
    if (filters.agg(F.sum(F.length("bits"))).first()[0] or 0) > MOST_BYTES:
        return None
    tables: dict[int, dict[int, np.ndarray]] = {}
    # no more than MOST_BYTES; filters of one number of shards are merged
    for r in filters.collect():
        bits = np.frombuffer(r["bits"], np.uint8)
        own = tables.setdefault(r["shards"], {})
        own[r["shard"]] = own[r["shard"]] | bits if r["shard"] in own else bits
    held = values.sparkSession.sparkContext.broadcast(tables)

    @F.pandas_udf("boolean")
    def among(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in parts:
            a, b = a.to_numpy(np.int64), b.to_numpy(np.int64)
            found = np.zeros(len(a), bool)
            places = _places(a, b)
            for shards, own in held.value.items():
                shard = a % shards
                for s in np.unique(shard):
                    if s in own:
                        at = np.flatnonzero(shard == s)
                        p = places[at]
                        found[at] |= ((own[s][p >> np.uint64(3)] >> (np.uint64(7) - (p & np.uint64(7))).astype(np.uint8)) & 1).all(axis=1)
            yield pd.Series(found)

    a, b = F.xxhash64(column), F.xxhash64(F.lit("second"), F.col(column))
    return values.where(F.col(column).isNotNull() & among(a, b))


def known_among(values: DataFrame, column: str, known: DataFrame, filters: DataFrame | None) -> DataFrame:
    """Those of the ``known`` values that can be among ``values``: the filters are asked first, so no other leaves its task."""
    maybe = None if filters is None else possible(values.select(column), column, filters)
    if maybe is None:
        return known
    return known.join(maybe.distinct(), column, "left_semi")


def with_key_of(rows: DataFrame, key: str, others: DataFrame) -> DataFrame:
    """Those of the rows whose key is among ``others``; of these only keys travel, so a join of the two shuffles no row in vain.

    Where there are more than KEYS of them, all rows, for the join to settle.
    """
    keys = others.select(key).distinct()
    return rows.join(F.broadcast(keys), key, "left_semi") if keys.count() <= KEYS else rows
