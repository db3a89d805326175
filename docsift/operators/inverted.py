"""Inverted lists of texts, made where the texts are: words are counted in the row, lists in the Arrow batch."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.functions.text import TOKEN


class _Numbered(dict):
    """Words of one block to their places in the list of all."""

    def __init__(self, block, words: list[str], blocks: list):
        self.block, self.words, self.blocks = block, words, blocks

    def __missing__(self, word: str) -> int:
        at = self[word] = len(self.words)
        self.words.append(word)
        self.blocks.append(self.block)
        return at


def _lists(batch: pa.RecordBatch) -> pa.RecordBatch | None:
    own: dict = {}
    words: list[str] = []
    blocks: list = []
    ids: list[int] = []
    tfs: list[int] = []
    held, lengths = [], []
    for block, text in zip(batch["block"].to_pylist(), batch["text"].to_pylist()):
        counts = Counter(re.findall(TOKEN, text))
        if block not in own:
            own[block] = _Numbered(block, words, blocks)
        ids.extend(map(own[block].__getitem__, counts))
        tfs.extend(counts.values())
        held.append(len(counts))
        lengths.append(counts.total())
    if not ids:
        return None
    word, place, tf = np.array(ids), np.repeat(np.arange(len(held)), held), np.array(tfs, np.int32)
    order = np.argsort(word, kind="stable")
    place, tf = place[order], tf[order]
    dl, n = np.array(lengths, np.int32)[place], np.bincount(word)
    ends = np.concatenate([[0], np.cumsum(n)])
    each = lambda values: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
    columns = {
        "term": pa.array(words, pa.string()),
        "block": pa.array(blocks, pa.int64()),
        "n": pa.array(n, pa.int32()),
        "total": pa.array(np.add.reduceat(tf, ends[:-1], dtype=np.int64)),
        "most": pa.array(np.maximum.reduceat(tf, ends[:-1])),
        "least": pa.array(np.minimum.reduceat(dl, ends[:-1])),
        "keys": each(batch["key"].take(pa.array(place))),
        "tfs": each(pa.array(tf)),
        "dls": each(pa.array(dl)),
    }
    return pa.RecordBatch.from_pydict(columns)


def lists(rows: DataFrame, key_type: str) -> DataFrame:
    """term, block, n, total (occurrences), most, least, keys, tfs, dls for each word of a block in a batch of rows (block, key, text).

    Lists have the order of the rows.  A block whose rows come in two batches has two lists of a word.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = _lists(b)
            if found is not None:
                yield found

    low = rows.select(F.col("block").cast("long"), "key", F.lower(F.coalesce(F.col("text"), F.lit(""))).alias("text"))
    return low.mapInArrow(made, f"term string, block long, n int, total long, most int, least int, keys array<{key_type}>, tfs array<int>, dls array<int>")
