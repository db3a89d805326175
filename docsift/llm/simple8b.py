"""Simple-8b token files.

A 64-bit word is a 4-bit selector and 60 bits of payload: the selector tells how
many values of how many bits each it packs.  Values of more than 60 bits are
escapes: the stream holds 0 in their place, and the block lists place and value
aside, so decoding stays vectorised.  A block holds whole documents: their ids
and lengths, the words, and the index of the first value of every 128th word, so
that readers can start inside it.  Blocks are rows of Parquet files written by
Spark, whose commit protocol takes care of lost tasks.

Defined results: a null text is empty and has the end id alone; null and repeated
ids keep their rows, nulls first, those of one id in the order of a hash of their
texts; very long texts are documents like others, in blocks of their own; extra
columns, whatever their names, play no part; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docsift.llm._spark import partitions, small_or_shuffled
from docsift.llm.tokens import encode, vocabulary

#: Fixed values of the format: selector to (values, bits of each).
PACKS = {1: (60, 1), 2: (30, 2), 3: (20, 3), 4: (15, 4), 5: (12, 5), 6: (10, 6), 7: (8, 7), 8: (7, 8), 9: (6, 10), 10: (5, 12), 11: (4, 15), 12: (3, 20), 13: (2, 30), 14: (1, 60)}
MAGIC, FRAME = b"S8B1", 128
BLOCK_IDS = 1 << 17


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, and place and value of each escape, for unsigned 64-bit values."""
    values = values.astype(np.uint64)
    places = np.flatnonzero(values >> np.uint64(60))
    escaped = values[places]
    n = len(values)
    padded = np.zeros(n + 60, np.uint64)
    padded[:n] = values
    padded[places] = 0
    # the largest value from each place on, over windows that grow from pack to pack
    best = np.full(n, 14, np.int64)
    reach, window = 1, padded.copy()
    for selector in range(13, 0, -1):
        count, bits = PACKS[selector]
        while reach < count:
            step = min(reach, count - reach)
            window[: len(window) - step] = np.maximum(window[: len(window) - step], window[step:])
            reach += step
        fits = window[:n] < np.uint64(1 << bits)
        if not fits.any():
            break  # longer windows hold no smaller values, in fewer bits
        best[fits] = selector
    counts = np.array([0] + [PACKS[s][0] for s in range(1, 15)])[best].tolist()
    starts, at = [], 0
    while at < n:
        starts.append(at)
        at += counts[at]
    starts = np.array(starts, np.int64)
    selectors = best[starts] if n else np.empty(0, np.int64)
    words = selectors.astype(np.uint64) << np.uint64(60)
    for selector in np.unique(selectors):
        count, bits = PACKS[int(selector)]
        at = np.flatnonzero(selectors == selector)
        for i in range(count):
            words[at] |= padded[starts[at] + i] << np.uint64(i * bits)
    return words, places, escaped


def unpack(words: np.ndarray, n: int, places: np.ndarray, escaped: np.ndarray) -> np.ndarray:
    """The n values, a selector at a time."""
    selectors = (words >> np.uint64(60)).astype(np.int64)
    counts = np.array([0] + [PACKS[s][0] for s in range(1, 15)])[selectors]
    starts = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()) if len(counts) else 0, np.uint64)
    for selector in np.unique(selectors):
        count, bits = PACKS[int(selector)]
        at = np.flatnonzero(selectors == selector)
        for i in range(count):
            out[starts[at] + i] = (words[at] >> np.uint64(i * bits)) & np.uint64((1 << bits) - 1)
    out = out[:n].copy()
    out[places] = escaped
    return out


def write_block(doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    """One block of whole documents."""
    values = np.concatenate(ids) if ids else np.empty(0, np.uint64)
    words, places, escaped = pack(values)
    counts = np.array([0] + [PACKS[s][0] for s in range(1, 15)])[(words >> np.uint64(60)).astype(np.int64)]
    frames = (np.cumsum(counts) - counts)[::FRAME]
    head = np.array([len(doc_ids), len(values), len(words), len(places), len(frames)], "<u8")
    known = np.array([x is not None for x in doc_ids], np.uint8)
    parts = (head, known, np.array([x or 0 for x in doc_ids], "<i8"), np.array([len(x) for x in ids], "<u8"), frames.astype("<u8"), words.astype("<u8"), places.astype("<u8"), escaped.astype("<u8"))
    return MAGIC + b"".join(x.tobytes() for x in parts)


class Block:
    """A block as written: documents and lengths at once, values as they are asked for."""

    def __init__(self, block: bytes):
        if block[:4] != MAGIC:
            raise ValueError("not a Simple-8b block")
        docs, self.n, n_words, n_escapes, n_frames = (int(x) for x in np.frombuffer(block, "<u8", 5, 4))
        at = 44
        known = np.frombuffer(block, np.uint8, docs, at)
        at += docs
        self.doc_ids = [int(d) if k else None for d, k in zip(np.frombuffer(block, "<i8", docs, at), known)]
        self.ends = np.cumsum(np.frombuffer(block, "<u8", docs, at + 8 * docs).astype(np.int64))
        at += 16 * docs
        self.frames = np.frombuffer(block, "<u8", n_frames, at).astype(np.int64)
        at += 8 * n_frames
        self.words = np.frombuffer(block, "<u8", n_words, at)
        self.places = np.frombuffer(block, "<u8", n_escapes, at + 8 * n_words).astype(np.int64)
        self.escaped = np.frombuffer(block, "<u8", n_escapes, at + 8 * (n_words + n_escapes))

    def values(self, start: int, stop: int) -> np.ndarray:
        """Values ``start`` to ``stop``, from the frame that holds the first to the one that holds the last."""
        if start >= stop:
            return np.empty(0, np.uint64)
        first = int(np.searchsorted(self.frames, start, side="right")) - 1
        last = int(np.searchsorted(self.frames, stop, side="left"))
        at = int(self.frames[first])
        end = int(self.frames[last]) if last < len(self.frames) else self.n
        inside = slice(*np.searchsorted(self.places, [at, end]))
        return unpack(self.words[first * FRAME : last * FRAME], end - at, self.places[inside] - at, self.escaped[inside])[start - at : stop - at]

    def document(self, i: int) -> np.ndarray:
        """The ids of the i-th document alone."""
        return self.values(int(self.ends[i - 1]) if i else 0, int(self.ends[i]))


def read_block(block: bytes) -> tuple[list[int | None], list[np.ndarray]]:
    """Document ids and their token ids."""
    b = Block(block)
    return b.doc_ids, np.split(b.values(0, b.n), b.ends[:-1]) if b.doc_ids else []


def write_token_files(docs: DataFrame, path: str, end_id: int, tokenizer: str | None = None) -> None:
    """Encode every text and write blocks in ascending doc_id order.

    A part of the output is a range of ids; ``part`` and ``seq`` order the blocks.
    """
    vocab = vocabulary(tokenizer)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, seq = TaskContext.get().partitionId(), 0
        doc_ids: list = []
        ids: list = []

        def block() -> pd.DataFrame:
            return pd.DataFrame({"part": [part], "seq": [seq], "n_ids": [sum(map(len, ids))], "block": [write_block(doc_ids, ids)]})

        for b in batches:
            for doc_id, text in zip(b["doc_id"].astype("object"), b["text"]):
                doc_ids.append(None if pd.isna(doc_id) else int(doc_id))
                ids.append(np.frombuffer(encode(text, vocab, end_id), "<u4"))
                if sum(map(len, ids[-1:])) >= BLOCK_IDS or len(doc_ids) % 64 == 0 and sum(map(len, ids)) >= BLOCK_IDS:
                    yield block()
                    seq, doc_ids, ids = seq + 1, [], []
        if doc_ids:
            yield block()

    text = F.col("text").cast("string")
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tie"))
    ordered = narrow.repartitionByRange(partitions(docs.sparkSession), "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    ordered.select("doc_id", "text").mapInPandas(rows, "part int, seq int, n_ids long, block binary").write.parquet(path)


def read_token_files(spark: SparkSession, path: str, columns: str = "ids array<long>", each: Callable[[np.ndarray], tuple] = lambda ids: (ids.astype(np.int64),)) -> DataFrame:
    """doc_id, start and what ``each`` makes of a document's ids."""
    blocks = spark.read.parquet(path)
    # a row for each part, then for each block of a part
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("part_start"))
    places = blocks.select("part", "seq", F.coalesce(F.sum("n_ids").over(W.partitionBy("part").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    places = places.join(parts, places["part"] == parts["p"]).select(F.col("part").alias("p"), F.col("seq").alias("s"), (F.col("start") + F.col("part_start")).alias("start"))
    names = [c.split()[0] for c in columns.split(", ")]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for start, block in zip(b["start"], b["block"]):
                doc_ids, ids = read_block(block)
                ends = np.cumsum([len(x) for x in ids])
                made = [each(x) for x in ids]
                yield pd.DataFrame({"doc_id": pd.array(doc_ids, dtype="Int64"), "start": int(start) + ends - [len(x) for x in ids], "n_tokens": [len(x) for x in ids]} | {c: [m[i] for m in made] for i, c in enumerate(names)})

    placed = blocks.join(small_or_shuffled(places), (blocks["part"] == places["p"]) & (blocks["seq"] == places["s"]))
    return placed.select("start", "block").mapInPandas(rows, f"doc_id long, start long, n_tokens long, {columns}")


def read_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """doc_id, ids of some documents: only the frames that hold them are decoded."""
    wanted = frozenset(doc_ids)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(d, block.document(i).astype(np.int64)) for block in map(Block, b["block"]) for i, d in enumerate(block.doc_ids) if d in wanted]
            yield pd.DataFrame(out, columns=["doc_id", "ids"]).astype({"doc_id": "int64"})

    return spark.read.parquet(path).select("block").mapInPandas(rows, "doc_id long, ids array<long>")


def digest(ids: np.ndarray) -> tuple[int]:
    return (zlib.crc32(ids.astype("<u4").tobytes()),)
