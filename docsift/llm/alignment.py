"""Alignment of two tokenizers over a corpus: which ids of one end where which of the other do.

Text is encoded by a byte-level vocabulary (side A) and a piece vocabulary (side
B).  Byte offsets where tokens of both end cut a text into groups; the two tokens
that end there are linked.  How often a pair of ids is linked, corpus-wide, tells
which A id a B id goes with best.

Links are packed by parts (documents of a few megabytes) and stripes (``STRIPE``
neighbouring B ids).  A stripe's counts are a dense matrix of its B ids by all A
ids, into which parts are added with ``np.add.at``; the maxima of its rows are the
best counts.  The links of a stripe then go to where its matrix is, are looked up
there, and their sums return to the documents.  A stripe is bounded by the two
vocabularies; a stripe with more links than ``LOAD`` is split by parts, so an id
that a third of all tokens have is no task of its own, and a part sends a
stripe each pair once.

Defined results: a text that is null, empty, or whose joined token bytes differ
from a space and the text on either side (for instance one that holds U+2581) has
no tokens, zeros, and no hash; special tokens' strings are plain text; repeated rows and
repeated or null ids are rows of their own, and each counts; whole texts of any
length are encoded, a text at a time; ties for a B id's highest count are all best;
extra columns, whatever their names, play no part; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.llm._spark import partitions, shared_dir, staged

#: B ids of a stripe.
STRIPE = 32
#: Characters and documents of a part, at most, but for a single longer text.
PART_CHARS, PART_DOCS = 4 << 20, 1 << 16
#: Characters given to the tokenizers at once.
ENCODE_CHARS = 256 << 10
#: Links of a stripe that one group of rows scores, about.
LOAD = 4_000_000
#: Parts whose counts one group of rows adds up.
ADDED_PARTS = 256
#: Documents' sums held by a task before it sends them.
HELD = 1 << 21

#: The byte-level pre-tokenizer's pattern; a fixed value.
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters whose class no edition of Unicode has changed: ASCII without most controls, and Latin letters.
_SETTLED = re.compile("[\t-\r -~\u00a1-\u024f]*")

LINKS = "part long, stripe int, pairs binary, totals binary, runs binary, docs binary, times binary"
DOCS = "place int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def byte_decoder() -> dict[str, int]:
    """The printable characters that byte-level vocabularies write for bytes: Latin-1's own where printable, then U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Side:
    """Bytes, byte lengths, and numbers as text of a vocabulary's ids."""

    def __init__(self, table: list[bytes], ends: tuple[str, str]):
        self.table, self.size = table, len(table)
        self.lengths = np.array([len(t) for t in table], np.int64)
        #: A number and the mark after it: inside a group, then at the group's end.
        self.marked = [f"{i}{mark}" for mark in ends for i in range(len(table))]


class Vocabularies:
    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=b_path)
        known = byte_decoder()
        entries = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        # a special token has no byte-level spelling; as plain text it never occurs
        self.side_a = Side([bytes(known[c] for c in t) if all(c in known for c in t) else t.encode() for t in entries], (",", "|"))
        b = self.b
        pieces = [(b.id_to_piece(i), b.is_byte(i)) for i in range(b.vocab_size())]
        self.fast = self._ranked(a_path)
        self.side_b = Side([bytes([int(p[3:5], 16)]) if is_byte else p.replace("▁", " ").encode() for p, is_byte in pieces], (",", ";"))

    def _ranked(self, path: str):
        """The A vocabulary for the tiktoken library, several times as fast, if its ids are the order of its merges."""
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in spec["model"].get("merges", [])]
        own = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        plain = spec["normalizer"] is None and own.items() <= (spec["pre_tokenizer"] or {}).items()
        if not plain or [spec["model"]["vocab"].get(t) for t in merged] != list(range(256, 256 + len(merged))):
            return None
        return tiktoken.Encoding("side_a", pat_str=WORDS, mergeable_ranks={self.side_a.table[i]: i for i in range(256 + len(merged))}, special_tokens={})

    def encode_a(self, texts: list[str]) -> list[list[int]]:
        """Ids of a space and each text; texts of settled characters alone take the fast way."""
        fast = [self.fast is not None and _SETTLED.fullmatch(t) is not None for t in texts]
        slow = iter(self.a.encode_batch_fast([" " + t for t, f in zip(texts, fast) if not f], add_special_tokens=False))
        return [self.fast.encode_ordinary(" " + t) if f else next(slow).ids for t, f in zip(texts, fast)]

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        out_a, out_b, some, held = [], [], [], 0
        for t in [*texts, None]:
            if some and (t is None or held + len(t) > ENCODE_CHARS):
                out_a += self.encode_a(some)
                out_b += self.b.encode(some, num_threads=1)
                some, held = [], 0
            if t is not None:
                some.append(t)
                held += len(t)
        return out_a, out_b


_loaded: dict[tuple[str, str], Vocabularies] = {}


def vocabularies(a_path: str, b_path: str) -> Vocabularies:
    """Loaded once a worker."""
    if (a_path, b_path) not in _loaded:
        _loaded[a_path, b_path] = Vocabularies(a_path, b_path)
    return _loaded[a_path, b_path]


def paths(a_path: str | None, b_path: str | None) -> tuple[str, str]:
    """The paths given, or those of the public byte-level and piece vocabularies."""
    if not (a_path and b_path):
        import public_tokenizers

        a_path = a_path or public_tokenizers.path("byte_bpe_50k.json")
        b_path = b_path or public_tokenizers.path("piece_bpe_32k.model")
    return a_path, b_path


class Part:
    """The groups and links of some texts (UTF-8 bytes or None), in arrays over all of them."""

    def __init__(self, raw: list[bytes | None], v: Vocabularies):
        n = len(raw)
        self.n_a, self.n_b, self.n_groups = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.hashes = [""] * n
        self.doc = self.pair = np.empty(0, np.int64)
        some = [i for i, t in enumerate(raw) if t]
        ids_a, ids_b = v.encode([raw[i].decode("utf-8", "replace") for i in some])
        live = [(i, a, b) for i, a, b in zip(some, ids_a, ids_b) if self._whole(a, v.side_a, raw[i]) and self._whole(b, v.side_b, raw[i])]
        if not live:
            return
        of = np.array([x[0] for x in live])
        n_a, n_b = (np.array([len(x[side]) for x in live], np.int64) for side in (1, 2))
        a, b = (np.concatenate([np.array(x[side], np.int64) for x in live]) for side in (1, 2))
        # texts one after the other: a text's end is an end of both sides, so groups never reach over it
        end_a, end_b = np.cumsum(v.side_a.lengths[a]), np.cumsum(v.side_b.lengths[b])
        common = np.intersect1d(end_a, end_b, assume_unique=True)
        group_a, group_b = np.searchsorted(common, end_a), np.searchsorted(common, end_b)
        last_a, last_b = common[group_a] == end_a, common[group_b] == end_b
        first = np.concatenate([[0], group_a[np.cumsum(n_a) - 1] + 1])  # a text's first group
        self.n_a[of], self.n_b[of], self.n_groups[of] = n_a, n_b, np.diff(first)
        self.doc = np.repeat(of, np.diff(first))
        self.pair = b[last_b] * v.side_a.size + a[last_a]
        # A's ids of a group, then B's: a token stands after all of both sides that come before
        order = np.empty(len(a) + len(b), np.int32)
        order[np.arange(len(a)) + np.searchsorted(group_b, group_a)] = a + v.side_a.size * last_a
        order[np.arange(len(b)) + np.searchsorted(group_a, group_b, side="right")] = -1 - (b + v.side_b.size * last_b)
        at, text = 0, {"a": v.side_a.marked, "b": v.side_b.marked}
        for i, k in zip(of, n_a + n_b):
            said = "".join([text["a"][x] if x >= 0 else text["b"][-1 - x] for x in order[at : at + k].tolist()])
            self.hashes[i] = hashlib.sha256(said[:-1].encode()).hexdigest()
            at += k

    @staticmethod
    def _whole(ids: list[int], side: Side, raw: bytes) -> bool:
        return b"".join(map(side.table.__getitem__, ids)) == b" " + raw

    def stripes(self, n_other: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """stripe, pairs (their cells), totals, runs (documents of each pair), docs, times (links of each pair and document)."""
        if not len(self.pair):
            return
        n = int(self.doc.max()) + 1
        both, times = np.unique(self.pair * n + self.doc, return_counts=True)
        pair, doc = both // n, both % n
        starts = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        runs = np.diff(np.append(starts, len(pair)))
        pairs, totals = pair[starts], np.add.reduceat(times, starts)
        stripe = pairs // (n_other * STRIPE)
        edges = np.flatnonzero(np.concatenate([[True], stripe[1:] != stripe[:-1], [True]]))
        ends = np.append(starts, len(pair))
        for lo, hi in zip(edges[:-1], edges[1:]):
            cells = pairs[lo:hi] - stripe[lo] * n_other * STRIPE
            s = slice(ends[lo], ends[hi])
            yield int(stripe[lo]), cells.astype("<u4"), totals[lo:hi].astype("<u4"), runs[lo:hi].astype("<u4"), doc[s].astype("<u2"), times[s].astype("<u4")


def _parts(docs: DataFrame, path: str, a_path: str, b_path: str) -> None:
    """Encode and align; write a row for each document (kind doc) and for each part and stripe (kind link)."""
    fields = [("kind", pa.string()), ("part", pa.int64()), ("stripe", pa.int32()), *[(c, pa.binary()) for c in ("pairs", "totals", "runs", "docs", "times")], ("place", pa.int32()), *[(c, pa.int64()) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")], ("groups_sha256", pa.string())]
    schema = pa.schema(fields)

    def table(**columns) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in fields], schema=schema)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, number = vocabularies(a_path, b_path), TaskContext.get().partitionId() << 32
        for b in batches:
            ids, texts = b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary()).to_pylist()
            at = 0
            while at < len(ids):
                end, held = at + 1, len(texts[at] or b"")
                while end < len(ids) and end - at < PART_DOCS and held + len(texts[end] or b"") <= PART_CHARS:
                    held += len(texts[end] or b"")
                    end += 1
                p = Part(texts[at:end], v)
                n = end - at
                # a group ends with one token of each side, so it is one link
                yield table(kind=["doc"] * n, part=[number] * n, place=np.arange(n), doc_id=ids[at:end], n_a=p.n_a, n_b=p.n_b, n_groups=p.n_groups, n_links=p.n_groups, groups_sha256=p.hashes)
                found = [(s, *(x.tobytes() for x in arrays)) for s, *arrays in p.stripes(v.side_a.size)]
                if found:
                    stripe, pairs, totals, runs, who, times = zip(*found)
                    m = len(found)
                    yield table(kind=["link"] * m, part=[number] * m, stripe=stripe, pairs=pairs, totals=totals, runs=runs, docs=who, times=times)
                at, number = end, number + 1

    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    some.mapInArrow(rows, f"kind string, {LINKS}, {DOCS}").write.partitionBy("kind").parquet(path)


def _added(rows: DataFrame, group: list[str], n_other: int, wide: str) -> DataFrame:
    """stripe, pairs, totals (64 bits), links: the sum of each group's rows (stripe first in ``group``; totals of numbers ``wide``)."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense, now = np.zeros(STRIPE * n_other, np.int64), None

        def done() -> pa.RecordBatch:
            cells = np.flatnonzero(dense)
            out = [[now[0]], [cells.astype("<u4").tobytes()], [dense[cells].tobytes()], [int(dense[cells].sum())]]
            dense[cells] = 0
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int32(), pa.binary(), pa.binary(), pa.int64()))], ["stripe", "pairs", "totals", "links"])

        for b in batches:
            for *key, pairs, totals in zip(*[b.column(c).to_pylist() for c in (*group, "pairs", "totals")]):
                if now is not None and key != now:
                    yield done()
                now = key
                np.add.at(dense, np.frombuffer(pairs, "<u4"), np.frombuffer(totals, wide))
        if now is not None:
            yield done()

    dealt = rows.select(*group, "pairs", "totals").repartition(partitions(rows.sparkSession), *group).sortWithinPartitions(*group)
    return dealt.mapInArrow(add, "stripe int, pairs binary, totals binary, links long")


def pair_counts(links: DataFrame, n_other: int) -> DataFrame:
    """stripe, pairs, totals, links: in a row for each stripe, how many links of the corpus each pair has."""
    parts = links.select("part").distinct().count()
    groups = -(-parts // ADDED_PARTS)
    if groups == 1:
        return _added(links, ["stripe"], n_other, "<u4")
    some = links.withColumn("share", F.pmod(F.xxhash64("part"), F.lit(groups)))
    return _added(_added(some, ["stripe", "share"], n_other, "<u4"), ["stripe"], n_other, "<i8")


def _scored(links: DataFrame, counts: DataFrame, n_other: int) -> DataFrame:
    """part, docs, best, sums: what the links of some stripes give the documents of a part."""
    # a row for each stripe: no more than the vocabulary has
    shares = counts.select("stripe", F.greatest(F.lit(1), F.ceil(F.col("links") / LOAD)).cast("int").alias("shares"))
    none = F.lit(None).cast("binary")
    matrix = counts.join(F.broadcast(shares), "stripe").select("stripe", F.explode_outer(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(0).alias("side"), F.lit(None).cast("long").alias("part"), "pairs", "totals", none.alias("runs"), none.alias("docs"), none.alias("times"))
    own = links.join(F.broadcast(shares), "stripe").select("stripe", F.pmod(F.xxhash64("part"), F.col("shares")).cast("int").alias("share"), F.lit(1).alias("side"), "part", "pairs", none.alias("totals"), "runs", "docs", "times")
    together = matrix.union(own).repartition(partitions(links.sparkSession), "stripe", "share").sortWithinPartitions("stripe", "share", "side")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros((STRIPE, n_other), np.int64)
        flat, most, cells = dense.reshape(-1), None, np.empty(0, np.int64)
        held: dict[int, np.ndarray] = {}
        size = 0

        def sent() -> pa.RecordBatch:
            out = [(p, docs.astype("<u2").tobytes(), x[0, docs].tobytes(), x[1, docs].tobytes()) for p, x in held.items() for docs in [np.flatnonzero(x[1])]]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.binary(), pa.binary(), pa.binary()))], ["part", "docs", "best", "sums"])

        for b in batches:
            for side, part, pairs, totals, runs, docs, times in zip(*[b.column(c).to_pylist() for c in ("side", "part", "pairs", "totals", "runs", "docs", "times")]):
                pairs = np.frombuffer(pairs, "<u4")
                if side == 0:
                    flat[cells] = 0
                    cells = pairs
                    np.add.at(flat, cells, np.frombuffer(totals, "<i8"))
                    most = dense.max(axis=1)
                    continue
                count = flat[pairs]
                runs = np.frombuffer(runs, "<u4")
                docs, times = np.frombuffer(docs, "<u2"), np.frombuffer(times, "<u4").astype(np.int64)
                x = held.get(part)
                if x is None or x.shape[1] <= docs.max():
                    wide = np.zeros((2, int(docs.max()) + 1), np.int64)
                    if x is not None:
                        wide[:, : x.shape[1]] = x
                        size -= x.shape[1]
                    held[part] = x = wide
                    size += x.shape[1]
                np.add.at(x[0], docs, times * np.repeat(count == most[pairs // n_other], runs))
                np.add.at(x[1], docs, times * np.repeat(count, runs))
                if size > HELD:
                    yield sent()
                    size = 0
        if held:
            yield sent()

    return together.mapInArrow(score, "part long, docs binary, best binary, sums binary")


def aligned(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Documents and links of a corpus, its counts by stripe, and the size of A's vocabulary; all written to the shared folder."""
    import uuid

    spark, (a_path, b_path) = docs.sparkSession, paths(a_path, b_path)
    n_other = vocabularies(a_path, b_path).side_a.size
    at = f"{shared_dir(spark)}/docsift-alignment-{uuid.uuid4().hex}"
    _parts(docs, at, a_path, b_path)
    # a folder of a kind is missing where no row is of it
    all_ = spark.read.schema(f"kind string, {LINKS}, {DOCS}").parquet(at)
    links = all_.where("kind = 'link'").select("part", "stripe", "pairs", "totals", "runs", "docs", "times")
    own = all_.where("kind = 'doc'").select("part", "place", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    return own, links, staged(pair_counts(links, n_other), "stripes"), n_other


def best_ids(counts: DataFrame, n_other: int) -> DataFrame:
    """b_id, a_id, links: each B id's best A ids, ties included, of counts by stripe."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for stripe, pairs, totals in zip(*[b.column(c).to_pylist() for c in ("stripe", "pairs", "totals")]):
                pairs, totals = np.frombuffer(pairs, "<u4").astype(np.int64), np.frombuffer(totals, "<i8")
                dense = np.zeros((STRIPE, n_other), np.int64)
                np.add.at(dense.reshape(-1), pairs, totals)
                best = totals == dense.max(axis=1)[pairs // n_other]
                out = (stripe * STRIPE + pairs[best] // n_other, pairs[best] % n_other, totals[best])
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["b_id", "a_id", "links"])

    return counts.select("stripe", "pairs", "totals").mapInArrow(rows, "b_id long, a_id long, links long")


def document_alignment(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, in a row for each row of ``docs``.

    ``n_best`` counts the links whose pair is linked as often as any of its B id;
    ``count_sum`` adds up the counts of the pairs of all links.
    """
    own, links, counts, n_other = aligned(docs, a_path, b_path)
    scores = _scored(links, counts, n_other)

    def add(rows):
        """At most a row for each task and stripe, over the documents of one part."""
        import pandas as pd

        arrays = [[np.frombuffer(x, t) for x in rows[c]] for c, t in (("docs", "<u2"), ("best", "<i8"), ("sums", "<i8"))]
        who, best, sums = (np.concatenate(x) for x in arrays)
        total = np.zeros((2, int(who.max()) + 1), np.int64)
        np.add.at(total[0], who, best)
        np.add.at(total[1], who, sums)
        place = np.unique(who)
        return pd.DataFrame({"p": rows["part"].iloc[0], "at": place.astype(np.int32), "n_best": total[0, place], "count_sum": total[1, place]})

    summed = scores.groupBy("part").applyInPandas(add, "p long, at int, n_best long, count_sum long")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    found = own.join(summed, (own["part"] == summed["p"]) & (own["place"] == summed["at"]), "left")
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
