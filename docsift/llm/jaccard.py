"""Jaccard join of word-shingle sets, exact, with bitmap signatures in size-banded tiles.

Two sets alike at ``percent`` share at least that part of either, so of the first
``n - needed + 1`` shingles of each, in any order that is the same for all sets, they
share one.  The order here is by how common shingles are, which one pass counts in
hashed counters; so boilerplate comes last.  Sets meet in the lists of these first
shingles, and only there.

Each set has a bitmap: a bit for each shingle's hash, in about twice as many bits as
it has shingles.  The bits that one bitmap has and the other lacks bound the overlap
from above; what passes is settled by intersecting sorted arrays of whole sets.

Large groups never become all pairs.  Equal sets are one node.  A list of up to
``LIST`` nodes yields its pairs.  A longer one compares its members with one hub,
the member whose shingles are the most common; links join components.  Lists that still
hold several components are cut into blocks of up to ``BLOCK`` nodes of one size
band (sizes so close that links reach the next band at most).  Two blocks that meet in a list
are one tile, wherever they meet.  Tiles compare bitmaps first and name only the nodes that
may have a link to another component; only their whole sets are fetched, and only
links that join components leave a tile.  Blocks of one component are not compared
with each other.

Nothing is sampled or estimated, so no link is lost.  ``links`` gives all links between
different sets; ``joined`` only the components that they make.

Defined results: a null or blank text has an empty set and no links; fewer words
than a shingle make one shingle; a null id sorts after all others and is its own
component when it has no equal or near text; repeated rows and repeated ids share
a node when their sets are equal; whole texts of any length are read; extra
columns, whatever their names, play no part; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.llm._spark import staged
from docsift.llm.minhash import _labelled, _near_size, _node, _verified, alike, components, full_sets, keyed, shingle_hashes

LIST, BLOCK = 16, 1024
#: Bytes of bitmaps of a block, at most about; and shingles of a block of whole sets.
BLOCK_BYTES, BLOCK_VALUES = 8 << 20, 1 << 20
#: Hashed counters of how common shingles are; a byte for each is broadcast.
COUNTERS, SLICES = 1 << 21, 64
#: Bits of a bitmap.
LEAST_BITS, MOST_BITS = 64, 1 << 13


def needed(n: int, percent: int) -> int:
    """Shingles that a set of ``n`` shares at least with any set alike."""
    return -(-n * percent // 100)


def _counter(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - (COUNTERS.bit_length() - 1))).astype(np.int64)


def commonness(docs: DataFrame, width: int) -> np.ndarray:
    """A byte for each counter: four times the binary logarithm of the shingles it has met, over all texts.

    Tasks count by themselves; slices of their counters are added up apart.
    """
    size = COUNTERS // SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for b in batches:
            for text in b.column("text").cast(pa.binary()).to_pylist():
                np.add.at(total, _counter(shingle_hashes(text, width)), 1)
        if total.any():
            parts = [x.astype("<u4").tobytes() for x in total.reshape(SLICES, size)]
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array(parts, pa.binary())], ["slice", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for at, counts in zip(b.column("slice").to_pylist(), b.column("counts").to_pylist()):
                own = held.setdefault(at, np.zeros(size, np.int64))
                own += np.frombuffer(counts, "<u4")
        ranks = [np.floor(4 * np.log2(np.maximum(x, 1))).astype(np.uint8).tobytes() for x in held.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(ranks, pa.binary())], ["slice", "ranks"])

    texts = keyed(docs).select("text").where("text is not null")
    parts = texts.mapInArrow(count, "slice int, counts binary").repartition(SLICES, "slice")
    out = np.zeros((SLICES, size), np.uint8)
    for r in parts.mapInArrow(add, "slice int, ranks binary").collect():  # a byte for each counter in all
        out[r["slice"]] = np.frombuffer(r["ranks"], np.uint8)
    return out.reshape(-1)


def bits_for(n: int) -> int:
    """Bits of the bitmap of ``n`` shingles: a power of two near twice as many."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << (2 * n - 1).bit_length()))


def bitmap(shingles: np.ndarray) -> bytes:
    on = np.zeros(bits_for(len(shingles)), bool)
    on[shingles & np.uint64(len(on) - 1)] = True
    return np.packbits(on, bitorder="little").tobytes()


def _folded(bitmaps: list[bytes], width: int) -> np.ndarray:
    """Bitmaps as rows of ``width`` bytes (a power of two, no larger than any of them), in 64-bit words."""
    whole = [np.frombuffer(b, np.uint64) for b in bitmaps]
    return np.vstack([w if len(w) == width // 8 else np.bitwise_or.reduce(w.reshape(-1, width // 8), axis=0) for w in whole])


def at_most(bits_a: np.ndarray, n_a: int, bits_b: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Upper bounds of what one set shares with each of others, from bitmaps of the same width."""
    only_a = np.bitwise_count(bits_a & ~bits_b).sum(axis=-1, dtype=np.int64)
    only_b = np.bitwise_count(bits_b & ~bits_a).sum(axis=-1, dtype=np.int64)
    return np.minimum(n_a - only_a, n_b - only_b)


def possible(overlap: np.ndarray, n_a: int, n_b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * overlap >= percent * (n_a + n_b - overlap)


def signatures(docs: DataFrame, width: int, percent: int, ranks: np.ndarray) -> DataFrame:
    """doc_id, text_key, n_shingles, node (hash of the whole set; null if empty), central, first (its rarest shingles, as many as it needs), bits."""
    held = docs.sparkSession.sparkContext.broadcast(ranks)
    schema = "doc_id long, text_key long, n_shingles long, node long, central float, first array<long>, bits binary"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        for b in batches:
            n, node, central, first, bits = [], [], [], [], []
            for text in b.column("text").cast(pa.binary()).to_pylist():
                s = shingle_hashes(text, width)
                n.append(len(s))
                if not len(s):
                    node.append(None), central.append(0.0), first.append(s.view(np.int64)), bits.append(None)
                    continue
                rank = known[_counter(s)]
                order = (rank.astype(np.uint64) << np.uint64(56)) | (s >> np.uint64(8))
                k = len(s) - needed(len(s), percent)
                last = np.partition(order, k)[k]
                node.append(_node(s))
                central.append(float(rank.mean()))
                # all of the last place, should two shingles agree in 56 bits
                first.append(s[order <= last].view(np.int64))
                bits.append(bitmap(s))
            ends = np.concatenate([[0], np.cumsum([len(x) for x in first])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(first) if first else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(central, pa.float32()), lists, pa.array(bits, pa.binary())], ["doc_id", "text_key", "n_shingles", "node", "central", "first", "bits"])

    return keyed(docs).mapInArrow(rows, schema)


def _bounded(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs a, b whose bitmaps allow a link."""
    side = lambda c: nodes.select(F.col("node").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}"))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            ok = []
            for x, y, n_a, n_b in zip(p["bits_a"], p["bits_b"], p["n_a"], p["n_b"]):
                a, b = _folded([x, y], min(len(x), len(y)))
                ok.append(bool(possible(at_most(a, n_a, b, n_b), n_a, n_b, percent)))
            yield p[["a", "b"]][np.array(ok, bool)]

    return pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInPandas(rows, "a long, b long")


class _Index:
    """Nodes of a corpus and the lists of their first shingles, written to the shared folder."""

    def __init__(self, docs: DataFrame, width: int, percent: int):
        self.docs, self.width, self.percent = docs, width, percent
        self.rows = staged(signatures(docs, width, percent, commonness(docs, width)), "signatures")
        some = self.rows.where("node is not null")
        # equal sets are one node, whose text is that of its least doc_id
        rep = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key"))
        nodes = some.groupBy("node").agg(rep.alias("r"), *[F.first(c).alias(c) for c in ("n_shingles", "central", "first", "bits")])
        self.nodes = staged(nodes.select("node", F.col("r.doc_id").alias("rep"), F.col("r.text_key").alias("text_key"), "n_shingles", "central", "first", "bits"), "nodes")
        self.reps = self.nodes.select("node", "rep", "text_key")
        listed = self.nodes.select(F.explode("first").alias("value"), "node", "n_shingles", "central")
        sizes = listed.groupBy("value").agg(F.count("*").alias("size"), F.max(F.struct("central", "node"))["node"].alias("hub")).where("size > 1")
        self.members = staged(listed.drop("central").join(sizes, "value"), "members")

    def short_pairs(self) -> DataFrame:
        """a, b, with repeats: pairs within lists of up to LIST nodes."""
        short = self.members.where(F.col("size") <= LIST).select("value", F.col("node").alias("a"), F.col("n_shingles").alias("n_a"))
        again = short.select(F.col("value").alias("v"), F.col("a").alias("b"), F.col("n_a").alias("n_b"))
        return short.join(again, (F.col("value") == F.col("v")) & (F.col("a") < F.col("b")) & _near_size(self.percent, "n_a", "n_b")).select("a", "b")

    def hub_pairs(self) -> DataFrame:
        """a, b, with repeats: members of longer lists and their hubs."""
        spokes = self.long().where("node != hub").select("node", "hub", "n_shingles")
        hubs = self.nodes.select(F.col("node").alias("h"), F.col("n_shingles").alias("n_h"))
        return spokes.join(hubs, (F.col("hub") == F.col("h")) & _near_size(self.percent, "n_shingles", "n_h")).select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))

    def long(self) -> DataFrame:
        return self.members.where(F.col("size") > LIST)

    def sets(self, wanted: DataFrame, name: str) -> DataFrame:
        return staged(full_sets(wanted.distinct(), self.reps, self.docs, self.width), name)

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """Links a, b among pairs: by bitmaps, then by whole sets."""
        left = staged(_bounded(pairs.distinct(), self.nodes, self.percent), "bounded")
        sets = self.sets(left.select(F.explode(F.array("a", "b")).alias("node")), "sets")
        return staged(_verified(left, sets, self.percent), "confirmed")


def _band(n: str, percent: int) -> F.Column:
    """Size bands, a little wider than sizes of linked sets can differ: links reach the next band at most."""
    return F.floor(F.log(F.col(n).cast("double")) / F.lit(math.log(100 / min(percent, 99)) * (1 + 1e-6))).cast("int")


def _placed(open_: DataFrame, percent: int, joining: bool) -> DataFrame:
    """node, n_shingles, component, family, band, block, of open lists (value, size, node, n_shingles, component)."""
    # a node's home is its longest list, so that those who meet in lists mostly share it
    home = open_.groupBy("node", "n_shingles", "component").agg(F.max(F.struct("size", "value"))["value"].alias("home")).withColumn("band", _band("n_shingles", percent))
    if joining:  # components that fill blocks have blocks of their own
        part = home.groupBy("home", "band", "component").agg(F.count("*").alias("own"))
        home = home.join(part, ["home", "band", "component"]).withColumn("family", F.when(F.col("own") >= BLOCK, F.col("component"))).drop("own")
    else:
        home = home.withColumn("family", F.lit(None).cast("long"))
    most = F.greatest(F.count("*") / BLOCK, F.sum("n_shingles") / BLOCK_VALUES)
    many = home.groupBy("home", "band", "family").agg(F.ceil(most).alias("blocks")).select(F.col("home").alias("h"), F.col("band").alias("s"), F.col("family").alias("f"), "blocks")
    dealt = home.join(many, (F.col("home") == F.col("h")) & (F.col("band") == F.col("s")) & F.col("family").eqNullSafe(F.col("f")))
    # a family is part of the number, so blocks are of one component, or of none in particular
    number = F.xxhash64("home", "band", F.coalesce("family", F.lit(0)), F.col("family").isNull(), F.pmod(F.xxhash64("node"), F.col("blocks")))
    return dealt.select("node", "n_shingles", "component", "family", "band", number.alias("block"))


def _tiles(open_: DataFrame, placed: DataFrame) -> DataFrame:
    """block, block_2: blocks of the same or neighbouring bands that meet in a list."""
    touch = open_.select("value", "node").join(placed.select("node", "block", "band", "family"), "node").select("value", "block", "band", "family").distinct()
    other = touch.select(F.col("value").alias("v"), F.col("block").alias("block_2"), F.col("band").alias("band_2"), F.col("family").alias("family_2"))
    apart = F.col("family").isNull() | F.col("family_2").isNull() | (F.col("family") != F.col("family_2"))
    near = (F.abs(F.col("band") - F.col("band_2")) <= 1) & (F.col("block") <= F.col("block_2"))
    return touch.join(other, (F.col("value") == F.col("v")) & near & apart).select("block", "block_2").distinct()


def _packed_blocks(placed: DataFrame, nodes: DataFrame) -> DataFrame:
    """block, ids, ns, components, widths, bits: a row for each block, bounded by BLOCK."""

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        longs = {c: [rows[c].to_numpy(np.int64).tobytes()] for c in ("node", "n_shingles", "component")}
        width = min(map(len, rows["bits"]))
        return pd.DataFrame({"block": rows["block"].iloc[:1].to_numpy(), "ids": longs["node"], "ns": longs["n_shingles"], "components": longs["component"], "width": [width], "bits": [_folded(list(rows["bits"]), width).tobytes()]})

    own = placed.join(nodes.select("node", "bits"), "node").select("block", "node", "n_shingles", "component", "bits")
    return own.groupBy("block").applyInPandas(pack, "block long, ids binary, ns binary, components binary, width int, bits binary")


def _candidates_in(x: tuple, y: tuple | None, percent: int, joining: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each node of block ``x``, its place and those of ``y`` (None: later ones of x) that bitmaps allow it to be linked with."""
    ids, ns, comps, width, bits = x
    ids_2, ns_2, comps_2, width_2, bits_2 = y or x
    w = min(width, width_2)
    one, two = _folded(list(bits), w), _folded(list(bits_2), w)
    for i in range(len(ids)):
        can = (100 * np.minimum(ns[i], ns_2) >= percent * np.maximum(ns[i], ns_2)) & ((comps[i] != comps_2) if joining else True)
        if y is None:
            can[: i + 1] = False
        j = np.flatnonzero(can)
        if len(j):
            j = j[possible(at_most(one[i], ns[i], two[j], ns_2[j]), ns[i], ns_2[j], percent)]
            if len(j):
                yield i, j


def _unpacked(ids: bytes, ns: bytes, comps: bytes, width: int, bits: bytes) -> tuple:
    return (*[np.frombuffer(c, np.int64) for c in (ids, ns, comps)], width, np.frombuffer(bits, np.uint8).reshape(-1, width))


def _met(tiles: DataFrame, blocks: DataFrame) -> DataFrame:
    """Tiles with both packed blocks."""
    names = ("ids", "ns", "components", "width", "bits")
    one = tiles.join(blocks, "block")
    two = blocks.select(F.col("block").alias("block_2"), *[F.col(c).alias(f"{c}_2") for c in names])
    return one.join(two, "block_2").select("block", "block_2", *names, *[f"{c}_2" for c in names])


def _named(tiles: DataFrame, blocks: DataFrame, percent: int) -> DataFrame:
    """block, block_2, side, node: nodes of a tile that bitmaps allow a link to another component."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                x, y = _unpacked(*r[2:7]), None if r.block == r.block_2 else _unpacked(*r[7:12])
                named_x, named_y = set(), set()
                for i, j in _candidates_in(x, y, percent, True):
                    named_x.add(i)
                    named_y.update(j.tolist())
                if y is None:
                    named_x, named_y = named_x | named_y, set()
                ids = [*x[0][sorted(named_x)].tolist(), *((y or x)[0][sorted(named_y)].tolist())]
                yield pd.DataFrame({"block": r.block, "block_2": r.block_2, "side": [0] * len(named_x) + [1] * len(named_y), "node": ids}).astype({"side": "int32", "node": "int64"})

    return _met(tiles, blocks).mapInPandas(rows, "block long, block_2 long, side int, node long")


def joining_links(members: pd.DataFrame, percent: int) -> list[tuple[int, int]]:
    """Links that join components, of rows (node, component, full, bits, side) of one tile; side 1 is a second block."""
    n_x = int((members["side"] == 0).sum())
    members = members.sort_values("side", kind="stable").reset_index(drop=True)
    full = [np.frombuffer(f, np.uint64) for f in members["full"]]
    ns, comps, ids = np.array([len(f) for f in full]), members["component"].to_numpy(np.int64), members["node"].to_numpy(np.int64)
    width = min(map(len, members["bits"]))
    bits = _folded(list(members["bits"]), width)
    root: dict[int, int] = {}

    def find(c: int) -> int:
        while root.get(c, c) != c:
            root[c] = root.get(root[c], root[c])
            c = root[c]
        return c

    out, inside = [], n_x == len(ids)
    for i in range(n_x):
        first = i + 1 if inside else n_x
        j = np.arange(first, len(ids))
        j = j[(comps[j] != comps[i]) & (100 * np.minimum(ns[i], ns[j]) >= percent * np.maximum(ns[i], ns[j]))]
        bound = at_most(bits[i], ns[i], bits[j], ns[j])
        ok = possible(bound, ns[i], ns[j], percent)
        # the likeliest first: once two components are one, the rest between them needs no look
        for k in j[ok][np.argsort(-bound[ok], kind="stable")].tolist():
            a, b = find(int(comps[i])), find(int(comps[k]))
            if a != b and alike(full[i], full[k], percent):
                root[max(a, b)] = min(a, b)
                out.append((int(ids[i]), int(ids[k])))
    return out


def _tile_links(index: _Index, open_: DataFrame) -> DataFrame:
    """Links a, b between components that meet in open lists (value, size, node, n_shingles, component)."""
    percent = index.percent
    placed = staged(_placed(open_, percent, True), "blocks")
    tiles = staged(_tiles(open_, placed), "tiles")
    named = staged(_named(tiles, staged(_packed_blocks(placed, index.nodes), "packed"), percent), "named")
    sets = index.sets(named.select("node"), "tile-sets")
    own = sets.join(placed.select(F.col("node").alias("n"), "component"), F.col("node") == F.col("n")).drop("n").join(index.nodes.select("node", "bits"), "node")
    members = named.join(own, "node").select("block", "block_2", "side", "node", "component", "full", "bits")

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(joining_links(rows, percent), columns=["a", "b"]).astype("int64")

    return members.groupBy("block", "block_2").applyInPandas(compare, "a long, b long")


def joined(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (the least id reachable by links), in one row for each row of ``docs``."""
    index = _Index(docs, width, percent)
    label = components(index.confirmed(index.short_pairs().union(index.hub_pairs())))
    # long lists again, as far as they still hold several components
    placed = _labelled(index.long().select("value", "size", "node", "n_shingles"), label)
    split = placed.groupBy("value").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("value")
    open_ = staged(placed.join(split, "value"), "open")
    if not open_.isEmpty():
        label = components(label.select(F.col("node").alias("a"), F.col("component").alias("b")).union(_tile_links(index, open_)))
    named = _labelled(index.reps, label)
    least = named.groupBy("component").agg(F.min(F.struct(F.col("rep").isNull().alias("none"), "rep"))["rep"].alias("component_id"))
    named = named.join(least, "component").select("node", "component_id")
    out = index.rows.where("node is not null").select("doc_id", "n_shingles", "node").join(named, "node").select("doc_id", "n_shingles", "component_id")
    # empty sets meet nothing
    return out.union(index.rows.where("node is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def links(docs: DataFrame, width: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """All links between different sets (a, b), and members (doc_id, node): as many rows as there are links, so the square of a group of near copies."""
    index = _Index(docs, width, percent)
    open_ = index.long().withColumn("component", F.col("node"))
    placed = staged(_placed(open_, percent, False), "blocks")
    blocks = staged(_packed_blocks(placed, index.nodes), "packed")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                x, y = _unpacked(*r[2:7]), None if r.block == r.block_2 else _unpacked(*r[7:12])
                for i, j in _candidates_in(x, y, percent, False):
                    ids = (y or x)[0][j]
                    yield pd.DataFrame({"a": np.minimum(ids, x[0][i]), "b": np.maximum(ids, x[0][i])})

    tiled = _met(_tiles(open_, placed), blocks).mapInPandas(rows, "a long, b long")
    found = index.confirmed(index.short_pairs().union(tiled))
    return found, index.rows.where("node is not null").select("doc_id", "node")
