"""Near-duplicate detection with bottom-k sketches from one hash function.

Each text becomes a set of hashed word shingles; its ``k`` smallest hashes are its
sketch, the values it retains.  Retained values are counted over all sets, and each
set enters the inverted lists of its *rarest* ones only: two sets alike at J keep
at least ``needed`` values in common, so of the rarest ``k - needed + 1`` of each
they share one.  Boilerplate that many texts share sorts last and makes no lists
as long as a set has enough rarer values.  Candidates pass an estimate on the
sketch of the union, and exact Jaccard on full sets has the last word.

Large groups never become all pairs.  Equal sets collapse to one node first.  A
list of up to ``LIST`` nodes yields its pairs, with the number of lists they share.
A longer one compares its members with one hub, the member whose values are the
most common; links join components.  Lists that still hold several components
are compared in blocks: nodes are dealt over blocks of about ``BLOCK`` similar
ones, two blocks that meet in a list are one unit of work wherever they meet, and
only links that join components leave it.  Blocks that one component fills are not
compared with each other, so a group of copies costs as many comparisons as it has
members; only texts that are alike below the threshold cost more.

Both kinds of lists are complete.  With ``sketch=None`` sets retain all values and
nothing is lost; else a link of sets larger than the sketch is lost when the
sketches agree less than expected by SLACK standard errors.

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
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.llm._spark import small_or_shuffled, staged

SKETCH = 128
LIST, BLOCK = 16, 512
#: Shingles of a block, at most about.
BLOCK_VALUES = 1 << 20
#: Standard errors of the sketch that two sets may agree less than expected.
SLACK = 5.0

_SPREAD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


class _WordHashes(dict):
    """Word to hash, emptied when it holds ``limit`` words."""

    limit = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_words = _WordHashes()


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def shingle_hashes(text: str | bytes | None, width: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a whole text."""
    raw = (text or b"") if not isinstance(text, str) else text.encode("utf-8", "surrogatepass")
    # bytes.lower() and bytes.split() know ASCII alone: A-Z, and space with 09-0D
    words = raw.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    if len(words) < width:
        return np.array([xxhash.xxh64_intdigest(b"\x20".join(words), seed=len(words))], np.uint64)
    n = len(words) - width + 1
    total = np.full(n, width, np.uint64)
    for i in range(width):
        # an odd factor for each place, so the order of words counts
        total += h[i : i + n] * (_SPREAD[i % len(_SPREAD)] + np.uint64(2 * (i // len(_SPREAD))))
    return np.unique(_mix(total))


def _node(values: np.ndarray) -> int:
    """One number for a whole set."""
    return xxhash.xxh64_intdigest(values.tobytes()) - (1 << 63)


def _error(percent: int, union: float, size: int) -> float:
    """Standard error of the values that two sets alike at ``percent`` share, of the ``size`` smallest of their union."""
    j = percent / 100
    left = max(0.0, (union - size) / max(union - 1, 1.0))  # drawn without putting back
    return math.sqrt(size * j * (1 - j) * left)


def needed(n: int, percent: int, size: int | None) -> int:
    """Retained values that a set of ``n`` shares at least with any set alike at ``percent``.

    The other has at least n * J of its values.  Where the union is larger than the
    sketch, the union's smallest values stand for it; nested sets share least.
    """
    whole = -(-n * percent // 100)
    widest = n * 100 / percent  # the largest union
    if size is None or widest <= size:
        return whole
    return max(1, min(whole, math.floor(size * percent / 100 - SLACK * _error(percent, widest, size))))


def sketches(docs: DataFrame, width: int, percent: int, size: int | None) -> DataFrame:
    """doc_id, text_key, n_shingles, node (hash of the whole set; null if empty), rare (how many of its rarest values it is listed by), sketch."""
    schema = "doc_id long, text_key long, n_shingles long, node long, rare int, sketch array<long>"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, node, rare, kept = [], [], [], []
            for text in b.column("text").cast(pa.binary()).to_pylist():
                s = shingle_hashes(text, width)
                own = s[:size].view(np.int64)
                n.append(len(s))
                node.append(_node(s) if len(s) else None)
                rare.append(len(own) - needed(len(s), percent, size) + 1 if len(s) else 0)
                kept.append(own.copy())
            ends = np.concatenate([[0], np.cumsum([len(x) for x in kept])]).astype(np.int32)
            values = np.concatenate(kept) if kept else np.empty(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(values))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(rare, pa.int32()), lists], ["doc_id", "text_key", "n_shingles", "node", "rare", "sketch"])

    return keyed(docs).mapInArrow(rows, schema)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, text: rows whose text is the same share the key."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))


def inverted(nodes: DataFrame) -> DataFrame:
    """value, node, n_shingles, central: the lists of each node's rarest retained values, as far as others retain them, too.

    ``central`` tells how common all of a node's values are.
    """
    values = nodes.select("node", F.explode("sketch").alias("value"))
    common = values.groupBy("value").agg(F.count("*").alias("f")).where("f > 1")
    shared = values.join(common, "value")
    own = shared.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("f", "value"))).alias("own"), F.sum("f").alias("f"))  # at most a sketch
    narrow = nodes.select("node", "n_shingles", "rare", F.size("sketch").alias("k"))
    # values that no other node retains are the rarest, and need no list
    left = F.col("rare") - (F.col("k") - F.size("own"))
    placed = own.join(narrow, "node").where(left > 0).withColumn("central", F.col("f") / F.col("k"))
    return placed.select("node", "n_shingles", "central", F.explode(F.slice("own", F.lit(1), left)).alias("o")).select(F.col("o.value").alias("value"), "node", "n_shingles", "central")


def _near_size(percent: int, x: str, y: str) -> F.Column:
    return F.expr(f"100 * least({x}, {y}) >= {percent} * greatest({x}, {y})")


def estimate(a: np.ndarray, b: np.ndarray, na: int, nb: int, percent: int, size: int | None) -> bool | None:
    """Whether two sets are alike by their sketches alone: None where only full sets can tell.

    The estimate is the share of the union's smallest values that both sets hold.
    Sketches that hold their whole sets make it exact.
    """
    both = np.intersect1d(a, b, assume_unique=True)
    if size is None or na <= size and nb <= size:
        return bool(100 * len(both) >= percent * (na + nb - len(both)))
    # the union's smallest values are known up to the smaller of the two last retained ones
    last = min(s[-1] for s, n in ((a, na), (b, nb)) if n > size)
    common = int(np.searchsorted(both, last, side="right"))
    seen = int(np.searchsorted(a, last, side="right") + np.searchsorted(b, last, side="right")) - common
    union = (na + nb) / (1 + percent / 100)
    return None if common >= seen * percent / 100 - SLACK * _error(percent, union, seen) - 1e-9 else False


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _estimated(pairs: DataFrame, nodes: DataFrame, percent: int, size: int | None) -> DataFrame:
    """a, b, sure: pairs whose estimate is not too low."""
    met = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    some = staged(nodes.select("node", "n_shingles", "sketch").join(small_or_shuffled(met), "node"), "met")
    side = lambda c: some.select(F.col("node").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}"))
    joined = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            found = [estimate(a.view(np.uint64), b.view(np.uint64), na, nb, percent, size) for a, b, na, nb in zip(p["s_a"], p["s_b"], p["n_a"], p["n_b"])]
            keep = np.array([x is not False for x in found], bool)
            yield pd.DataFrame({"a": p["a"], "b": p["b"], "sure": [x is True for x in found]})[keep]

    return joined.select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInPandas(rows, "a long, b long, sure boolean")


def full_sets(wanted: DataFrame, reps: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """node, full: the whole sets of some nodes, from the text of one row of each."""
    at = reps.join(small_or_shuffled(wanted), "node").select("node", F.col("rep").alias("_rep"), F.col("text_key").alias("_key"))
    texts = keyed(docs).join(small_or_shuffled(at), (F.col("text_key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_rep")))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            full = [shingle_hashes(t, width) for t in b["text"]]
            same = np.array([_node(s) for s in full], np.int64) == b["node"].to_numpy(np.int64)
            yield pd.DataFrame({"node": b["node"], "full": [s.tobytes() for s in full]})[same]

    return texts.select("node", "text").mapInPandas(rows, "node long, full binary").dropDuplicates(["node"])


def _verified(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs a, b that full sets confirm."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            ok = [alike(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(p["f_a"], p["f_b"])]
            yield p[["a", "b"]][np.array(ok, bool)]

    side = lambda c: full.select(F.col("node").alias(c), F.col("full").alias(f"f_{c}"))
    return pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "f_a", "f_b").mapInPandas(rows, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) by alternating large and small stars, for linked nodes."""
    e = staged(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "links")
    state = None
    while True:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        first = large.groupBy("a").agg(F.min("b").alias("m"))
        e = staged(large.join(first, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(first.select("a", F.col("m").alias("b"))).distinct(), "stars")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select("b", F.col("b").alias("c")).distinct())
        state = now


def _labelled(rows: DataFrame, label: DataFrame) -> DataFrame:
    """Adds component; a node without links is its own."""
    return rows.join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))


def overlaps(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """How many values each set of ``x`` shares with each of ``y``, by products of 0-1 matrices, some columns at a time."""
    values, of = np.unique(np.concatenate([*x, *y]), return_inverse=True)
    row = np.repeat(np.arange(len(x) + len(y)), [len(s) for s in (*x, *y)])
    many = np.bincount(of, minlength=len(values)) > 1
    number = np.cumsum(many) - 1
    row, of = row[many[of]], number[of[many[of]]]
    out = np.zeros((len(x), len(y)), np.float32)
    order = np.argsort(of, kind="stable")
    row, of = row[order], of[order]
    step = 4096
    for at in range(0, int(number[-1]) + 1 if len(number) else 0, step):
        lo, hi = np.searchsorted(of, [at, at + step])
        m = np.zeros((len(x) + len(y), step), np.float32)
        m[row[lo:hi], of[lo:hi] - at] = 1
        out += m[: len(x)] @ m[len(x) :].T
    return out


def compare_blocks(members: pd.DataFrame, percent: int, size: int | None) -> list[tuple[int, int]]:
    """Links that join components, of rows (node, component, full, side) of one block (side 0) or two.

    Shared retained values tell which pairs can be alike, the estimate and full sets which are.
    """
    x = members[members["side"] == 0].reset_index(drop=True)
    y = members[members["side"] == 1].reset_index(drop=True)
    inside = not len(y)
    y = x if inside else y
    fx, fy = ([np.frombuffer(f, np.uint64) for f in t["full"]] for t in (x, y))
    sx, sy = [f[:size] for f in fx], [f[:size] for f in fy]
    nx, ny = np.array([len(f) for f in fx]), np.array([len(f) for f in fy])
    mx, my = (np.array([needed(int(i), percent, size) for i in n]) for n in (nx, ny))
    shared = overlaps(sx, sy)
    can = (shared >= np.maximum(mx[:, None], my[None, :])) & (x["component"].to_numpy()[:, None] != y["component"].to_numpy()[None, :])
    can &= 100 * np.minimum(nx[:, None], ny[None, :]) >= percent * np.maximum(nx[:, None], ny[None, :])
    if inside:
        can = np.triu(can, 1)
    i, j = np.nonzero(can)
    order = np.argsort(-shared[i, j], kind="stable")
    root: dict[int, int] = {}

    def find(c: int) -> int:
        while root.get(c, c) != c:
            root[c] = root.get(root[c], root[c])
            c = root[c]
        return c

    out = []
    cx, cy = x["component"].tolist(), y["component"].tolist()
    for k in order:
        p, q = int(i[k]), int(j[k])
        a, b = find(cx[p]), find(cy[q])
        if a != b and (sure := estimate(sx[p], sy[q], len(fx[p]), len(fy[q]), percent, size)) is not False and (sure or alike(fx[p], fy[q], percent)):
            root[max(a, b)] = min(a, b)
            out.append((int(x["node"][p]), int(y["node"][q])))
    return out


def _block_links(open_: DataFrame, sets: DataFrame, percent: int, size: int | None) -> DataFrame:
    """Links a, b between components that meet in open lists (value, size, node, n_shingles, component)."""
    # a node's home is its longest list, so that those who meet in lists mostly share it
    home = open_.groupBy("node", "n_shingles", "component").agg(F.max(F.struct("size", "value"))["value"].alias("home"))
    # components that fill blocks have blocks of their own
    part = home.groupBy("home", "component").agg(F.count("*").alias("own"))
    alone = home.join(part, ["home", "component"]).withColumn("family", F.when(F.col("own") >= BLOCK, F.col("component")))
    many = alone.groupBy("home", "family").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n_shingles") / BLOCK_VALUES)).alias("blocks"))
    many = many.select(F.col("home").alias("h"), F.col("family").alias("g"), "blocks")
    dealt = alone.join(many, (F.col("home") == F.col("h")) & F.col("family").eqNullSafe(F.col("g")))
    # a family is part of the number, so blocks are of one component, or of none in particular
    number = F.xxhash64("home", F.coalesce("family", F.lit(0)), F.col("family").isNull(), F.pmod(F.xxhash64("node"), F.col("blocks")))
    placed = staged(dealt.select("node", "component", "family", number.alias("block")), "blocks")

    touch = open_.select("value", "node").join(placed, "node").select("value", "block", "family").distinct()
    other = touch.select(F.col("value").alias("v"), F.col("block").alias("block_2"), F.col("family").alias("family_2"))
    apart = F.col("family").isNull() | F.col("family_2").isNull() | (F.col("family") != F.col("family_2"))
    units = staged(touch.join(other, (F.col("value") == F.col("v")) & (F.col("block") <= F.col("block_2")) & apart).select("block", "block_2").distinct(), "units")

    members = placed.join(sets, "node").select(F.col("block").alias("of"), "node", "component", "full")
    one = units.join(members, F.col("block") == F.col("of")).withColumn("side", F.lit(0))
    two = units.where("block != block_2").join(members, F.col("block_2") == F.col("of")).withColumn("side", F.lit(1))

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(compare_blocks(rows, percent, size), columns=["a", "b"]).astype("int64")

    return one.union(two).select("block", "block_2", "node", "component", "full", "side").groupBy("block", "block_2").applyInPandas(compare, "a long, b long")


def groups(docs: DataFrame, width: int = 5, percent: int = 80, sketch: int | None = SKETCH) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id, stays, in one row for each row of ``docs``.

    ``stays`` marks the rows of one id and one text (``keyed``) in each group, and all rows with an empty set.
    """
    rows = staged(sketches(docs, width, percent, sketch), "sketches")
    some = rows.where("node is not null")
    # equal sets are one node, whose text is that of its least doc_id
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key"))
    nodes = some.groupBy("node").agg(first.alias("r"), F.first("n_shingles").alias("n_shingles"), F.first("rare").alias("rare"), F.first("sketch").alias("sketch"))
    nodes = staged(nodes.select("node", F.col("r.doc_id").alias("rep"), F.col("r.text_key").alias("text_key"), "n_shingles", "rare", "sketch"), "nodes")
    reps = nodes.select("node", "rep", "text_key")

    listed = staged(inverted(nodes), "lists")
    sizes = listed.groupBy("value").agg(F.count("*").alias("size"), F.min(F.struct(-F.col("central"), "node"))["node"].alias("hub")).where("size > 1")
    members = staged(listed.drop("central").join(sizes, "value"), "members")
    short = members.where(F.col("size") <= LIST).select("value", F.col("node").alias("a"), F.col("n_shingles").alias("n_a"))
    again = short.select(F.col("value").alias("v"), F.col("a").alias("b"), F.col("n_a").alias("n_b"))
    inside = short.join(again, (F.col("value") == F.col("v")) & (F.col("a") < F.col("b")) & _near_size(percent, "n_a", "n_b")).select("a", "b")
    long = members.where(F.col("size") > LIST)
    spokes = long.where("node != hub").select("node", "hub", "n_shingles")
    hubs = spokes.join(nodes.select(F.col("node").alias("h"), F.col("n_shingles").alias("n_h")), (F.col("hub") == F.col("h")) & _near_size(percent, "n_shingles", "n_h"))
    both = inside.union(hubs.select(F.least("node", "hub"), F.greatest("node", "hub")))
    pairs = staged(both.groupBy("a", "b").agg(F.count("*").alias("overlap")), "pairs")

    checked = staged(_estimated(pairs, nodes, percent, sketch), "estimated")
    doubt = checked.where("not sure").select("a", "b")
    wanted = doubt.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = staged(full_sets(wanted, reps, docs, width), "sets")
    links = staged(checked.where("sure").select("a", "b").union(_verified(doubt, sets, percent)), "verified")
    label = components(links)

    # long lists again, as far as they still hold several components
    placed = _labelled(long.select("value", "size", "node", "n_shingles"), label)
    split = placed.groupBy("value").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("value")
    open_ = staged(placed.join(split, "value"), "open")
    if not open_.isEmpty():
        sets = staged(full_sets(open_.select("node").distinct(), reps, docs, width), "open-sets")
        label = components(label.select(F.col("node").alias("a"), F.col("component").alias("b")).union(_block_links(open_, sets, percent, sketch)))

    named = _labelled(reps, label)
    least = named.groupBy("component").agg(F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "text_key")).alias("r"))
    named = named.join(least, "component").select("node", F.col("r.rep").alias("component_id"), F.col("r.text_key").alias("_key"))
    stays = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("text_key") == F.col("_key"))
    out = some.select("doc_id", "text_key", "n_shingles", "node").join(named, "node").select("doc_id", "text_key", "n_shingles", "component_id", stays.alias("stays"))
    # empty sets meet nothing
    return out.union(rows.where("node is null").select("doc_id", "text_key", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True)))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, sketch: int | None = SKETCH) -> DataFrame:
    """doc_id, n_shingles, component_id (the group's least id), kept, in one row for each row of ``docs``."""
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    return groups(docs, width, percent, sketch).select("doc_id", "n_shingles", "component_id", kept.alias("kept"))
