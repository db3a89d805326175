"""Exact top-k by inner product over vector-approximation files.

Vectors become integers (floor of 1024 times each component).  The approximation
file holds 8-bit cells, in blocks of up to ``BLOCK`` vectors; exact vectors lie in a
table of their own.  Three steps:

*Scan.*  Query blocks meet cell blocks through an equi-join on a group number, and
each cell bounds a score from both sides.  A task hands a query's k-th best lower
bound, its floor, on from block to block; what cannot reach the floor is dropped.
A sixteenth of the vectors, in blocks of their own, is scanned first, so that the
rest starts from its floors.

*Reads.*  The few candidates left are ranked by upper bound: exact vectors of the
first ``2 k`` are joined and scored, then of those whose bound still reaches the
k-th score.  No other exact vector meets a query.

*Crowds.*  Where more than ``CROWD * k`` vectors of one group stay open for a query
(a mass of vectors closer together than a cell is wide), the scan names the group
instead, and it is scored exactly by blocks, which leave k rows each.

Of equal vectors, only those with the k + 1 least ids, k rows of each, are
candidates at all: no others can be among the k best.

Defined results: a vector that is null, or holds a null or a number that is not
finite, takes no part; vectors meet only those of their own length; ties go to
the smaller id; equal rows are separate candidates, but rows with the query's id
are not candidates for it; columns other than vec_id and embedding play no part;
an empty table gives no rows.  Scores beyond 64 bits are held at the end of the range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docsift.llm._spark import partitions, small_or_shuffled, staged

BLOCK, QUERY_BLOCK = 2048, 256
#: Open candidates of one group, in k, from which on it is scored by exact blocks.
CROWD = 16
#: One vector in so many, of one group in so many, is scanned first.
FIRST = 4
_EXACT = float(1 << 53)
_LIMIT = (1 << 63) - 1
_FOUND = "q_rid long, query_id long, rid long, vec_id long, g int, low double, high double, crowd boolean"


def usable(col: F.Column) -> F.Column:
    """Not null, and each component a finite number."""
    bad = F.exists(col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return col.isNotNull() & ~F.coalesce(bad, F.lit(True))


def _rows(vectors: DataFrame) -> DataFrame:
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return own.where(usable(F.col("embedding")))


def _candidates(vectors: DataFrame, k: int, groups: int) -> DataFrame:
    """rid (of this row alone), g, vec_id, embedding: the exact vectors, copies beyond need left out."""
    # both limits cut each task's own rows before any of them move
    again = F.row_number().over(W.partitionBy("embedding", "vec_id").orderBy("vec_id"))
    few = _rows(vectors).withColumn("_n", again).where(F.col("_n") <= k)
    few = few.withColumn("_r", F.dense_rank().over(W.partitionBy("embedding").orderBy("vec_id"))).where(F.col("_r") <= k + 1)
    g = F.pmod(F.xxhash64("embedding"), F.lit(groups)).cast("int")
    return staged(few.select(F.monotonically_increasing_id().alias("rid"), g.alias("g"), "vec_id", "embedding").repartition(groups, "g"), "exact")


def _blocks(vectors: DataFrame, size: int, early: F.Column | None = None) -> DataFrame:
    """uid, g, early, dim, shift, rids, ids, cells and exact components of up to ``size`` vectors a row."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b.assign(dim=b["embedding"].map(len).astype("int64"))
            for (g, first, dim), part in b.groupby(["g", "early", "dim"]):
                for at in range(0, len(part), size):
                    p = part.iloc[at : at + size]
                    rids, ids = p["rid"].to_numpy(np.int64), p["vec_id"].to_numpy(np.int64)
                    q = _whole(p["embedding"], dim)
                    top = float(np.abs(q).max(initial=0))
                    shift = max(0, int(np.ceil(np.log2(top + 1))) - 7) if top else 0
                    cells = np.clip(np.floor(q / 2.0**shift), -128, 127).astype(np.int8)
                    yield pd.DataFrame({"uid": [rids[0]], "g": [g], "early": [first], "dim": [dim], "shift": [shift], "rids": [rids.tobytes()], "ids": [ids.tobytes()], "cells": [cells.tobytes()], "exact": [q.tobytes()]})

    early = F.lit(False) if early is None else early
    return vectors.select("rid", "g", early.alias("early"), "vec_id", "embedding").mapInPandas(rows, "uid long, g int, early boolean, dim int, shift int, rids binary, ids binary, cells binary, exact binary")


def _whole(embeddings: pd.Series, dim: int) -> np.ndarray:
    return np.floor(1024 * np.vstack(embeddings.to_list()).astype(np.float64)).reshape(len(embeddings), dim)


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of rows, each with its own; by Python's integers where doubles could round."""
    safe = np.abs(a).max(axis=1, initial=0) * np.abs(b).sum(axis=1) < _EXACT
    if safe.all():
        return np.einsum("ij,ij->i", a, b).astype(np.int64)
    out = np.zeros(len(a), np.int64)
    out[safe] = np.einsum("ij,ij->i", a[safe], b[safe]).astype(np.int64)
    for i in np.flatnonzero(~safe):
        out[i] = max(-_LIMIT - 1, min(_LIMIT, sum(int(x) * int(y) for x, y in zip(a[i], b[i]))))
    return out


def bounds(query: np.ndarray, at_cell: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest score of vectors whose cells' corners score ``at_cell``.

    A component lies in [cell, cell + 1) * 2**shift, so its product does with the ends in the query's sign.
    """
    width = 2.0**shift - 1
    slop = 1e-9 * (np.abs(query).sum() * 128 * 2.0**shift + 1)  # corners may be rounded; exact scores decide
    ends = at_cell + width * np.minimum(query, 0).sum() - slop, at_cell + width * np.maximum(query, 0).sum() + slop
    return np.clip(ends[0], -_LIMIT - 1, _LIMIT), np.clip(ends[1], -_LIMIT - 1, _LIMIT)  # as scores are held


class _Open:
    """The open candidates of one block of queries in one group, and the floors under them."""

    def __init__(self, uid: int, g: int, rids: np.ndarray, ids: np.ndarray, floors: np.ndarray, k: int):
        self.uid, self.g, self.rids, self.ids, self.k = uid, g, rids, ids, k
        self.floors = floors.copy()
        self.found: list[list[tuple[np.ndarray, ...]]] = [[] for _ in ids]  # rids, ids, low, high

    def meet(self, i: int, rids: np.ndarray, ids: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        near = np.flatnonzero((high >= self.floors[i]) & (ids != self.ids[i]))
        if not len(near):
            return
        self.found[i].append((rids[near], ids[near], low[near], high[near]))
        if sum(len(f[0]) for f in self.found[i]) > self.k:
            r, v, lo, hi = (np.concatenate(x) for x in zip(*self.found[i]))
            self.floors[i] = max(self.floors[i], np.partition(lo, len(lo) - self.k)[len(lo) - self.k])
            left = hi >= self.floors[i]
            self.found[i] = [(r[left], v[left], lo[left], hi[left])]

    def rows(self) -> pd.DataFrame:
        out = []
        for i, f in enumerate(self.found):
            if not f:
                continue
            r, v, lo, hi = (np.concatenate(x) for x in zip(*f))
            crowd = len(r) > CROWD * self.k
            if crowd:  # its best lower bounds still raise the floor
                best = np.argsort(-lo, kind="stable")[: self.k]
                r, v, lo, hi = r[best], v[best], lo[best], np.full(len(best), hi.max())
            out.append(pd.DataFrame({"q_rid": self.rids[i], "query_id": self.ids[i], "rid": r, "vec_id": v, "g": np.int32(self.g), "low": lo, "high": hi, "crowd": crowd}))
        return pd.concat(out) if out else pd.DataFrame()


def _scan(cells: DataFrame, queries: DataFrame, k: int, groups: int, step: int = 1) -> DataFrame:
    """What stays open (_FOUND) of cell blocks of each ``step``-th group, for query blocks with their floors."""
    q = queries.select(F.col("uid").alias("q_uid"), F.col("dim").alias("q_dim"), F.col("rids").alias("q_rids"), F.col("ids").alias("q_ids"), F.col("exact").alias("q_exact"), "floors")
    q = q.withColumn("q_g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1), F.lit(step))))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = None
        for b in batches:
            for dim, g, shift, rids, ids, block, q_uid, q_rids, q_ids, q_exact, floors in b.itertuples(index=False, name=None):
                rids, ids = np.frombuffer(rids, np.int64), np.frombuffer(ids, np.int64)
                if now is None or (now.uid, now.g) != (q_uid, g):
                    if now and len(left := now.rows()):
                        yield left
                    own = np.frombuffer(q_ids, np.int64)
                    now = _Open(q_uid, g, np.frombuffer(q_rids, np.int64), own, np.frombuffer(floors, np.float64) if floors else np.full(len(own), -np.inf), k)
                qs = np.frombuffer(q_exact, np.float64).reshape(len(now.ids), dim)
                corner = (qs @ np.frombuffer(block, np.int8).reshape(len(ids), dim).T.astype(np.float64)) * 2.0**shift
                for i in range(len(now.ids)):
                    now.meet(i, rids, ids, *bounds(qs[i], corner[i], shift))
        if now and len(left := now.rows()):
            yield left

    # with queries on the left, a sorted join gives all cell blocks of one query block in a row
    met = q.join(cells, (F.col("dim") == F.col("q_dim")) & (F.col("g") == F.col("q_g")))
    return met.select("dim", "g", "shift", "rids", "ids", "cells", "q_uid", "q_rids", "q_ids", "q_exact", "floors").mapInPandas(rows, _FOUND)


def _kth(rows: DataFrame, column: str, k: int) -> DataFrame:
    """q_rid and the k-th largest value of a column, for those with k of them."""
    place = F.row_number().over(W.partitionBy("q_rid").orderBy(F.desc(column)))
    return rows.select("q_rid", column).withColumn("_p", place).where(F.col("_p") <= k).where(F.col("_p") == k).select(F.col("q_rid").alias("_q"), F.col(column).alias("floor"))


def _with_floors(blocks: DataFrame, floors: DataFrame) -> DataFrame:
    """Query blocks with the floors of their queries, in order."""
    at = blocks.select("uid", "members").select("uid", F.posexplode("members").alias("at", "q"))
    each = at.join(floors, F.col("q") == F.col("_q"), "left").select("uid", "at", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"))
    listed = each.groupBy(F.col("uid").alias("_u")).agg(F.array_sort(F.collect_list(F.struct("at", "floor"))).alias("f"))  # QUERY_BLOCK at most

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"_u": b["_u"], "floors": [np.array(f, np.float64).tobytes() for f in b["f"]]})

    packs = listed.select("_u", F.col("f.floor").alias("f")).mapInPandas(packed, "_u long, floors binary")
    return blocks.drop("floors").join(packs, F.col("uid") == F.col("_u")).drop("_u")


def open_candidates(queries: DataFrame, exact: DataFrame, k: int, groups: int) -> DataFrame:
    """The scan: q_rid, query_id, rid, vec_id, g, low, high, crowd of all that bounds leave open."""
    early = (F.pmod(F.xxhash64("rid"), F.lit(FIRST)) == 0) & (F.col("g") % FIRST == 0)
    cells = staged(_blocks(exact, BLOCK, early).drop("exact"), "va")
    q = _blocks(queries, QUERY_BLOCK)

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(members=[np.frombuffer(r, np.int64) for r in b["rids"]], floors=None)

    q = staged(q.select("uid", "dim", "rids", "ids", "exact").mapInPandas(members, "uid long, dim int, rids binary, ids binary, exact binary, members array<long>, floors binary"), "queries")
    first = staged(_scan(cells.where("early"), q, k, groups, FIRST), "first")
    rest = staged(_scan(cells.where("not early"), _with_floors(q, _kth(first, "low", k)), k, groups), "rest")
    both = first.union(rest)
    floors = _kth(both, "low", k)
    return staged(both.join(floors, F.col("q_rid") == F.col("_q"), "left").where(F.col("floor").isNull() | (F.col("high") >= F.col("floor"))).drop("_q", "floor"), "open")


def _read(pairs: DataFrame, queries: DataFrame, exact: DataFrame) -> DataFrame:
    """q_rid, query_id, vec_id, score of the pairs, by their exact vectors."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            dims = b["x"].map(len)
            for dim in dims.unique():
                p = b[dims == dim]
                yield p[["q_rid", "query_id", "vec_id"]].assign(score=_scores(_whole(p["y"], dim), _whole(p["x"], dim)))

    x = exact.select(F.col("rid").alias("_r"), F.col("embedding").alias("x"))
    y = queries.select(F.col("rid").alias("_s"), F.col("embedding").alias("y"))
    met = x.join(small_or_shuffled(pairs.select("q_rid", "query_id", "rid", "vec_id")), F.col("_r") == F.col("rid")).join(y, F.col("_s") == F.col("q_rid"))
    return met.select("q_rid", "query_id", "vec_id", "x", "y").mapInPandas(rows, "q_rid long, query_id long, vec_id long, score long")


def _crowds(crowded: DataFrame, queries: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """q_rid, query_id, vec_id, score: the k best of each block of the groups that are crowded for a query."""
    pairs = crowded.select("q_rid", "g").distinct()
    asked = queries.drop("g").join(pairs, F.col("rid") == F.col("q_rid")).select("rid", "g", "vec_id", "embedding")
    q = _blocks(asked.repartition("g"), QUERY_BLOCK).select(F.col("g").alias("q_g"), F.col("dim").alias("q_dim"), F.col("rids").alias("q_rids"), F.col("ids").alias("q_ids"), F.col("exact").alias("q_exact"))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for dim, ids, block, q_rids, q_ids, q_exact in b.itertuples(index=False, name=None):
                ids, q_ids = np.frombuffer(ids, np.int64), np.frombuffer(q_ids, np.int64)
                x, qs = np.frombuffer(block, np.float64).reshape(len(ids), dim), np.frombuffer(q_exact, np.float64).reshape(len(q_ids), dim)
                for i, (rid, qid) in enumerate(zip(np.frombuffer(q_rids, np.int64), q_ids)):
                    s = _scores(np.broadcast_to(qs[i], x.shape), x)
                    best = np.lexsort((ids, ~s))  # ~s falls as s rises, without overflow
                    best = best[ids[best] != qid][:k]
                    yield pd.DataFrame({"q_rid": rid, "query_id": qid, "vec_id": ids[best], "score": s[best]})

    held = exact.join(F.broadcast(pairs.select("g").distinct()), "g", "left_semi")  # at most one row a group
    met = _blocks(held, BLOCK).join(q, (F.col("g") == F.col("q_g")) & (F.col("dim") == F.col("q_dim")))
    return met.select("dim", "ids", "exact", "q_rids", "q_ids", "q_exact").mapInPandas(rows, "q_rid long, query_id long, vec_id long, score long")


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 10, groups: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best candidates other than itself."""
    groups = groups or partitions(candidates.sparkSession)
    exact = _candidates(candidates, k, groups)
    asked = staged(_rows(queries).repartition(max(1, groups // 8)).select(F.monotonically_increasing_id().alias("rid"), F.lit(0).alias("g"), "vec_id", "embedding"), "asked")
    open_ = open_candidates(asked, exact, k, groups)

    crowded = open_.where("crowd")
    some = not crowded.isEmpty()
    single = open_.where("not crowd")
    if some:  # a crowded group is scored whole
        single = single.join(crowded.select("q_rid", "g").distinct(), ["q_rid", "g"], "left_anti")
    order = F.row_number().over(W.partitionBy("q_rid").orderBy(F.desc("high"), "rid"))
    ranked = single.withColumn("place", order)
    nearest = staged(_read(ranked.where(F.col("place") <= 2 * k), asked, exact), "nearest")
    later = ranked.where(F.col("place") > 2 * k).join(_kth(nearest, "score", k), F.col("q_rid") == F.col("_q")).where(F.col("high") >= F.col("floor"))
    found = nearest.union(_read(later, asked, exact))
    if some:
        found = found.union(_crowds(crowded, asked, exact, k))
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
