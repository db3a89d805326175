"""Best-fit packing of documents into fixed sequences by a grouping genetic algorithm.

Documents become token pieces of at most ``capacity``.  Full pieces are sequences
already.  The rest are dealt over cells of a few thousand pieces, and in each
cell several islands evolve populations of packings: crossover injects the fullest
bins of one parent into the other, bins that now hold a piece twice
are dissolved, and displaced pieces go by best fit or into bins as full as can be made of them.
Where best fit alone reaches the least number of bins there can be, there is nothing to search for.  Between epochs each island
sends its best packing to the next one.  Bins that a cell could not fill well are
opened again and dealt over as many cells of that size as they need, until one
cell has dealt with them or a level saves too few bins to be worth another.

Defined results: a null or empty text is its end id alone; repeated rows and ids
are packed separately; whole texts of any length are encoded and cut; extra columns play no part; an empty table gives no rows.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docsift.llm._spark import partitions, staged
from docsift.llm.tokens import encode, vocabulary

CELL, ISLANDS, POPULATION, EPOCHS, GENERATIONS = 3000, 2, 4, 2, 24
#: Generations without a better packing after which an island rests.
PATIENCE = 10
#: Bins filled less than this go to the next level.
WELL_FILLED = 0.98
#: A level that saves a smaller share of the bins it opened is the last.
LEAST_SAVED = 0.01

Bins = list[list[int]]


def pieces(docs: DataFrame, capacity: int, end_id: int, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) for each piece of each row."""
    vocab = vocabulary(tokenizer)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc_id, text in zip(b["doc_id"].astype("object"), b["text"]):
                packed = encode(text, vocab, end_id)
                doc_id = None if pd.isna(doc_id) else int(doc_id)
                for i, at in enumerate(range(0, len(packed), 4 * capacity)):
                    own = packed[at : at + 4 * capacity]
                    out.append((doc_id, i, at // 4, len(own) // 4, zlib.crc32(own), *([np.frombuffer(own, "<u4").astype(np.int32)] if with_ids else [])))
            made = pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])
            yield made.assign(doc_id=pd.array(made["doc_id"].tolist(), dtype="Int64"))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(rows, schema)


class _Room:
    """Open bins by the room left in them, with the tightest fit found by one bit operation."""

    def __init__(self, capacity: int):
        self.mask, self.at, self.capacity = 0, {}, capacity

    def put(self, bin_no: int, room: int) -> None:
        if room:
            self.at.setdefault(room, []).append(bin_no)
            self.mask |= 1 << room

    def take(self, length: int) -> tuple[int, int] | None:
        fits = self.mask >> length
        if not fits:
            return None
        room = length + (fits & -fits).bit_length() - 1
        bins = self.at[room]
        found = bins.pop()
        if not bins:
            self.mask ^= 1 << room
        return found, room


def best_fit(bins: Bins, loose: list[int], lengths: list[int], capacity: int) -> Bins:
    """Put loose pieces into the fullest bins that take them, longest first."""
    out, room = [list(b) for b in bins], _Room(capacity)
    for i, b in enumerate(out):
        room.put(i, capacity - sum(lengths[x] for x in b))
    for x in loose:
        found = room.take(lengths[x])
        if found is None:
            out.append([x])
            room.put(len(out) - 1, capacity - lengths[x])
        else:
            out[found[0]].append(x)
            room.put(found[0], found[1] - lengths[x])
    return out


def fitness(bins: Bins, lengths: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first; then the unevenness of their filling."""
    return -len(bins), sum((sum(lengths[x] for x in b) / capacity) ** 2 for b in bins)


def fullest(loose: list[int], lengths: list[int], capacity: int, smallest_first: bool) -> Bins:
    """New bins for loose pieces, each begun with the smallest (or largest) one left and filled as full as two more can.

    Lengths in stock are bits of one number, so the longest that fits is one operation.
    """
    stock: dict[int, list[int]] = {}
    for x in loose:
        stock.setdefault(lengths[x], []).append(x)
    mask, out = sum(1 << n for n in stock), []

    def pick(n: int) -> int:
        nonlocal mask
        x = stock[n].pop()
        if not stock[n]:
            mask ^= 1 << n
        return x

    while mask:
        least = (mask & -mask).bit_length() - 1
        first = least if smallest_first else mask.bit_length() - 1
        own, room = [pick(first)], capacity - first
        while mask and room >= (least := (mask & -mask).bit_length() - 1):
            fits = mask & ((1 << (room + 1)) - 1)
            if room >= 4 * least:  # far from full: the longest that fits
                n = fits.bit_length() - 1
                own.append(pick(n))
                room -= n
                continue
            one = fits.bit_length() - 1
            best, pair = (one, 0, 0), (one, None)
            rest = fits
            while rest:  # the shorter of two, in ascending order
                n = (rest & -rest).bit_length() - 1
                rest &= rest - 1
                if 2 * n > room:
                    break
                under = mask & ((1 << (room - n + 1)) - 1)
                if len(stock[n]) == 1:
                    under &= ~(1 << n)
                if under >> n:
                    other = under.bit_length() - 1
                    # as full as can be; of those, the most alike
                    if (found := (n + other, 1, n - other)) > best:
                        best, pair = found, (n, other)
            for n in pair:
                if n is not None:
                    own.append(pick(n))
                    room -= n
        out.append(own)
    return out


def _filled(kept: Bins, loose: list[int], lengths: list[int], capacity: int, rng: random.Random) -> Bins:
    """Loose pieces back in: by best fit, or most of them in bins as full as can be."""
    how = rng.randrange(3)
    if how:
        return [*kept, *fullest(loose, lengths, capacity, how == 1)]
    return best_fit(kept, sorted(loose, key=lambda x: (-lengths[x], rng.random())), lengths, capacity)


def crossover(one: Bins, other: Bins, lengths: list[int], capacity: int, rng: random.Random) -> Bins:
    """Inject the fullest bins of ``other`` into ``one``, dissolve bins that now hold a piece twice, and put displaced pieces back."""
    by_fill = sorted(other, key=lambda b: -sum(lengths[x] for x in b))
    inject = by_fill[: max(1, rng.randint(len(other) // 10, len(other) // 2))]
    inside = {x for b in inject for x in b}
    kept, loose = list(inject), []
    for b in one:
        if inside.isdisjoint(b):
            kept.append(b)
        else:
            loose += [x for x in b if x not in inside]
    return _filled(kept, loose, lengths, capacity, rng)


def mutate(bins: Bins, lengths: list[int], capacity: int, rng: random.Random) -> Bins:
    """Dissolve the emptiest bins and some others."""
    by_fill = sorted(range(len(bins)), key=lambda i: sum(lengths[x] for x in bins[i]))
    gone = set(by_fill[: max(1, len(bins) // rng.choice((5, 20, 50)))]) | set(rng.sample(range(len(bins)), max(1, len(bins) // rng.choice((5, 20, 50)))))
    return _filled([b for i, b in enumerate(bins) if i not in gone], [x for i in gone for x in bins[i]], lengths, capacity, rng)


def bound(lengths: list[int], capacity: int) -> int:
    """Bins that any packing needs: by the sum of lengths, or by pieces of which no two fit together."""
    return max(-(-sum(lengths) // capacity), sum(2 * n > capacity for n in lengths))


def evolve(population: list[Bins], lengths: list[int], capacity: int, generations: int, rng: random.Random) -> list[Bins]:
    """Generations of two children each; parents win tournaments of two, and packings as good as another one are not kept.

    Ends at the bound, or when PATIENCE generations brought nothing better.
    """
    size, floor, idle = max(2, len(population)), bound(lengths, capacity), 0
    some = {fitness(b, lengths, capacity): b for b in population}
    for _ in range(generations):
        keys = sorted(some, reverse=True)
        if -keys[0][0] <= floor or idle >= PATIENCE:
            break  # no packing has fewer bins, or none is found
        parent = lambda: some[max(rng.choice(keys), rng.choice(keys))]
        for child in (crossover(parent(), parent(), lengths, capacity, rng), mutate(parent(), lengths, capacity, rng)):
            some.setdefault(fitness(child, lengths, capacity), child)
        best = sorted(some, reverse=True)[:size]
        idle = 0 if best[0] > keys[0] else idle + 1
        some = {k: some[k] for k in best}
    return [some[k] for k in sorted(some, reverse=True)]


def first_population(lengths: list[int], capacity: int, size: int, rng: random.Random) -> list[Bins]:
    """Best fit, longest first; bins as full as can be, begun with short and with long pieces; then best fit with growing disorder."""
    every = range(len(lengths))
    fit = lambda i: best_fit([], sorted(every, key=lambda x: -lengths[x] * (1 + 0.15 * i * rng.random())), lengths, capacity)
    full = lambda short: fullest(list(every), lengths, capacity, short)
    makers = [lambda: fit(0), lambda: full(True), lambda: full(False), *[lambda i=i: fit(i) for i in range(1, size)]]
    return [make() for make in makers[:size]]


def start(lengths: list[int], capacity: int, rng: random.Random) -> list[Bins]:
    """The first population; best fit alone where no packing has fewer bins."""
    best = best_fit([], sorted(range(len(lengths)), key=lambda x: -lengths[x]), lengths, capacity)
    return [best] if len(best) <= bound(lengths, capacity) else first_population(lengths, capacity, POPULATION, rng)


def _bins(packed: bytes) -> Bins:
    of = np.frombuffer(packed, "<i4")
    order = np.argsort(of, kind="stable")
    return [x.tolist() for x in np.split(order, np.flatnonzero(np.diff(of[order])) + 1)] if len(of) else []


def _packed(bins: Bins, n: int) -> bytes:
    of = np.zeros(n, "<i4")
    for i, b in enumerate(bins):
        of[b] = i
    return of.tobytes()


def _level(items: DataFrame, cells: int, capacity: int, level: int) -> DataFrame:
    """uid, length, bin (unique over the level), place and how full the bin is."""
    # rows of a cell meet once, in numbers near CELL; uid was fixed when the pieces were written
    dealt = items.select(F.pmod(F.xxhash64("uid", F.lit(level)), F.lit(cells)).cast("int").alias("cell"), F.struct("uid", "length").alias("item"))
    cell = dealt.groupBy("cell").agg(F.array_sort(F.collect_list("item")).alias("items"))
    state = staged(cell.select("cell", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), F.transform("items", lambda x: x["length"]).alias("lengths"), F.lit(None).cast("array<binary>").alias("population")), "islands")
    members = staged(cell.select("cell", F.transform("items", lambda x: x["uid"]).alias("uids")), "cells")

    def epoch(number: int):
        def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                out = []
                for cell_no, island, lengths, population in zip(b["cell"], b["island"], b["lengths"], b["population"]):
                    lengths, rng = [int(x) for x in lengths], random.Random(f"{level} {cell_no} {island} {number}")
                    now = start(lengths, capacity, rng) if population is None else [_bins(x) for x in population]
                    out.append([_packed(x, len(lengths)) for x in evolve(now, lengths, capacity, GENERATIONS, rng)])
                yield b[["cell", "island", "lengths"]].assign(population=out)

        return rows

    schema = "cell int, island int, lengths array<long>, population array<binary>"
    for number in range(EPOCHS):
        # islands of a cell are dealt apart, and each epoch is written, so a lost executor costs its own cells only
        dealt = state.repartition(min(partitions(items.sparkSession), max(1, cells * ISLANDS)), "cell", "island")
        state = staged(dealt.mapInPandas(epoch(number), schema), "epoch")
        if number + 1 < EPOCHS:
            elite = state.select("cell", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), F.element_at("population", 1).alias("elite"))
            state = state.join(elite, ["cell", "island"]).select("cell", "island", "lengths", F.concat("population", F.array("elite")).alias("population"))
    best = state.select("cell", "island", "lengths", F.element_at("population", 1).alias("best"))

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for (cell_no, uids), own in zip(zip(b["cell"], b["uids"]), b["islands"]):
                lengths = [int(x) for x in own[0]["lengths"]]
                bins = max((_bins(x["best"]) for x in sorted(own, key=lambda x: x["island"])), key=lambda x: fitness(x, lengths, capacity))
                out = []
                for i, members_ in enumerate(bins):
                    full, at = sum(lengths[x] for x in members_), 0
                    for x in members_:
                        out.append((int(uids[x]), lengths[x], (level << 56) + (int(cell_no) << 24) + i, at, full / capacity))
                        at += lengths[x]
                yield pd.DataFrame(out, columns=["uid", "length", "sequence_id", "offset", "full"])

    islands = best.groupBy("cell").agg(F.collect_list(F.struct("island", "lengths", "best")).alias("islands"))
    return members.join(islands, "cell").select("cell", "uids", "islands").mapInPandas(placed, "uid long, length long, sequence_id long, offset long, full double")


def pack_lengths(items: DataFrame, capacity: int) -> DataFrame:
    """uid, sequence_id, offset for items (uid, length); lengths are 1 to ``capacity``."""
    whole = items.where(F.col("length") == capacity).select("uid", (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    open_, out, level, held, before = items.where(F.col("length") < capacity).select("uid", "length"), whole, 0, None, 0
    left = open_.count()
    place, poor = ["uid", "sequence_id", "offset"], F.col("full") < WELL_FILLED
    while left:
        cells = -(-left // CELL)
        made = staged(_level(open_, cells, capacity, level), "packed")
        first = F.col("offset") == 0  # one piece of each bin
        bins, poor_bins, left = made.agg(F.count_if(first), F.count_if(first & poor), F.count_if(poor)).first()
        if held is not None and bins >= before:
            return out.union(held.select(place))  # the bins as they were are as good
        if cells == 1 or held is not None and before - bins < LEAST_SAVED * before:
            return out.union(made.select(place))
        out, held = out.union(made.where(~poor).select(place)), made.where(poor)
        open_, before, level = held.select("uid", "length"), poor_bins, level + 1
    return out


def pack_documents(docs: DataFrame, capacity: int = 4096, end_id: int = 1, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids) of each piece."""
    # the number of a row is part of what is written, so it never changes afterwards
    table = staged(pieces(docs, capacity, end_id, tokenizer, with_ids).withColumn("uid", F.monotonically_increasing_id()), "pieces")
    where = pack_lengths(table.select("uid", "length"), capacity)
    return table.join(where, "uid").drop("uid")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, doc_ids and ids: the packed sequences themselves, of at most ``capacity`` ids each."""
    rows = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("parts"))
    return rows.select("sequence_id", F.transform("parts", lambda p: p["doc_id"]).alias("doc_ids"), F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"))
