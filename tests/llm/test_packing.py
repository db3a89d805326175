import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from docsift.llm import packing as P
from tests.llm.helpers import docs

PLAIN = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_every_piece_has_one_place_and_sequences_are_gapless(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["red", "fox", "runs"]) for _ in range(rng.choice([3, 20, 60, 150, 400]))) for _ in range(120)] + [None, "", "x"]
    got = P.pack_documents(docs(spark, texts), capacity=128).collect()
    want = {}
    for i, t in enumerate(texts):
        ids = PLAIN.encode(t or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 128):
            own = ids[k : k + 128]
            want[i, k // 128] = (k, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 128
    floor = -(-sum(r.length for r in got) // 128)
    assert len(by) <= floor + max(2, floor // 50)


def test_cells_and_levels(spark, monkeypatch):
    monkeypatch.setattr(P, "CELL", 100)
    rng = random.Random(4)
    lengths = [rng.randint(1, 99) for _ in range(900)] + [100] * 5
    items = spark.createDataFrame(list(enumerate(lengths)), "uid long, length long").repartition(4)
    got = P.pack_lengths(items, 100).collect()
    assert sorted(r.uid for r in got) == list(range(905))
    fill = defaultdict(list)
    for r in got:
        fill[r.sequence_id].append((r.offset, lengths[r.uid]))
    for parts in fill.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))] and sum(n for _, n in parts) <= 100
    assert len(fill) <= 1.04 * -(-sum(lengths) // 100) + 2


def test_lengths_that_fill_no_bin_stay_in_small_cells(spark, monkeypatch):
    monkeypatch.setattr(P, "CELL", 100)
    seen, level = [], P._level
    monkeypatch.setattr(P, "_level", lambda items, cells, *rest: seen.append((items.count(), cells)) or level(items, cells, *rest))
    lengths = [51 + i % 5 for i in range(900)]
    items = spark.createDataFrame(list(enumerate(lengths)), "uid long, length long").repartition(4)
    got = P.pack_lengths(items, 100).collect()
    assert sorted(r.uid for r in got) == list(range(900)) and len({r.sequence_id for r in got}) == 900
    assert all(n <= 100 * cells for n, cells in seen) and len(seen) <= 2


def test_crossover_and_mutation_lose_nothing():
    rng = random.Random(1)
    lengths = [rng.randint(1, 60) for _ in range(200)]
    population = P.first_population(lengths, 100, 4, rng)
    for bins in (*population, P.crossover(population[0], population[1], lengths, 100, rng), P.mutate(population[0], lengths, 100, rng), *P.evolve(population, lengths, 100, 5, rng)):
        assert sorted(x for b in bins for x in b) == list(range(200))
        assert all(sum(lengths[x] for x in b) <= 100 for b in bins)


def test_evolution_never_gets_worse():
    rng = random.Random(2)
    lengths = [rng.choice([34, 33, 51, 49, 26, 24, 67]) for _ in range(300)]
    population = P.first_population(lengths, 100, 3, rng)
    best = max(P.fitness(b, lengths, 100) for b in population)
    assert P.fitness(P.evolve(population, lengths, 100, 6, rng)[0], lengths, 100) >= best


def test_best_fit_takes_the_tightest_bin():
    assert P.best_fit([[0], [1]], [2], [50, 70, 30], 100) == [[0], [1, 2]]


def test_sequences_hold_the_ids(spark):
    packed = P.pack_documents(docs(spark, ["red fox", "fox", None]), capacity=64, with_ids=True)
    one = P.sequences(packed).collect()
    assert len(one) == 1
    red, fox = (PLAIN.encode(w, add_special_tokens=False).ids for w in ("red", "fox"))
    assert sorted(one[0].ids) == sorted([*red, *fox, 1, *fox, 1, 1])


def test_repeated_rows_and_empty_table(spark):
    d = docs(spark, ["red fox"])
    assert P.pack_documents(d.union(d).union(d), capacity=16).count() == 3
    assert P.pack_documents(d.limit(0)).count() == 0


def searched(lengths, capacity, seed=1):
    rng = random.Random(seed)
    found = P.start(lengths, capacity, rng)
    for _ in range(P.EPOCHS):
        found = P.evolve(found, lengths, capacity, P.GENERATIONS, rng)
    best = found[0]
    assert sorted(x for b in best for x in b) == list(range(len(lengths))) and all(sum(lengths[x] for x in b) <= capacity for b in best)
    return len(best)


def by_best_fit(lengths, capacity):
    return len(P.best_fit([], sorted(range(len(lengths)), key=lambda x: -lengths[x]), lengths, capacity))


def test_the_search_beats_best_fit_where_pieces_fit_badly():
    rng = random.Random(1)
    thirds = [rng.randint(1229, 1843) for _ in range(3000)]  # 30 to 45 % of a sequence
    assert searched(thirds, 4096) <= 0.97 * by_best_fit(thirds, 4096)
    wide = [rng.randint(1024, 2252) for _ in range(3000)]
    assert searched(wide, 4096) <= 0.96 * by_best_fit(wide, 4096)


def test_generations_beat_the_first_population():
    """Pieces cut from 300 full bins, three of each."""
    rng = random.Random(2)
    lengths = [x for _ in range(300) for a in [rng.randint(250, 400)] for b in [rng.randint(250, 400)] for x in (a, b, 1000 - a - b)]
    rng.shuffle(lengths)
    first = min(map(len, P.first_population(lengths, 1000, P.POPULATION, random.Random(3))))
    found = searched(lengths, 1000)
    assert 300 <= found <= 303 and found < first < by_best_fit(lengths, 1000)


def optimum(lengths, capacity):
    """The fewest bins, by trying every bin for every piece."""
    lengths = sorted(lengths, reverse=True)
    best = len(lengths)

    def put(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + lengths[i] <= capacity and bins[k] not in bins[:k]:
                put(i + 1, [*bins[:k], bins[k] + lengths[i], *bins[k + 1 :]])
        put(i + 1, [*bins, lengths[i]])

    put(0, [])
    return best


def test_small_cases_reach_the_optimum():
    rng, found, best, fit = random.Random(4), 0, 0, 0
    for _ in range(60):
        lengths = [rng.randint(15, 60) for _ in range(rng.randint(3, 11))]
        want, got = optimum(lengths, 100), searched(lengths, 100)
        assert P.bound(lengths, 100) <= want <= got
        found, best, fit = found + got, best + want, fit + by_best_fit(lengths, 100)
    assert found <= best + 1 and found <= fit
