from collections import Counter, defaultdict
from math import log

import pytest

from docsift.llm import mixing as M
from tests.llm.helpers import docs

SIZES = {"a": 200, "b": 40, "c": 10, None: 5}


def corpus(spark):
    texts, sources = [], []
    for s, n in SIZES.items():
        for i in range(n):
            texts.append(" ".join(["w"] * (1 + i % 7)))
            sources.append(s)
    return docs(spark, texts + [None, " "], sources + ["empty", "a"])


def tokens(rows):
    out = Counter()
    for r in rows:
        out[r.source] += r.tokens
    return out


def test_cover_shows_all_and_none_too_often(spark):
    d = corpus(spark)
    have = {r.doc_id: r.source for r in d.collect()}
    got = M.schedule(d, seed=1, repeats=3.0).collect()
    shown = Counter(r.doc_id for r in got)
    assert set(shown) == set(have) and max(shown.values()) <= 3
    total = {s: sum(1 + i % 7 for i in range(n)) for s, n in SIZES.items()}
    a = 1 - log(3) / log(max(total.values()) / min(total.values()))
    for s, n in tokens(got).items():
        if s in total:
            want = total[s] * (max(total.values()) / total[s]) ** (1 - a)
            assert want - 1 <= n <= want + 8


def test_exponent_for_entropy(spark):
    shares = [0.7, 0.2, 0.06, 0.04]
    df = spark.createDataFrame([(x,) for x in shares], "share double")
    a = M.solve_exponent(df, 0.8, None, None)

    def entropy(a):
        z = sum(p**a for p in shares)
        return -sum(p**a / z * log(p**a / z) for p in shares)

    assert abs(entropy(a) - 0.8 * log(4)) < 1e-6
    assert M.solve_exponent(df, 1.0, None, None) == 0.0
    assert M.solve_exponent(df, None, 1.0, None) == 1.0


def test_budget_is_kept_and_blocks_are_permutations(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_ROWS", 16)
    d = corpus(spark)
    got = M.schedule(d, seed=2, entropy=1.0, budget=1000).collect()
    w = {r.source: r.weight for r in got}
    assert abs(sum(w.values()) - 1) < 1e-9
    for s, n in tokens(got).items():
        if s != "empty":
            assert w[s] * 1000 - 1 <= n <= w[s] * 1000 + 8  # the row that crosses the budget's end is in
    slots, epochs = defaultdict(list), defaultdict(Counter)
    for r in got:
        slots[r.source, r.epoch, r.block].append(r.slot)
        epochs[r.source, r.epoch][r.doc_id] += 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert all(max(c.values()) == 1 for c in epochs.values())
    # a full epoch shows every row of its source
    assert len(epochs["c", 0]) == 10 and ("c", 1) in epochs


@pytest.mark.parametrize("repeats", [1.0, 2.0])
def test_mixed_equals_schedule(spark, repeats):
    from pyspark.sql import functions as F

    d = corpus(spark).withColumns({"epoch": F.lit(1), "tokens": F.lit("x"), "blocks": F.lit(2)})
    mixed = M.mixed(d, seed=3, repeats=repeats)
    assert mixed.columns == d.columns
    assert Counter(r.doc_id for r in mixed.collect()) == Counter(r.doc_id for r in M.schedule(d, seed=3, repeats=repeats).collect())


def test_same_every_time_repeated_rows_and_empty_table(spark):
    d = corpus(spark)
    key = lambda x: sorted((r.doc_id, r.epoch, r.block, r.slot) for r in x.collect())
    assert key(M.schedule(d, seed=4, repeats=2.0)) == key(M.schedule(d.repartition(7), seed=4, repeats=2.0))
    assert M.schedule(d.union(d), seed=4, repeats=1.0).count() == 2 * d.count()
    assert M.schedule(d.limit(0), repeats=2.0).count() == 0


def spark_hash(*values):
    """Spark's xxhash64 of 32-bit integers, 64-bit ones, texts and nulls, in Python."""
    import xxhash

    h = 42
    for kind, v in values:
        if v is not None:
            raw = v.encode() if kind == "s" else int(v).to_bytes(4 if kind == "i" else 8, "little", signed=True)
            h = xxhash.xxh64_intdigest(raw, seed=h)
    return h - 2**64 if h >= 2**63 else h


def brute_schedule(rows, seed, repeats, block_rows):
    """(doc_id, epoch, block, slot) by the definition, for rows (doc_id, source, tokens)."""
    total = Counter()
    for _, s, n in rows:
        total[s] += n
    full = {s: n for s, n in total.items() if n}
    every, hi, lo = sum(full.values()), max(full.values()), min(full.values())
    low, high = 0.0, 1.0
    for _ in range(M.ROUNDS):
        grid = [low + (high - low) * i / M.GRID for i in range(M.GRID + 1)]
        first = next(i for i, a in enumerate(grid) if (hi / lo) ** (1 - a) <= repeats * (1 + 1e-12))
        low, high = grid[max(0, first - 1)], grid[first]
        if not first:
            break
    a, out = high, []
    z = sum((n / every) ** a for n in full.values())
    for source in total:
        own = [(d, n, spark_hash(("i", seed), ("l", d), ("l", n))) for d, s, n in rows if s == source]
        blocks, tokens = -(-len(own) // block_rows), total[source]
        budget = max(tokens, round((tokens / every) ** a / z * every * (hi / every) ** (1 - a) * z)) if tokens else 0
        epochs = budget // tokens if tokens else 1
        block_order = lambda e, b: (spark_hash(("i", seed + 1), ("i", e), ("s", source), ("l", b)), b)
        row_order = lambda e, r: (spark_hash(("i", seed + 2), ("i", e), ("l", r[2])), r[2])
        rest = budget - epochs * tokens if tokens else 0
        for e in range(epochs + (rest > 0)):
            left = rest if e == epochs else None
            for b in sorted({r[2] % blocks for r in own}, key=lambda b: block_order(e, b)):
                inside = sorted((r for r in own if r[2] % blocks == b), key=lambda r: row_order(e, r))
                for slot, r in enumerate(inside):
                    if left is None or left > 0:
                        out.append((r[0], e, b, slot))
                        left = None if left is None else left - r[1]
    return sorted(out)


@pytest.mark.parametrize("seed, repeats, block_rows", [(7, 2.0, 16), (8, 3.5, 4096), (9, 1.0, 7)])
def test_schedule_equals_brute_force(spark, monkeypatch, seed, repeats, block_rows):
    monkeypatch.setattr(M, "BLOCK_ROWS", block_rows)
    d = corpus(spark)
    rows = [(r.doc_id, r.source, len((r.text or "").split())) for r in d.collect()]
    got = sorted((r.doc_id, r.epoch, r.block, r.slot) for r in M.schedule(d, seed=seed, repeats=repeats).collect())
    assert got == brute_schedule(rows, seed, repeats, block_rows)


def test_very_long_text_counts_whole(spark):
    d = docs(spark, ["w " * 400_000, "x " * 10], ["a", "b"])
    got = {r.doc_id: r.tokens for r in M.schedule(d, repeats=2.0).where("epoch = 0").collect()}
    assert got == {0: 400_000, 1: 10}


def _weights(shares, a):
    z = sum(p**a for p in shares)
    return [p**a / z for p in shares]


@pytest.mark.parametrize("target", [0.9, 0.5, 0.2, 0.05])
def test_entropy_by_brute_force(spark, target):
    """Exponents below and above 1; the least that meets the target, found by halving alone."""
    shares = [0.5, 0.3, 0.15, 0.05]
    got = M.solve_exponent(spark.createDataFrame([(x,) for x in shares], "share double"), target, None, None)
    entropy = lambda a: -sum(w * log(w) for w in _weights(shares, a) if w) / log(4)
    low, high = 0.0, 64.0
    for _ in range(200):
        low, high = (low, (low + high) / 2) if entropy((low + high) / 2) <= target else ((low + high) / 2, high)
    assert abs(got - high) < 1e-6 and (got > 1) == (target < entropy(1))


def test_targets_that_cannot_be_met_are_refused(spark):
    frame = lambda *x: spark.createDataFrame([(v,) for v in x], "share double")
    with pytest.raises(M.Unmet, match="entropy of 0.2"):
        M.solve_exponent(frame(0.5, 0.5), 0.2, None, None)
    with pytest.raises(M.Unmet, match="at most 2.0 times"):
        M.schedule(corpus(spark), repeats=2.0, budget=5 * 1000)
    with pytest.raises(M.Unmet, match="more than 1.5 times"):
        M.solve_exponent(frame(0.7, 0.3), 0.3, 1.5, None)


@pytest.mark.parametrize(("entropy", "budget"), [(0.6, None), (0.2, None), (0.2, 900), (0.9, 500), (0.5, 2000)])
def test_tokens_by_entropy_and_budget_by_brute_force(spark, entropy, budget):
    d = corpus(spark)
    total = {s: sum(1 + i % 7 for i in range(n)) for s, n in SIZES.items()}
    every = sum(total.values())
    shares = [n / every for n in total.values()]
    low, high = 0.0, 64.0
    for _ in range(200):
        a = (low + high) / 2
        e = -sum(w * log(w) for w in _weights(shares, a) if w) / log(len(shares))
        low, high = (low, a) if e <= entropy else (a, high)
    w = dict(zip(total, _weights(shares, high)))
    whole = budget or max(total[s] / w[s] for s in total)
    got = M.schedule(d, seed=6, entropy=entropy, budget=budget).collect()
    shown = tokens(got)
    for s in total:
        # the row that crosses the budget's end is in; exponents agree to a billionth
        want = w[s] * whole
        assert want - 1 - 1e-4 * want <= shown[s] <= want + 8 + 1e-4 * want, s
    if not budget:
        assert {r.doc_id for r in got} == {r.doc_id for r in d.collect()}
