import random
from collections import defaultdict

import numpy as np
import pytest

from docsift.llm.minhash import components, near_duplicates, needed, overlaps, shingle_hashes
from tests.llm.helpers import docs


def brute(texts, width=4, percent=80):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} - {()})
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (len(sets[i]), find(i)) for i in range(len(texts))}


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"x{rng.randrange(10**9)}"
    return out


def corpus(seed, near=90, shared=70):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    base = [word() for _ in range(120)]
    texts = [" ".join(edited(rng, base, rng.choice([0, 1, 2, 3, 4, 6, 9]))) for _ in range(near)]
    passage = [word() for _ in range(50)]
    texts += [" ".join([word() for _ in range(60)] + passage + [word() for _ in range(20)]) for _ in range(shared)]
    texts += [None, "", "  \n", "one two", "One TWO", "a b c d", "a b c d e", "a b c d e f", "copy me now please"] + ["copy me now please"] * 5
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_agrees_with_all_pairs(spark, seed):
    texts = corpus(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs(spark, texts), 4, 80).collect()}
    assert got == brute(texts)


@pytest.mark.parametrize("sketch", [128, 24, None])
def test_long_lists_are_searched_beyond_their_hub(spark, monkeypatch, sketch):
    import docsift.llm.minhash as m

    monkeypatch.setattr(m, "LIST", 2)
    monkeypatch.setattr(m, "BLOCK", 4)
    texts = corpus(3, near=60, shared=30)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs(spark, texts), 4, 80, sketch).collect()}
    assert got == brute(texts)


def test_nested_sets_meet_in_long_lists(spark):
    rng = random.Random(20)
    words = [f"w{rng.randrange(10**9)}" for _ in range(1253)]
    cut, whole = (shingle_hashes(" ".join(w), 4) for w in (words[:1003], words))
    assert (len(cut), len(whole)) == (1000, 1250)
    windows = {int(shingle_hashes(" ".join(words[i : i + 4]), 4)[0]): words[i : i + 4] for i in range(1250)}
    # 150 others hold what heads the longer list of values, so no list of both is short
    head = [windows[int(h)] for h in whole[:40]]
    fillers = [" ".join(w for k, run in enumerate(head) for w in [*run, f"f{i}x{k}"]) for i in range(150)]
    texts = [" ".join(words[:1003]), " ".join(words), *fillers]
    got = {r.doc_id: r.component_id for r in near_duplicates(docs(spark, texts), 4, 80).collect()}
    assert got == {0: 0, 1: 0} | {i: i for i in range(2, 152)}


def test_repeated_rows_nulls_and_other_columns(spark):
    from pyspark.sql import functions as F

    d = docs(spark, ["a b c d e", "a b c d e", None]).withColumns({"node": F.lit("x"), "kept": F.lit(1)})
    d = d.union(d).union(d.limit(0))
    got = sorted(tuple(r) for r in near_duplicates(d, 4).collect())
    assert got == [(0, 2, 0, True)] * 2 + [(1, 2, 0, False)] * 2 + [(2, 0, 2, True)] * 2


def test_empty_table(spark):
    assert near_duplicates(docs(spark, ["a"]).limit(0)).count() == 0


def counted(monkeypatch):
    """Rows of each table that is written on the way."""
    import docsift.llm.minhash as m

    made, write = {}, m.staged

    def staged(df, name):
        out = write(df, name)
        made[name] = made.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(m, "staged", staged)
    return made


def test_a_passage_shared_by_many_makes_no_pairs(spark, monkeypatch):
    made, rng = counted(monkeypatch), random.Random(7)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [" ".join(f"w{rng.randrange(10**9)}" for _ in range(100)) + " " + passage for _ in range(2000)]
    got = near_duplicates(docs(spark, texts), 4, 80)
    assert got.where("kept").count() == 2000
    assert made["pairs"] + made.get("units", 0) < 2000


def test_many_near_copies_make_pairs_in_proportion(spark, monkeypatch):
    made, rng = counted(monkeypatch), random.Random(8)
    base = [f"w{i}" for i in range(150)]
    texts = [" ".join(edited(rng, base, rng.choice([0, 1, 2, 3, 12]))) for _ in range(2000)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs(spark, texts), 4, 80).collect()}
    assert made["pairs"] < 30 * 2000 and made["units"] < 200 and made["verified"] < 30 * 2000
    # equal texts are settled by the smaller group
    small = {t: i for i, t in reversed(list(enumerate(texts)))}
    want = brute(list(small))
    first = dict(zip(range(len(small)), small.values()))
    of = {t: first[want[k][1]] for k, t in enumerate(small)}
    least = {}
    for t, c in of.items():
        least[c] = min(least.get(c, 1 << 60), small[t])
    assert {i: c for i, (_, c) in got.items()} == {i: least[of[t]] for i, t in enumerate(texts)}


def test_overlaps_are_intersections():
    rng = np.random.default_rng(3)
    x, y = ([np.unique(rng.integers(0, 300, rng.integers(1, 80)).astype(np.uint64)) for _ in range(n)] for n in (7, 11))
    assert overlaps(x, y).tolist() == [[len(np.intersect1d(a, b)) for b in y] for a in x]
    far = [np.arange(5000 * i, 5000 * i + 9000, dtype=np.uint64) for i in range(5)]
    assert overlaps(far, far)[0].tolist() == [9000, 4000, 0, 0, 0]


@pytest.mark.parametrize("share", [0.78, 0.8, 0.82])
@pytest.mark.parametrize("n", [90, 150, 1000])
@pytest.mark.parametrize("nested", [False, True])
def test_sketches_of_like_sets_keep_what_is_needed(share, n, nested):
    rng = np.random.default_rng(int(n * share) + nested)
    for _ in range(400):
        if nested:
            big = rng.integers(0, 1 << 63, int(n / share), np.int64).astype(np.uint64)
            a, b = np.sort(big[:n]), np.sort(big)
        else:
            both = -(-2 * n * share // (1 + share))
            big = rng.integers(0, 1 << 63, int(2 * n - both), np.int64).astype(np.uint64)
            a, b = np.sort(big[:n]), np.sort(big[-n:])
        met = len(np.intersect1d(a, b)) / len(big)
        if met >= 0.8:
            assert len(np.intersect1d(a[:128], b[:128])) >= max(needed(len(a), 80, 128), needed(len(b), 80, 128))


def test_null_ids_and_ids_with_two_texts(spark):
    t = "a b c d e f g h i j k l m n"
    d = spark.createDataFrame([(None, t), (5, t + " o"), (5, "x y z x y z"), (None, "q r s t u v"), (None, "q r s t u v"), (None, None)], "doc_id long, text string")
    got = sorted((tuple(r) for r in near_duplicates(d, 4).collect()), key=str)
    assert got == sorted([(None, 11, 5, False), (5, 12, 5, True), (5, 3, 5, True), (None, 3, None, True), (None, 3, None, True), (None, 0, None, True)], key=str)


def test_very_long_text(spark):
    words = [f"w{i}" for i in range(60_000)]
    texts = [" ".join(words), " ".join(words[:50_000]), " ".join(words[:40_001]), "q" * 2_000_000]
    assert [r.component_id for r in near_duplicates(docs(spark, texts), 5, 80).orderBy("doc_id").collect()] == [0, 0, 0, 3]


def test_shingles_split_on_ascii_space_only():
    assert len(shingle_hashes("a b c d e", 4)) == 1
    assert len(shingle_hashes("a\x0bb\tc d e", 4)) == 2


def test_components_of_chains_and_stars(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    rng.shuffle(edges)
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    want = {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}
    assert got == want
    groups = defaultdict(set)
    for k, v in got.items():
        groups[v].add(k)
    assert len(groups) == 2
