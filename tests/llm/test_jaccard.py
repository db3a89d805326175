"""op11 against all pairs by brute force."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docsift.llm import jaccard
from docsift.llm.jaccard import at_most, bitmap, joined, links, needed
from docsift.llm.minhash import shingle_hashes
from docsift.llm.q_jaccard import op11_ngram_jaccard_join
from tests.llm.helpers import docs
from tests.llm.test_minhash import brute, corpus, edited

SF = "/root/testdata/sf0.001"


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


@pytest.mark.parametrize("seed,percent", [(1, 85), (2, 85), (3, 60)])
def test_agrees_with_all_pairs(spark, seed, percent):
    texts = corpus(seed)
    assert result(joined(docs(spark, texts), 4, percent)) == brute(texts, 4, percent)


@pytest.mark.parametrize("block", [2, 4, 1024])
def test_tiles_find_what_hubs_do_not(spark, monkeypatch, block):
    """Lists of more than two nodes go to hubs and tiles."""
    monkeypatch.setattr(jaccard, "LIST", 2)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = random.Random(block)
    texts = corpus(4, near=50, shared=30)
    # a chain: neighbours are alike, ends are not; and sets of all sizes from one text
    words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    for _ in range(12):
        texts.append(" ".join(words))
        words = edited(rng, words, 3)
    texts += [" ".join(words[:n]) for n in range(40, 200, 7)]
    assert result(joined(docs(spark, texts), 4, 85)) == brute(texts, 4, 85)


def test_all_links_between_different_sets(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "LIST", 3)
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    texts = corpus(5, near=40, shared=20)
    found, members = links(docs(spark, texts), 4, 85)
    node = {r.doc_id: r.node for r in members.collect()}
    sets = {i: set(shingle_hashes(t, 4).tolist()) for i, t in enumerate(texts)}
    want = set()
    for i in node:
        for j in node:
            if node[i] < node[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                want.add((node[i], node[j]))
    got = [(r.a, r.b) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 20


def test_table_equals_all_pairs(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    ids = [r.doc_id for r in rows]
    want = {ids[i]: (n, ids[c]) for i, (n, c) in brute([r.text for r in rows], 4, 85).items()}
    df = op11_ngram_jaccard_join(spark, SF)
    assert df.columns == ["doc_id", "n_shingles", "component_id"]
    assert result(df) == want


def test_odd_tables(spark):
    assert joined(docs(spark, []), 4, 85).collect() == []
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(None, words, 1, 2), (None, words, 1, 2), (4, words + " end", 1, 2), (4, None, 1, 2), (9, " \t", 1, 2), (7, "one two", 1, 2), (7, "ONE two", 1, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, node int, first int")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in joined(df, 4, 85).collect()), key=str)
    want = [(None, 57, 4), (None, 57, 4), (4, 58, 4), (4, 0, 4), (9, 0, 9), (7, 1, 7), (7, 1, 7)]
    assert got == sorted(want, key=str)


def test_sets_at_the_threshold(spark):
    """850 of 1,000 shingles is a link, 849 is not; both nested and with both sides different."""
    w = [f"w{i}" for i in range(2000)]
    texts = [" ".join(w[:1003]), " ".join(w[:853]), " ".join(w[1000:2000]), " ".join(w[1000:1848])]
    got = result(joined(docs(spark, texts), 4, 85))
    assert got == brute(texts, 4, 85) and got[1][1] == 0 and got[3][1] == 3


def test_a_very_long_text(spark):
    rng = random.Random(6)
    words = [f"w{rng.randrange(10**6)}" for _ in range(60_000)]
    texts = [" ".join(words), " ".join(edited(rng, words, 800)), " ".join(edited(rng, words, 4000))]
    assert result(joined(docs(spark, texts), 4, 85)) == brute(texts, 4, 85)


def test_sets_that_share_much_and_are_not_alike_make_no_rows(spark, monkeypatch):
    """Bitmaps tell them apart: hardly a whole set is fetched, however many meet in lists, even where the order ignores how common shingles are."""
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    monkeypatch.setattr(jaccard, "commonness", lambda *_: np.zeros(jaccard.COUNTERS, np.uint8))
    seen = []
    monkeypatch.setattr(jaccard, "_named", lambda t, b, p, f=jaccard._named: seen.append(f(t, b, p)) or seen[-1])
    rng = random.Random(7)
    runs = [" ".join(f"r{i}w{j}" for j in range(8)) for i in range(60)]
    texts = [" ".join(rng.sample(runs, 36)) for _ in range(120)]
    got = result(joined(docs(spark, texts), 4, 85))
    assert got == brute(texts, 4, 85) and len({c for _, c in got.values()}) == 120
    assert seen and seen[0].count() <= 12


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 2**63), min_size=1, max_size=300), st.sets(st.integers(0, 2**63), min_size=1, max_size=300), st.integers(50, 100))
def test_bitmaps_never_promise_too_little(a, b, percent):
    a, b = sorted(a), sorted(b | set(list(a)[: len(a) // 2]))
    x, y = np.array(a, np.uint64), np.array(b, np.uint64)
    p, q = bitmap(x), bitmap(y)
    u, v = jaccard._folded([p, q], min(len(p), len(q)))
    both = len(set(a) & set(b))
    assert at_most(u, len(a), v, len(b)) >= both
    if 100 * both >= percent * len(set(a) | set(b)):
        assert both >= max(needed(len(a), percent), needed(len(b), percent))
