"""Block-max postings and membership filters."""

import math
import random

import pytest
from pyspark.sql import functions as F

from docsift.operators import bm25, dedup, membership, postings


def corpus(n=400):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(200)]
    out = []
    for i in range(n):
        text = " ".join(rng.choices(words, k=rng.randrange(5, 60)))
        # a cluster of texts that say the query's words often
        out.append((i, text + (" pump valve pump" * (i % 7) if 160 <= i < 176 else " pump" if i % 5 == 0 else "")))
    return [*out, (n, ""), (n + 1, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), "doc_id long, text string").cache()


@pytest.mark.parametrize("query", ["pump valve", "pump pump", "w1 w2 zzz", "zzz", ""])
def test_equals_a_scan(spark, docs, tmp_path, query):
    stats = postings.Statistics(0, 0)
    for i in range(3):  # a build and two appends
        stats += postings.write(docs.where(F.col("doc_id") % 3 == i), "doc_id", "text", f"{tmp_path}/p/batch={i}")
    want = [(r[0], r[1]) for r in bm25.top_k(docs, "doc_id", "text", query, 20).where("score > 0").collect()]
    index = spark.read.parquet(f"{tmp_path}/p")
    assert stats.texts == 402
    assert [tuple(r) for r in postings.top_k(index, stats, query, 20).collect()] == want


def test_blocks_below_the_kth_score_are_not_read(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "SPAN", 16)
    monkeypatch.setattr(postings, "FIRST", 1)
    stats = postings.write(docs, "doc_id", "text", str(tmp_path / "p"))
    s = postings.Search.of(spark.read.parquet(str(tmp_path / "p")), stats, "pump valve")
    first, rest = s.wanted(5)
    every = s.bounds().count()
    assert every == math.ceil(400 / 16) and len(first) + rest.count() <= 3
    want = [(r[0], r[1]) for r in bm25.top_k(docs, "doc_id", "text", "pump valve", 5).collect()]
    assert [tuple(r) for r in s.top_k(5).collect()] == want
    # more blocks than literals: by a join, with the same result
    monkeypatch.setattr(postings, "LITERALS", 0)
    assert [tuple(r) for r in s.top_k(40).collect()] == [(r[0], r[1]) for r in bm25.top_k(docs, "doc_id", "text", "pump valve", 40).collect()]


def test_bounds_hold(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "SPAN", 16)
    stats = postings.write(docs, "doc_id", "text", str(tmp_path / "p"))
    s = postings.Search.of(spark.read.parquet(str(tmp_path / "p")), stats, "pump w3 w4")
    bound = {r["block"]: r["bound"] for r in s.bounds().collect()}
    assert all(r["score"] <= bound[r["key"] // 16] + 1e-6 for r in s.scored(s.found).collect())


def test_only_texts_are_shuffled(docs):
    plan = postings.blocks(docs, "doc_id", "text")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "hashpartitioning(block" in plan


@pytest.mark.parametrize("query", ["pump valve", "pump pump", "zzz"])
def test_index_of_lists_equals_a_scan(spark, docs, tmp_path, query):
    named = docs.select(F.concat(F.lit("d"), F.lpad("doc_id", 4, "0")).alias("name"), "text")
    bm25.build_index(named, "name", "text", str(tmp_path / "i"))
    want = [tuple(r) for r in bm25.top_k(named, "name", "text", query, 20).where("score > 0").collect()]
    assert [tuple(r) for r in bm25.search_index(spark, str(tmp_path / "i"), "name", query, 20).collect()] == want
    # a row for each word of a batch, not for each posting
    index = spark.read.parquet(str(tmp_path / "i/postings"))
    assert index.where("term = 'pump'").count() <= docs.rdd.getNumPartitions() and index.where("term = 'pump'").selectExpr("sum(size(keys))").first()[0] > 80


def test_rows_of_one_key_have_postings_of_their_own(spark):
    rows = spark.createDataFrame([(1, "Pump pump"), (1, "pump X"), (300, "pump"), (7, None)], "k long, t string")
    got = sorted((r.term, r.block, r.n, r.total, r.most, r.least, list(zip(r["keys"], r.tfs, r.dls))) for r in postings.blocks(rows, "k", "t").collect())
    got = [(*r[:-1], sorted(r[-1])) for r in got]
    assert got == [("pump", 0, 2, 3, 2, 2, [(1, 1, 2), (1, 2, 2)]), ("pump", 1, 1, 1, 1, 1, [(300, 1, 1)]), ("x", 0, 1, 1, 1, 2, [(1, 1, 2)])]


def test_filters_hold_all_and_little_else(spark):
    old = spark.range(30_000).select(F.sha1(F.col("id").cast("string")).alias("h"))
    new = spark.range(29_000, 60_000).select(F.sha1(F.col("id").cast("string")).alias("h"))
    filters = membership.filter_of(old, "h", 30_000)
    assert filters.count() == membership.shards_for(30_000) > 1
    maybe = membership.possible(new, "h", filters)
    assert maybe.join(old, "h", "left_semi").count() == 1000
    assert maybe.count() <= 1000 + 0.01 * 30_000  # rows shuffled after it, of 31,000
    assert membership.possible(old, "h", filters).count() == 30_000


def test_filters_of_batches_merge(spark):
    part = lambda a, b: spark.range(a, b).select(F.col("id").cast("string").alias("h"))
    filters = membership.filter_of(part(0, 100), "h", 100).union(membership.filter_of(part(100, 50_000), "h", 49_900)).union(membership.filter_of(part(50_000, 50_050), "h", 50))
    assert membership.possible(part(0, 50_050), "h", filters).count() == 50_050
    assert membership.possible(part(60_000, 70_000), "h", filters).count() < 200
    nothing = membership.filter_of(part(0, 0), "h", 0)
    assert membership.possible(part(0, 10), "h", nothing).count() == 0


def test_append_with_filters_equals_append_without(spark, monkeypatch):
    rows = spark.createDataFrame([(i, f"text {i % 70}") for i in range(200)] + [(500, None), (501, "  ")], "doc_id long, text string")
    from docsift.functions.text import text_sha1

    known = rows.where("doc_id < 40").select(text_sha1(F.col("text")).alias("chunk_hash"))
    filters = membership.filter_of(known, "chunk_hash", 40)
    hashes = rows.select(text_sha1(F.col("text")).alias("chunk_hash"))
    want = sorted(tuple(r) for r in dedup.first_seen(rows, "text", ["doc_id"], known).collect())
    some = membership.known_among(hashes, "chunk_hash", known, filters)
    assert sorted(tuple(r) for r in dedup.first_seen(rows, "text", ["doc_id"], some).collect()) == want
    monkeypatch.setattr(membership, "MOST_BYTES", 1)
    assert membership.known_among(hashes, "chunk_hash", known, filters) is known


def test_rows_whose_key_others_have(spark, monkeypatch):
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(-3, 60)] + [(5, "again"), (None, "none")], "id long, text string")
    others = spark.createDataFrame([(i,) for i in (-2, 5, 5, 40, 99)] + [(None,)], "id long")
    found = membership.with_key_of(rows, "id", others)
    assert sorted(r.text for r in found.collect()) == ["again", "t-2", "t40", "t5"]
    assert "Exchange hashpartitioning(id" not in found._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[0]
    monkeypatch.setattr(membership, "KEYS", 3)  # more of them: the join that follows settles it
    assert membership.with_key_of(rows, "id", others) is rows
