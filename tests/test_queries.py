"""Every query with SQL against DuckDB on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from docsift.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def plain(v):
    return round(float(v), 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_equals_duckdb(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = duck.execute(registry.SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == cols
    rows = sorted((str([plain(r[names.index(c)]) for c in cols]) for r in want.fetchall()))
    assert sorted(str([plain(r[c]) for c in cols]) for r in df.collect()) == rows


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_store_search_shuffles_and_hashes_only_what_it_stores(spark, tmp_path, monkeypatch):
    # ids below 0, documents without a vector or text, a vector without its document
    texts = {i: None if i == 4 else f"The nation {'of ' * (i % 5)}with item {i} " + "ing " * (i % 3) for i in range(-7, 40)}
    vectors = {i: [math.cos(i + j) for j in range(64)] for i in (*range(-5, 20), 77)}
    spark.createDataFrame([(i, t, f"src{i % 4}") for i, t in texts.items()], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    batches, add = [], registry.store.add_chunks
    monkeypatch.setattr(registry.store, "add_chunks", lambda rows, *rest: batches.append(rows) or add(rows, *rest))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = [tuple(r) for r in registry.store_search(spark, str(tmp_path)).collect()]
        for rows in batches:
            above, below = rows._jdf.queryExecution().executedPlan().toString().split("SortMergeJoin", 1)
            assert "sha1(" in above and "sha1(" not in below
            assert below.index("Exchange hashpartitioning(id") < below.index("LeftSemi")
        assert sorted(r.id for rows in batches for r in rows.select("id").collect()) == list(range(-5, 20))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    want = c.execute(registry.SQL["store_search"]).fetchall()
    assert len(got) == 8 and [(*r[:2], round(r[2], 6)) for r in got] == [(*r[:2], round(r[2], 6)) for r in want]
