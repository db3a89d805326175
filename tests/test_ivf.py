"""The inverted-file index: recall, exact mode, and what a search opens."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from docsift.operators import ivf
from docsift.operators.retrieval import dense_top_k

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("ivf"))
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    centres = ivf.centroids(vectors, "vec_id", "embedding", 64)
    ivf.write(vectors, "vec_id", "embedding", centres, f"{at}/vectors")
    ivf.save(spark, centres, f"{at}/centres")
    return spark.read.parquet(f"{at}/vectors"), ivf.load(spark, f"{at}/centres"), vectors


def test_recall_at_ten(spark, index):
    """Every twentieth vector as a query: the share of its ten best in as many lists as other vectors were measured to need."""
    rows, centres, vectors = index
    probes = ivf.probes_for(rows, centres)
    assert 1 <= probes < len(centres)
    data = {r["vec_id"]: np.array(r["embedding"], np.float64) for r in vectors.collect()}
    ids = np.array(sorted(data))
    matrix = np.vstack([data[i] for i in ids])
    of = {r["key"]: r["list"] for r in rows.select("key", "list").collect()}
    assert set(of) == set(data)  # every vector is in a list
    place = np.array([of[i] for i in ids])
    found = total = 0
    for i in ids[ids % 20 == 0]:
        score = matrix @ data[i]
        best = np.argsort(-score, kind="stable")[:10]
        found += np.isin(place[best], ivf.probed(centres, data[i], probes)).sum()
        total += 10
    assert found / total >= 0.9, found / total
    # the search itself returns just what its lists hold
    q = data[0].tolist()
    got = [r["key"] for r in ivf.top_k(rows, centres, q, 10, probes).collect()]
    inside = np.isin(place, ivf.probed(centres, q, probes))
    want = ids[inside][np.lexsort((ids[inside], -np.round(matrix[inside] @ data[0], 5)))][:10]
    assert got == want.tolist()


def test_neighbours_equal_a_scan(index):
    rows, _, vectors = index
    some = vectors.where("vec_id in (3, 8)").orderBy("vec_id").collect()
    got = ivf.neighbours(rows, np.array([r["embedding"] for r in some], np.float64), 10)
    for i, r in enumerate(some):
        want = [tuple(x) for x in dense_top_k(vectors, "vec_id", "embedding", r["embedding"], 10).collect()]
        assert [(x["key"], x["score"]) for x in got.where(F.col("query") == i).orderBy(F.desc("score"), "key").collect()] == want


def test_exact_mode_equals_a_scan(index):
    rows, centres, vectors = index
    q = vectors.where("vec_id = 7").first()["embedding"]
    want = [tuple(r) for r in dense_top_k(vectors, "vec_id", "embedding", q, 30).collect()]
    assert [tuple(r) for r in ivf.top_k(rows, centres, q, 30, probes=None).collect()] == want


def test_lists_are_pruned(index):
    rows, centres, vectors = index
    q = vectors.where("vec_id = 7").first()["embedding"]
    plan = ivf.top_k(rows, centres, q, 10, probes=3)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*list.* IN", plan)
    opened = rows.where(F.col("list").isin(ivf.probed(centres, q, 3))).select(F.input_file_name()).distinct().count()
    assert 0 < opened <= 3 * len(rows.inputFiles()) / len(centres) + 3


def test_odd_vectors_and_tables(spark, tmp_path):
    schema = "vec_id long, embedding array<float>, list int"
    df = spark.createDataFrame([(1, [1.0, 0.0], 5), (2, None, 5), (3, [1.0, None], 5), (4, [float("nan"), 1.0], 5), (5, [1.0], 5), (6, [0.0, 1.0], 5), (6, [0.0, 1.0], 5)], schema)
    centres = ivf.centroids(df, "vec_id", "embedding", 2)
    ivf.write(df, "vec_id", "embedding", centres, str(tmp_path / "v"))
    rows = spark.read.parquet(str(tmp_path / "v"))
    assert [tuple(r) for r in ivf.top_k(rows, centres, [1.0, 0.2], 5, None).collect()] == [(1, 1.0), (6, 0.2), (6, 0.2)]
    assert ivf.probes_for(rows, centres) in (1, 2)
    none = spark.createDataFrame([], schema)
    assert ivf.centroids(none, "vec_id", "embedding", 2).shape == (1, 2)
