"""An inverted-file index of vectors: lists around centroids, as folders that a search prunes.

Centroids are fitted by k-means on a bounded sample; every vector is then placed in the
list of its nearest centroid, and lists are folders of a Parquet table.  A search
opens the lists whose centroids are nearest to its query and is exact within them; with
``probes=None`` it opens all of them and is exact.  How many lists reach a recall
depends on the vectors, so ``probes_for`` measures it, against a scan of all of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docsift.operators.retrieval import dense_top_k

#: Vectors that centroids are fitted on, about; and most lists.
SAMPLE, MOST_LISTS = 100_000, 4096
#: Vectors whose neighbours are looked up to measure recall, at most.
QUERIES = 64
#: Vectors of a list in one file, about.
FILE_ROWS = 200_000


def usable(vector: F.Column, dim: int) -> F.Column:
    """Of the index's length, without nulls or numbers that are not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) == dim) & ~bad, F.lit(False))


def centroids(vectors: DataFrame, key: str, vector: str, dim: int, lists: int | None = None, sample: int = SAMPLE, seed: int = 7) -> np.ndarray:
    """Centroids, one a row, of about ``sample`` vectors that a hash of their keys picks; by default as many as the root of the number of vectors."""
    ok = vectors.where(usable(F.col(vector), dim))
    n = ok.count()
    if not n:
        return np.zeros((1, dim))
    lists = lists or min(MOST_LISTS, max(1, math.isqrt(n)))
    some = ok.where(F.pmod(F.xxhash64(key), F.lit(max(1, n // sample))) == 0)
    fit = some.select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    model = KMeans(k=max(2, lists), seed=seed, maxIter=10, initMode="k-means||").fit(fit)
    return np.vstack(model.clusterCenters())


def placed(vectors: DataFrame, vector: str, centres: np.ndarray, to: str = "list") -> DataFrame:
    """Adds the number of each vector's nearest centroid; rows without a usable vector go.

    Centroids are broadcast: no more than MOST_LISTS.
    """
    held = vectors.sparkSession.sparkContext.broadcast((centres, (centres * centres).sum(axis=1)))

    @F.pandas_udf("int")
    def nearest(v: pd.Series) -> pd.Series:
        c, square = held.value
        if not len(v):
            return pd.Series([], dtype="int32")
        return pd.Series((square - 2 * np.vstack(v.to_numpy()) @ c.T).argmin(axis=1).astype(np.int32))

    ok = vectors.where(usable(F.col(vector), centres.shape[1]))
    return ok.withColumn(to, nearest(F.col(vector).cast("array<double>")))


def write(vectors: DataFrame, key: str, vector: str, centres: np.ndarray, at: str) -> None:
    """key, vector in a folder for each list.  A list that a third of all vectors are in is several files, written by several tasks."""
    rows = placed(vectors.select(F.col(key).alias("key"), F.col(vector).alias("vector")), "vector", centres)
    share = F.pmod(F.xxhash64("key"), F.lit(max(1, vectors.count() // FILE_ROWS)))
    rows.repartition("list", share).write.mode("overwrite").partitionBy("list").parquet(at)


def save(spark: SparkSession, centres: np.ndarray, at: str) -> None:
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "list int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(at)


def load(spark: SparkSession, at: str) -> np.ndarray:
    return np.array([r["centre"] for r in spark.read.parquet(at).orderBy("list").collect()])  # no more than MOST_LISTS


def probed(centres: np.ndarray, query: list[float], probes: int) -> list[int]:
    """The lists whose centroids are nearest to the query."""
    q = np.asarray(query, np.float64)
    return np.argsort(((centres - q) ** 2).sum(axis=1), kind="stable")[:probes].tolist()


def top_k(index: DataFrame, centres: np.ndarray, query: list[float], k: int = 30, probes: int | None = 8) -> DataFrame:
    """key, score: the k highest inner products in the lists probed (None: all, so exact); other lists are not opened."""
    some = index if probes is None else index.where(F.col("list").isin(probed(centres, query, probes)))
    return dense_top_k(some, "key", "vector", query, k)


def neighbours(index: DataFrame, queries: np.ndarray, k: int) -> DataFrame:
    """query (a row's number), key, list, score: each query's k best of all vectors, in one scan."""
    held = index.sparkSession.sparkContext.broadcast(queries)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = None
        for b in batches:
            if not len(b):
                continue
            score = np.round(np.vstack(b["vector"].to_numpy()).astype(np.float64) @ held.value.T, 5)
            n, m = score.shape
            new = pd.DataFrame({"query": np.tile(np.arange(m, dtype=np.int32), n), "key": np.repeat(b["key"].to_numpy(), m), "list": np.repeat(b["list"].to_numpy(np.int32), m), "score": score.ravel()})
            new = new[(score >= np.partition(score, max(0, n - k), axis=0)[max(0, n - k)]).ravel()]
            best = (new if best is None else pd.concat([best, new])).sort_values(["query", "score", "key"], ascending=[True, False, True]).groupby("query").head(k)
        if best is not None:
            yield best

    found = index.select("key", "vector", "list").mapInPandas(rows, f"query int, key {index.schema['key'].dataType.simpleString()}, list int, score double")
    order = W.partitionBy("query").orderBy(F.desc("score"), "key")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank")


def probes_for(index: DataFrame, centres: np.ndarray, recall: float = 0.95, k: int = 10) -> int:
    """The fewest lists that hold ``recall`` of the k best, on average over up to QUERIES vectors of the index."""
    n = index.count()
    some = index.where(F.pmod(F.xxhash64("key", F.lit(1)), F.lit(max(1, n // QUERIES))) == 0).orderBy("key").limit(QUERIES)
    queries = [r["vector"] for r in some.select("vector").collect()]
    if not queries:
        return 1
    q = np.array(queries, np.float64)
    place = ((q[:, None, :] - centres[None, :, :]) ** 2).sum(axis=2).argsort(axis=1, kind="stable").argsort(axis=1)
    at = np.array([place[r["query"], r["list"]] for r in neighbours(index, q, k).select("query", "list").collect()])  # QUERIES * k rows
    held = np.cumsum(np.bincount(at, minlength=len(centres))) / len(at)
    return int(np.argmax(held >= recall)) + 1
