"""Dense and hybrid search, gates, context building and citations."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docsift.functions.text import cited
from docsift.operators import bm25
from docsift.operators.models import Model, with_result


def dot(vector: Column, query: list[float]) -> Column:
    """Inner product in doubles with a fixed query vector."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return F.aggregate(F.zip_with(vector.cast("array<double>"), q, lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)


def dense_top_k(vectors: DataFrame, key: str, vector: str, query: list[float], k: int = 30, digits: int = 5) -> DataFrame:
    """Exact search: one scan, and the k best of each partition meet."""
    s = vectors.select(key, F.round(dot(F.col(vector), query), digits).alias("score"))
    return s.orderBy(F.desc("score"), key).limit(k)


def minmax(c: str, over: W | None = None) -> Column:
    """To [0, 1] over all rows (or a window); 0 where all values are equal."""
    w = over if over is not None else W.partitionBy()
    lo, hi = F.min(c).over(w), F.max(c).over(w)
    return F.when(hi == lo, 0.0).otherwise((F.col(c) - lo) / (hi - lo))


def l2_compat(score: Column) -> Column:
    """Squared distance of unit vectors in place of the product; reproduces an index that ranks by distance as if by likeness."""
    return 2 - 2 * score


def hybrid(dense: DataFrame, sparse: DataFrame, key: str, w_dense: float = 0.65, w_sparse: float = 0.35) -> DataFrame:
    """key, dense, bm25, mix from two candidate lists (key, score); at most both lists' rows."""
    d = dense.withColumn("dense", minmax("score")).select(key, "dense")
    positive = sparse.where("score > 0")
    top = F.max("score").over(W.partitionBy())
    s = positive.select(key, (F.col("score") / F.when(top > 0, top).otherwise(1.0)).alias("bm25"))
    joined = d.join(s, key, "full_outer").na.fill(0.0, ["dense", "bm25"])
    return joined.withColumn("mix", w_dense * F.col("dense") + w_sparse * F.col("bm25"))


def rerank(candidates: DataFrame, key: str, text: str, score: Callable[[pd.Series], pd.Series] | Model | None, top_n: int = 40, alpha: float = 0.7) -> DataFrame:
    """Adds rerank and final: the head is scored by a model, the tail keeps its mix; no model, no change.

    A ``Model`` is loaded once a worker; a plain function is sent with every task.
    """
    if score is None:
        return candidates.withColumns({"rerank": F.lit(None).cast("double"), "final": F.col("mix")})
    place = F.row_number().over(W.orderBy(F.desc("mix"), key))  # of a candidate list, not of a corpus
    head = (F.col("_place") <= top_n) & (F.coalesce(F.col(text), F.lit("")) != "")
    placed = candidates.withColumn("_place", place)
    if isinstance(score, Model):
        out = with_result(placed.withColumn("_asked", F.when(head, F.col(text))), "_asked", score, "_raw").drop("_asked")
    else:
        model = F.pandas_udf(score, "double")
        out = placed.withColumn("_raw", F.when(head, model(F.when(head, F.col(text)))))
    lo, hi = F.min("_raw").over(W.partitionBy()), F.max("_raw").over(W.partitionBy())
    out = out.withColumn("rerank", F.when(F.col("_raw").isNotNull(), F.when(hi == lo, 0.0).otherwise((F.col("_raw") - lo) / (hi - lo))))
    return out.withColumn("final", F.coalesce(alpha * F.col("rerank") + (1 - alpha) * F.col("mix"), F.col("mix"))).drop("_place", "_raw")


def gated(candidates: DataFrame, key: str, file: str, text: str, top_k: int = 8, min_score: float = 0.15, per_file: int = 2, score: str = "mix") -> DataFrame:
    """Score gate, then at most ``per_file`` hits of a file, then those with text, then the best."""
    passed = candidates.where(F.col(score) >= min_score)
    turn = F.row_number().over(W.partitionBy(file).orderBy(F.desc(score), key))
    some = passed.where(F.coalesce(F.col(text), F.lit("")) != "").withColumn("_turn", turn).where(F.col("_turn") <= per_file).drop("_turn")
    return some.orderBy(F.desc(score), key).limit(top_k)


def with_context(hits: DataFrame, order: str, text: str, label: Column, budget: int = 8000, per_chunk: int = 1600) -> DataFrame:
    """Adds n (1-based), block and used: blocks in order as long as their lengths fit the budget.

    ``hits`` is a result list of a few rows.
    """
    by = W.orderBy(order)
    body = F.when(F.length(text) > per_chunk, F.concat(F.substring(text, 1, per_chunk), F.lit(" ..."))).otherwise(F.col(text))
    out = hits.withColumn("n", F.row_number().over(by))
    out = out.withColumn("block", F.concat(F.lit("["), F.col("n"), F.lit("] "), label, F.lit("\n"), body, F.lit("\n")))
    out = out.withColumn("block", F.when(F.col("n") == 1, F.substring("block", 1, budget)).otherwise(F.col("block")))
    return out.withColumn("used", F.sum(F.length("block")).over(by.rowsBetween(W.unboundedPreceding, 0))).where(F.col("used") <= budget)


def context_label(file: Column, chunk: Column, score: Column) -> Column:
    """``file | chunk c | score=0.000``: what the header of a context block says after its number."""
    return F.concat(file, F.lit(" | chunk "), chunk.cast("string"), F.lit(" | score="), F.bround(score.cast("decimal(20,10)"), 3).cast("decimal(20,3)").cast("string"))


def filled(template: str, context_: Column, question: str) -> Column:
    """A prompt with {context} and {question} in their places, and braces of what is put in left alone."""
    head, _, tail = template.partition("{context}")
    put = lambda t: F.lit(t.replace("{question}", question))
    return F.concat(put(head), context_, put(tail)) if "{context}" in template else put(template)


def load_prompts(spark: SparkSession, path: str) -> dict[str, str]:
    """Prompt templates from a JSON object, with or without a byte-order mark; none if it cannot be read."""
    try:
        text = "".join(r[0] for r in spark.read.text(path, wholetext=True).collect())  # one small file
        return json.loads(text.lstrip("\ufeff"))
    except (AnalysisException, ValueError):
        return {}


def search(chunks: DataFrame, key: str, file: str, text: str, vector: str, query: str, query_vector: list[float], dim: int, score: Callable[[pd.Series], pd.Series] | None = None, k: int = 30, top_k: int = 8, min_score: float = 0.15, per_file: int = 2, w_dense: float = 0.65, w_sparse: float = 0.35) -> DataFrame:
    """Dense and BM25 candidates of a store's chunks, mixed, reranked by ``score`` if given, and gated.

    ``dim`` is what the store's configuration says of its vectors; a query vector of another size is refused.
    """
    if len(query_vector) != dim:
        raise ValueError(f"the store has vectors of {dim} numbers, the query {len(query_vector)}")
    dense = dense_top_k(chunks, key, vector, query_vector, k)
    found = hybrid(dense, bm25.top_k(chunks, key, text, query, k), key, w_dense, w_sparse).withColumn("mix", F.round("mix", 6))
    # at most 2k candidates
    hits = rerank(chunks.drop(vector).join(F.broadcast(found), key), key, text, score)
    return gated(hits.withColumn("final", F.round("final", 8)), key, file, text, top_k, min_score, per_file, "final")


def context(blocks: DataFrame) -> DataFrame:
    """One row: the blocks joined by blank lines."""
    return blocks.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "block"))), lambda x: x["block"]), "\n\n").alias("context"))


def answer_sources(answers: DataFrame, key: str, answer: str, hits: DataFrame, place: str, fallback: int = 5) -> DataFrame:
    """key, rank, and the hit of each citation in citation order; the first hits where nothing is cited.

    ``place`` is a hit's 0-based position; hits are a result list of a few rows.
    """
    n = hits.count()
    places = cited(F.col(answer), F.lit(n))
    first = F.sequence(F.lit(0), F.lit(min(fallback, n) - 1)).cast("array<bigint>") if n else F.array().cast("array<bigint>")
    rows = answers.select(key, F.posexplode(F.when(F.size(places) > 0, places).otherwise(first)).alias("rank", "_at"))
    return rows.join(F.broadcast(hits), F.col("_at") == F.col(place)).drop("_at")
