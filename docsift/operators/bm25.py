"""BM25 over a corpus: postings, statistics and top-k."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.functions.text import TOKEN, tokens
from docsift.operators.inverted import lists

K1, B = 1.5, 0.75


def query_tokens(query: str) -> list[str]:
    return re.findall(TOKEN, query.lower())


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, term, tf."""
    return docs.select(key, F.explode_outer(tokens(F.col(text))).alias("term")).where("term is not null").groupBy(key, "term").agg(F.count("*").alias("tf"))


def document_frequency(docs: DataFrame, key: str, text: str) -> DataFrame:
    """term, df: distinct inside the row first, so only one row for a term and document is shuffled."""
    return docs.select(F.explode_outer(F.array_distinct(tokens(F.col(text)))).alias("term")).where("term is not null").groupBy("term").agg(F.count("*").alias("df"))


def _equals(word: str):
    return lambda x: x == F.lit(word)


def scores(docs: DataFrame, key: str, text: str, query: str, k1: float = K1, b: float = B, counts_at: str | None = None) -> DataFrame:
    """key, score of every document; query words count as often as they occur.

    The query's words are known, so one scan counts them in each row and no
    postings are shuffled; the statistics are one row.  With a folder ``counts_at``
    the counts are written there, so texts are split once for both.
    """
    words = query_tokens(query)
    distinct = sorted(set(words))
    counted = docs.select(key, tokens(F.col(text)).alias("t")).select(key, F.size("t").alias("dl"), *[F.size(F.filter("t", _equals(w))).alias(f"tf{i}") for i, w in enumerate(distinct)])
    if counts_at:
        counted.write.parquet(counts_at)
        counted = docs.sparkSession.read.schema(counted.schema).parquet(counts_at)
    stats = counted.agg(F.count("*").alias("n"), (F.sum("dl") / F.greatest(F.count("*"), F.lit(1))).alias("avgdl"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(distinct))])
    row = stats.first()  # one row
    if not distinct or not row["n"]:
        return counted.select(key, F.lit(0.0).alias("score"))
    norm = F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.col("dl") / F.lit(row["avgdl"] + 1e-9))
    total = F.lit(0.0)
    for i, w in enumerate(distinct):
        idf = F.log(F.lit(1 + (row["n"] - row[f"df{i}"] + 0.5) / (row[f"df{i}"] + 0.5)))
        f = F.col(f"tf{i}").cast("double")
        total = total + F.lit(words.count(w)) * idf * f * (k1 + 1) / (f + norm + 1e-9)
    return counted.select(key, total.alias("score"))


def top_k(docs: DataFrame, key: str, text: str, query: str, k: int = 30, counts_at: str | None = None) -> DataFrame:
    """The k best, ties to the smaller key; scores rounded to 6 places."""
    s = scores(docs, key, text, query, counts_at=counts_at).select(key, F.round("score", 6).alias("score"))
    return s.orderBy(F.desc("score"), key).limit(k)


#: Scan partitions whose lists of a word are in one file.
TOGETHER = 16


def build_index(docs: DataFrame, key: str, text: str, path: str) -> None:
    """Write lists of postings (term, keys, tfs, dls) in order of terms, and one row of statistics.

    A search reads only the pages of its words.  A list is made where the texts are, and shuffled once: by hash, since
    for bounds of ranges all lists would be made twice; a common word is in as many files as it fills.
    """
    own = docs.select(F.lit(0).alias("block"), F.col(key).alias("key"), F.col(text).alias("text"))
    made = lists(own, own.schema["key"].dataType.simpleString()).withColumn("part", F.floor(F.spark_partition_id() / F.lit(TOGETHER)))
    made.repartition("term", "part").sortWithinPartitions("term", "part").select("term", "total", "keys", "tfs", "dls").write.parquet(f"{path}/postings")
    n = docs.count()
    words = docs.sparkSession.read.parquet(f"{path}/postings").agg((F.sum("total") / F.lit(max(n, 1))).alias("avgdl"))
    words.select(F.lit(n).cast("long").alias("n"), "avgdl").write.parquet(f"{path}/stats")


def search_index(spark: SparkSession, path: str, key: str, query: str, k: int = 30, k1: float = K1, b: float = B) -> DataFrame:
    """The k best documents that hold a query word; the filter on terms reaches the scan."""
    words = query_tokens(query)
    stats = spark.read.parquet(f"{path}/stats").first()
    found = spark.read.parquet(f"{path}/postings").where(F.col("term").isin(sorted(set(words))))
    df = {r["term"]: r["df"] for r in found.groupBy("term").agg(F.sum(F.size("keys")).alias("df")).collect()}  # a row for each query word
    weight = F.lit(0.0)
    for w in sorted(df):
        idf = F.log(F.lit(1 + (stats["n"] - df[w] + 0.5) / (df[w] + 0.5)))
        weight = F.when(F.col("term") == w, F.lit(words.count(w)) * idf).otherwise(weight)
    f = F.col("tfs").cast("double")
    part = weight * f * (k1 + 1) / (f + F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.col("dls") / F.lit((stats["avgdl"] or 0.0) + 1e-9)) + 1e-9)
    # outer, because the filter that Spark infers for an inner one reads the arrays a second time
    rows = found.select("term", F.explode_outer(F.arrays_zip("keys", "tfs", "dls")).alias("p")).select("term", "p.*")
    scored = rows.groupBy(F.col("keys").alias(key)).agg(F.round(F.sum(part), 6).alias("score"))
    return scored.orderBy(F.desc("score"), key).limit(k)
