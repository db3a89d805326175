"""A lexical index by batches: postings in blocks of neighbouring keys, with the largest score each can give.

A row holds a word's postings among ``SPAN`` neighbouring keys, and the most often and the
shortest that it is met there.  BM25 grows with a word's count and falls with a text's length,
so these two bound every score of the block, whatever later batches do to the corpus's
statistics.  A search first reads the blocks of the highest bounds, which gives a k-th score,
and then only blocks whose bound reaches it.

Statistics are sums, so batches add theirs up.  Keys are whole numbers, each in one batch.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsift.operators.bm25 import K1, B, query_tokens
from docsift.operators.inverted import lists

SPAN = 256
#: Neighbouring blocks of a word that one file holds.
TOGETHER = 1024
#: Blocks read for the first k-th score, and most block numbers given to a scan as literals.
FIRST, LITERALS = 16, 1000
BLOCKS = "term string, block long, n int, total long, most int, least int, keys array<long>, tfs array<int>, dls array<int>"


@dataclass(frozen=True)
class Statistics:
    """Texts and words of all batches."""

    texts: int
    words: int

    def __add__(self, other: Statistics) -> Statistics:
        return Statistics(self.texts + other.texts, self.words + other.words)


def blocks(rows: DataFrame, key: str, text: str) -> DataFrame:
    """term, block, n, total (occurrences), most, least, keys, tfs, dls: at most SPAN keys a row.

    Only texts are shuffled: they are dealt by their blocks, and a block's lists are made where its texts are.
    """
    own = rows.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).withColumn("block", F.floor(F.col("key") / SPAN))
    return lists(own.repartition("block").sortWithinPartitions("block", "key"), "long")


def write(rows: DataFrame, key: str, text: str, at: str) -> Statistics:
    """Write a batch's blocks in order of words, so that a scan for some words skips the rest; returns its statistics."""
    # by hash: for bounds of ranges all blocks would be made twice; a common word is in as many files as it fills
    blocks(rows, key, text).repartition("term", F.floor(F.col("block") / TOGETHER)).sortWithinPartitions("term", "block").write.mode("overwrite").parquet(at)
    # every occurrence of a word is in some block
    words = rows.sparkSession.read.schema(BLOCKS).parquet(at).agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    return Statistics(rows.count(), words)


def _part(tf: Column, dl: Column, average: float) -> Column:
    f = tf.cast("double")
    return f * (K1 + 1) / (f + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * dl / F.lit(average + 1e-9)) + 1e-9)


@dataclass(frozen=True)
class Search:
    """A query over blocks: the weight of each word, and what has to be read."""

    found: DataFrame
    weights: dict[str, float]
    average: float

    @staticmethod
    def of(index: DataFrame, stats: Statistics, query: str) -> Search:
        import math

        words = query_tokens(query)
        found = index.where(F.col("term").isin(sorted(set(words))))
        df = {r["term"]: r["df"] for r in found.groupBy("term").agg(F.sum("n").alias("df")).collect()}  # a row for each query word
        weights = {w: words.count(w) * math.log(1 + (stats.texts - n + 0.5) / (n + 0.5)) for w, n in df.items()}
        return Search(found, weights, stats.words / max(stats.texts, 1))

    def _weight(self) -> Column:
        weight = F.lit(0.0)
        for w, x in sorted(self.weights.items()):
            weight = F.when(F.col("term") == w, F.lit(x)).otherwise(weight)
        return weight

    def bounds(self) -> DataFrame:
        """block, bound: no score of the block is higher.  Reads no postings."""
        return self.found.groupBy("block").agg(F.sum(self._weight() * _part(F.col("most"), F.col("least"), self.average)).alias("bound"))

    def scored(self, part: DataFrame) -> DataFrame:
        """key, score of the texts in some blocks."""
        rows = part.select("term", F.explode(F.arrays_zip("keys", "tfs", "dls")).alias("p")).select("term", "p.*")
        return rows.groupBy(F.col("keys").alias("key")).agg(F.round(F.sum(self._weight() * _part(F.col("tfs"), F.col("dls"), self.average)), 6).alias("score"))

    def best(self, part: DataFrame, k: int) -> DataFrame:
        return self.scored(part).orderBy(F.desc("score"), "key").limit(k)

    def wanted(self, k: int) -> tuple[list[int], DataFrame | None]:
        """The blocks read first, and those beyond that the k-th score of the first does not rule out."""
        bounds = self.bounds()
        first = [r["block"] for r in bounds.orderBy(F.desc("bound"), "block").limit(max(FIRST, k // SPAN + 1)).collect()]
        if not first:
            return [], None
        met = self.best(self.found.where(F.col("block").isin(first)), k).collect()
        rest = bounds.where(~F.col("block").isin(first))
        # fewer than k texts rule nothing out; scores are rounded, bounds are not
        return first, rest if len(met) < k else rest.where(F.col("bound") >= met[-1]["score"] - 1e-6)

    def top_k(self, k: int) -> DataFrame:
        first, rest = self.wanted(k)
        if rest is None:
            return self.best(self.found, k)
        some = rest.select("block").limit(LITERALS + 1).collect()
        if len(some) <= LITERALS:
            # literals reach the scan
            return self.best(self.found.where(F.col("block").isin([*first, *[r["block"] for r in some]])), k)
        own = rest.select("block").union(rest.sparkSession.createDataFrame([(b,) for b in first], "block long"))
        return self.best(self.found.join(own, "block", "left_semi"), k)


def top_k(index: DataFrame, stats: Statistics, query: str, k: int = 30) -> DataFrame:
    """key, score of the k best texts that hold a query word, ties to the smaller key."""
    return Search.of(index, stats, query).top_k(k)
