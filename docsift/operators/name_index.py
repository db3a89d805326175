"""An index of file names by their trigrams, for the search language of ``docsift.operators.names``.

A name that contains a literal has all its trigrams.  A name that fits a term at a
fuzzy threshold shares at least so many of its trigrams, or at least so many of its
letters: both bounds are proven below, so no name is lost, and only names that reach
them are looked at.

A term of n letters and a window of m share a common subsequence of l letters, and the ratio
200 * l / (n + m) is at the threshold or above.  Each of the n - l letters lost
breaks up to three of the term's n - 2 trigrams, and each of the m - l letters put between breaks
up to two; the rest are in the name.  Names shorter than the term are looked at by their letters alone.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.operators.names import EditSynonyms, compile_query, expand_terms, fuzzy, letters_allow

Q = 3
#: Names of a file.
NAMES = 50_000
#: Characters that equal an ASCII letter when case is ignored, though their lower case is another; a fixed value.
ODD = "[ſİıK]"


def grams_of(text: str) -> Counter:
    return Counter(text[i : i + Q] for i in range(len(text) - Q + 1))


def shared_at_least(n: int, threshold: float) -> int:
    """Trigrams of a term of ``n`` letters that are in every name, no shorter, that fits it at ``threshold``; below 1: none need be."""
    least = n - Q + 1
    for m in range(1, n + 1):
        common = math.ceil(threshold * (n + m) / 200 - 1e-9)
        if common <= m:
            least = min(least, (n - Q + 1) - Q * (n - common) - (Q - 1) * (m - common))
    return least


def literals(query: str) -> list[str]:
    """Texts that every name found by a query without ``@`` contains, in lower case."""
    query = query.strip()
    if "%" in query:
        include, exclude = (x.strip() for x in query.split("%", 1))
        query = include if include and exclude else query
    return [p.strip().lower() for p in query.split("*") if p.strip()]


@dataclass(frozen=True)
class NameIndex:
    """names (key, name, odd, and any others) and grams (gram, key, n)."""

    names: DataFrame
    grams: DataFrame

    def _holding(self, wanted: Counter, at_least: int) -> DataFrame:
        """Keys of names that share so many occurrences of the trigrams; the filter on trigrams reaches the scan."""
        want = F.create_map(*[x for g, n in sorted(wanted.items()) for x in (F.lit(g), F.lit(n))])
        met = self.grams.where(F.col("gram").isin(sorted(wanted)))
        return met.groupBy("key").agg(F.sum(F.least(F.col("n"), want[F.col("gram")])).alias("shared")).where(F.col("shared") >= at_least).select("key")

    def _among(self, keys: DataFrame, always: Column) -> DataFrame:
        """Names of some keys, and those that are looked at anyway."""
        return self.names.join(keys, "key", "left_semi").where(~always).union(self.names.where(always))

    def candidates(self, query: str) -> DataFrame:
        """Names that a query without ``@`` can find."""
        plain = Counter(g for p in literals(query) for g in set(grams_of(p)) if g.isascii())
        if not plain:
            return self.names
        wanted = Counter(set(plain))
        return self._among(self._holding(wanted, len(wanted)), F.col("odd"))

    def fuzzy_candidates(self, terms: list[str], threshold: float) -> DataFrame:
        """Names that can fit every one of the terms."""
        found = self.names
        for t in terms:
            t = t.lower()
            need = shared_at_least(len(t), threshold)
            if need >= 1:
                keys = self._holding(grams_of(t), need)
                short = F.length(F.lower("name")) < len(t)
                found = found.join(keys, "key", "left_semi").where(~short).union(found.where(short))
            found = found.where(letters_allow(F.lower("name"), t, threshold))
        return found

    def search(self, query: str, synonyms: dict[str, list[str]] | None = None, threshold: float = 70.0) -> DataFrame:
        """The names that ``names.route`` finds, by any query of the language."""
        query = query.strip()
        if not query:
            raise ValueError("an empty query")
        if query.lower() == "$synonym":
            raise EditSynonyms(query)
        if query.startswith("@"):
            found = self.fuzzy_candidates(expand_terms(query, synonyms or {}), threshold)
            return found.where(fuzzy(query, F.col("name"), synonyms, threshold)).drop("odd")
        return self.candidates(query).where(compile_query(query, F.col("name"))).drop("odd")


def build(rows: DataFrame, key: str, name: str, at: str) -> None:
    """Write the index of names in files of about ``NAMES``; trigrams are in order inside a file, so that a search skips pages without its own.

    Names are dealt out, not trigrams, so what a task sorts is as large for any number of names.
    """
    dealt = rows.withColumnsRenamed({key: "key", name: "name"}).repartition(max(1, -(-rows.count() // NAMES)), "key")
    names = dealt.withColumn("odd", F.coalesce(F.col("name").rlike(ODD), F.lit(False)))
    names.write.parquet(f"{at}/names")
    low = F.lower("name")
    cut = F.when(F.length(low) >= Q, F.transform(F.sequence(F.lit(1), F.length(low) - (Q - 1)), lambda i: F.substring(low, i, F.lit(Q))))
    each = dealt.select("key", cut.alias("cut")).select("key", "cut", F.explode_outer(F.array_distinct("cut")).alias("gram")).where("gram is not null")
    grams = each.select("gram", "key", (F.size("cut") - F.size(F.array_remove("cut", F.col("gram")))).alias("n"))
    grams.sortWithinPartitions("gram", "key").write.parquet(f"{at}/grams")


def load(spark: SparkSession, at: str) -> NameIndex:
    return NameIndex(spark.read.parquet(f"{at}/names"), spark.read.parquet(f"{at}/grams"))
