"""Quality rules: simple counts, and a hashed n-gram log-likelihood ratio.

Word unigrams and bigrams are hashed into buckets, of which there are the same number at
every size of the corpus, since the threshold holds for one number only.  Two multinomials over the buckets are counted - one over trusted documents, one over
all - and a document's score is the mean over its n-grams of the log ratio of the
two, each smoothed by one count a bucket at the size of the trusted part.  Log ratios are held in fixed-point, so sums come out the same in any order.
Number of buckets and threshold are constants, so a verdict depends on how words are distributed in
the corpus and in its trusted part, not on how large these are; equal documents of a run get equal verdicts.

Defined results: a null, empty or blank text has no words and fails the base
rules; without trusted documents the ratio is 0 everywhere and only base rules
decide; repeated rows count and are judged repeatedly; whole texts of any length
are read; extra columns play no part.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.llm._spark import small_or_shuffled, staged

WORD, SPACE = r"[^\x20\x09-\x0D]", r"[\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
#: The number of buckets that THRESHOLD was read off with.
BUCKETS = 1 << 14
#: Buckets up to which the ratios travel as a literal array (some 25 MB); more are joined as a table, with equal results.
LITERAL_BUCKETS = 1 << 20
SCALE = 1_000_000
#: Of 10,000 test documents, those labelled good lie above -0.03, and those labelled bad that pass the base rules below -0.06.
THRESHOLD = -0.06


def with_words(docs: DataFrame) -> DataFrame:
    """Adds _text (null: empty), _words and _hashes, a hash for each word."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    inner = F.btrim("_text", F.lit(" \t\n\x0b\x0c\r"))
    words = F.when(F.length(inner) > 0, F.split(inner, SPACE + "+"))
    split = docs.withColumn("_text", text).withColumn("_words", F.coalesce(words, F.array().cast("array<string>")))
    return split.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))


def buckets_for(docs: DataFrame) -> int:
    """A number of buckets for callers with a threshold of their own: the power of two at or above twice the root of all characters, at least BUCKETS: 2^16 at 0.5 GB, 2^25 at 100 TB."""
    chars = docs.agg(F.sum(F.length(F.col("text").cast("string")).cast("long"))).first()[0] or 0
    return max(BUCKETS, 1 << (math.isqrt(4 * chars) - 1).bit_length()) if chars else BUCKETS


def _bucket(h: F.Column, buckets: int) -> F.Column:
    return h.bitwiseAND(F.lit(buckets - 1)).cast("int")


def _pair(hashes: F.Column, h: F.Column, i: F.Column) -> F.Column:
    """A word's hash with that of the word before it; the first word's is with the start of the text."""
    return F.xxhash64(F.get(hashes, i - 1), h)


def base_counts(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed to rows of ``with_words``."""
    h = F.col("_hashes")
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(WORD))
    # each word with the two before it; the first two have fewer, so they are like none
    windows = F.transform(h, lambda x, i: F.xxhash64(F.get(h, i - 2), F.get(h, i - 1), x, F.least(i, F.lit(2))))
    first = docs.withColumns({"_lines": lines, "_windows": windows})
    placed = F.array_sort(F.transform("_windows", lambda x, i: F.struct(x.alias("h"), i.alias("at"))))
    # most texts repeat no window; only the others are sorted to find where
    second = first.withColumn("_sorted", F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), placed))
    s = F.col("_sorted")
    again = F.filter(s, lambda x, i: ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | ((i < F.size(s) - 1) & (F.get(s, i + 1)["h"] == x["h"])))
    covered = F.array_distinct(F.flatten(F.transform(again, lambda x: F.array(x["at"] - 2, x["at"] - 1, x["at"]))))
    out = second.withColumns({
        "n_words": F.size("_hashes").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": F.regexp_count("_text", F.lit(SYMBOLS)).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": F.when(s.isNull(), 0).otherwise(F.size(covered)).cast("long"),
    })
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumn("base_failed", failed).drop("_lines", "_windows", "_sorted")


def _grams(h: F.Column, buckets: int) -> F.Column:
    """The buckets of a text's words, then of its pairs."""
    return F.concat(F.transform(h, lambda x: _bucket(x, buckets)), F.transform(h, lambda x, i: _bucket(_pair(h, x, i), buckets)))


def ratio_table(docs: DataFrame, trusted_ids: DataFrame, buckets: int, smoothing: float = 1.0) -> DataFrame:
    """bucket and its log ratio in fixed-point, a row for each of ``buckets``.

    ``docs`` has doc_id and text; ``trusted_ids`` the doc_id of trusted documents.
    """
    ids = small_or_shuffled(trusted_ids.select(F.col("doc_id").alias("_trusted")).where("_trusted is not null").distinct())
    marked = docs.select("doc_id", "text").join(ids, F.col("doc_id") == F.col("_trusted"), "left")
    both = _grams(F.col("_hashes"), buckets)
    grams = with_words(marked).select(F.col("_trusted").isNotNull().cast("long").alias("t"), F.explode_outer(both).alias("bucket")).where("bucket is not null")
    counts = staged(grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("t").alias("target")), "gram-counts")
    raws, targets = (n or 0 for n in counts.agg(F.sum("raw"), F.sum("target")).first())
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(small_or_shuffled(counts), "bucket", "left").na.fill(0)
    a = F.lit(smoothing)
    # raw counts at the size of the target, so that both are smoothed alike and what is rare in both comes out even;
    # less one, because the n-gram that is judged is itself among them
    scaled = F.greatest(F.col("raw") - 1, F.lit(0)) * F.lit(targets) / F.lit(max(raws, 1))
    ratio = F.log((F.col("target") + a) / (scaled + a))
    return every.select("bucket", (F.round(ratio * SCALE) if targets else F.lit(0)).cast("long").alias("ratio"))


def log_ratios(docs: DataFrame, trusted_ids: DataFrame, smoothing: float = 1.0, buckets: int | None = None) -> list[int]:
    """The ratios of ``ratio_table`` in a list, of at most LITERAL_BUCKETS numbers where ``judged`` calls it."""
    return [r[0] for r in ratio_table(docs, trusted_ids, buckets or BUCKETS, smoothing).orderBy("bucket").select("ratio").collect()]


def _totals_by_literal(rows: DataFrame, ratios: list[int]) -> DataFrame:
    """Adds _total, the sum of a text's ratios, and _n, the number of these, to rows of ``with_words``."""
    # one folded literal, as long as the number of buckets
    held = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<bigint>")
    h, n = F.col("_hashes"), len(ratios)
    each = F.transform(h, lambda x, i: F.get(held, _bucket(x, n)) + F.get(held, _bucket(_pair(h, x, i), n)))
    total = F.aggregate(each, F.lit(0).cast("long"), lambda acc, x: acc + x)
    return rows.withColumns({"_total": total, "_n": (2 * F.size(h)).cast("long")})


def _totals_by_join(rows: DataFrame, ratios: DataFrame, buckets: int) -> DataFrame:
    """As ``_totals_by_literal``, by a join of counted n-grams with the table of ratios.

    Texts are known by 128 bits of hash.  A text's n-grams are counted before they
    are shuffled, so a bucket has a row a text at most, and copies of a text are
    counted together; divided by the number of copies, sums are those of one text.
    """
    key = {"_k1": F.xxhash64("_text"), "_k2": F.xxhash64(F.lit(1), F.col("_text"))}
    keyed = rows.withColumns(key)
    copies = keyed.where(F.size("_hashes") > 0).groupBy("_k1", "_k2").agg(F.count("*").alias("_copies"), F.first(F.size("_hashes")).alias("_words_each"))
    grams = keyed.select("_k1", "_k2", F.explode_outer(_grams(F.col("_hashes"), buckets)).alias("bucket")).where("bucket is not null")
    counted = grams.groupBy("_k1", "_k2", "bucket").agg(F.count("*").alias("_times"))
    sums = counted.join(small_or_shuffled(ratios), "bucket").groupBy("_k1", "_k2").agg(F.sum(F.col("_times") * F.col("ratio")).alias("_sum"))
    each = sums.join(copies, ["_k1", "_k2"]).select("_k1", "_k2", F.expr("_sum div _copies").alias("_total"), (2 * F.col("_words_each")).cast("long").alias("_n"))
    found = keyed.join(small_or_shuffled(staged(each, "gram-sums")), ["_k1", "_k2"], "left").drop("_k1", "_k2")
    return found.withColumns({"_total": F.coalesce("_total", F.lit(0).cast("long")), "_n": F.coalesce("_n", F.lit(0).cast("long"))})


def judged(docs: DataFrame, trusted_ids: DataFrame, threshold: float = THRESHOLD, literal_buckets: int = LITERAL_BUCKETS, buckets: int = BUCKETS) -> DataFrame:
    """``docs`` with the counts, base_failed, llr (mean log ratio) and kept.

    Another number of ``buckets`` (a power of two) needs another threshold; beyond ``literal_buckets`` of them, ratios are joined as a table.
    """
    rows = with_words(docs)
    if buckets <= literal_buckets:
        scored = _totals_by_literal(rows, log_ratios(docs, trusted_ids, buckets=buckets))
    else:
        scored = _totals_by_join(rows, staged(ratio_table(docs, trusted_ids, buckets), "gram-ratios"), buckets)
    llr = F.when(F.col("_n") > 0, F.col("_total") / F.col("_n") / SCALE).otherwise(0.0)
    out = base_counts(scored.withColumn("llr", llr))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold)).drop("_text", "_words", "_hashes", "_total", "_n")


def quality_rules(docs: DataFrame, trusted_ids: DataFrame, threshold: float = THRESHOLD, literal_buckets: int = LITERAL_BUCKETS, buckets: int = BUCKETS) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return judged(rows, trusted_ids, threshold, literal_buckets, buckets).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept")
