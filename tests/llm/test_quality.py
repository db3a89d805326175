import re
from collections import Counter
from math import log

import xxhash
from pyspark.sql import functions as F

from docsift.llm.quality import BUCKETS, SCALE, buckets_for, log_ratios, quality_rules, ratio_table
from tests.llm.helpers import docs

GOOD = "the quick brown fox jumps over the lazy dog and then it runs far away into the green wood " * 1
TEXTS = (
    [f"{GOOD} number {i} was followed by another animal that liked to eat bread with butter and some honey from the old garden near our house every morning except {i} when rain fell on the roof all day long" for i in range(8)]
    + [" ".join(f"zq{j} {i}" for j in range(60)) for i in range(6)]
    + [None, "", " \n\t", "a b c a b c a b c", "spam spam " * 60, "x # $ *\nx # $ *\n\n \n& | < > %", "é\x0bü\x1cz " * 30, "w" * 5000]
)


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def brute_counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if n[x] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    out = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))
    return (*out, out[0] < 50 or 100 * out[4] > 50 * out[0])


def brute_buckets(text):
    h = [xxhash.xxh64_intdigest(w.encode(), seed=42) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    two = []
    for i, x in enumerate(h):
        seed = xxhash.xxh64_intdigest(h[i - 1].to_bytes(8, "little"), seed=42) if i else 42
        two.append(xxhash.xxh64_intdigest(x.to_bytes(8, "little"), seed=seed))
    return [x % BUCKETS for x in h + two]


def test_agrees_with_brute_force(spark):
    trusted = spark.createDataFrame([(i,) for i in (0, 1, 2, 3, 3, None, 999)], "doc_id long")
    raw, target = Counter(), Counter()
    for i, t in enumerate(TEXTS):
        raw.update(brute_buckets(t))
        if i < 4:
            target.update(brute_buckets(t))
    ratio = [log((target[b] + 1) / (max(raw[b] - 1, 0) * target.total() / raw.total() + 1)) for b in range(BUCKETS)]
    d = docs(spark, TEXTS)
    assert all(abs(a - round(b * SCALE)) <= 1 for a, b in zip(log_ratios(d, trusted), ratio))
    for r in quality_rules(d, trusted).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_counts(TEXTS[r.doc_id])
        b = brute_buckets(TEXTS[r.doc_id])
        llr = sum(ratio[x] for x in b) / len(b) if b else 0.0
        assert abs(r.llr - llr) < 1e-5
        assert r.kept == (not r.base_failed and r.llr >= -0.06)


def test_unlike_the_target_goes_and_the_rest_stays(spark):
    kept = {r.doc_id: r.kept for r in quality_rules(docs(spark, TEXTS), spark.createDataFrame([(i,) for i in range(4)], "doc_id long")).collect()}
    assert all(kept[i] for i in range(8))
    assert not any(kept[i] for i in range(8, len(TEXTS)))


def test_no_trusted_documents_and_clashing_columns(spark):
    d = docs(spark, TEXTS).withColumns({"_trusted": F.lit(1), "bucket": F.lit(2), "llr": F.lit("x")})
    got = quality_rules(d, spark.createDataFrame([], "doc_id long")).collect()
    assert all(r.llr == 0 and r.kept == (not r.base_failed) for r in got)


def test_repeated_rows_and_empty_table(spark):
    d = docs(spark, TEXTS[:2])
    t = spark.createDataFrame([(0,)], "doc_id long")
    got = [tuple(r) for r in quality_rules(d.union(d), t).collect()]
    assert len(got) == 4 and len(set(got)) == 2
    assert quality_rules(d.limit(0), t).count() == 0


def test_native(spark):
    plan = quality_rules(docs(spark, TEXTS), spark.createDataFrame([(0,)], "doc_id long"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_buckets_grow_with_the_corpus(spark):
    sizes = [buckets_for(spark.range(n).selectExpr("repeat('x', 1000000) text")) for n in (0, 1, 400, 1600)]
    assert sizes == [BUCKETS, BUCKETS, 1 << 16, 1 << 17]
    d, t = docs(spark, TEXTS), spark.createDataFrame([(0,)], "doc_id long")
    assert len(log_ratios(d, t, buckets=1 << 16)) == ratio_table(d, t, 1 << 16).count() == 1 << 16


def test_ratios_joined_as_a_table_give_equal_results(spark):
    d = docs(spark, TEXTS + TEXTS[:3])
    for trusted in ([(0,), (1,)], []):
        t = spark.createDataFrame(trusted, "doc_id long")
        by_literal, by_join = (sorted(map(tuple, quality_rules(d, t, literal_buckets=n).collect())) for n in (1 << 20, 0))
        assert by_literal == by_join and len(by_join) == len(TEXTS) + 3
    assert quality_rules(d.limit(0), t, literal_buckets=0).count() == 0


def test_native_by_join(spark):
    plan = quality_rules(docs(spark, TEXTS), spark.createDataFrame([(0,)], "doc_id long"), literal_buckets=0)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_verdicts_do_not_hang_on_the_size_of_the_corpus(spark):
    """1,000 documents by themselves, and among 10,000 others: nineteen in twenty verdicts agree, and those of labelled documents nearly all."""
    data = "/root/testdata"
    own, labels = (spark.read.parquet(f"{data}/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    others = spark.read.parquet(f"{data}/sf0.1/documents.parquet").withColumn("doc_id", F.col("doc_id") + 10**9)
    trusted = labels.where("quality = 1").select("doc_id")
    small, large = ({r.doc_id: (r.kept, r.base_failed) for r in quality_rules(d, trusted).where("doc_id < 1000000000").collect()} for d in (own, own.union(others)))
    assert sum(small[i] == large[i] for i in small) >= 0.95 * len(small)
    label = {r.doc_id: r.quality for r in labels.collect()}
    for verdicts in (small, large):
        good = [verdicts[i][0] for i in label if label[i] == 1 and not verdicts[i][1]]
        assert sum(good) >= 0.98 * len(good) and not any(verdicts[i][0] for i in label if label[i] == 0)
