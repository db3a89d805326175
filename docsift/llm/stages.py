"""Operators as stages of a pipeline: documents in, documents out.

Each keeps the columns it is given, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.llm._spark import small_or_shuffled, staged
from docsift.llm.minhash import groups
from docsift.llm.mixing import mixed
from docsift.llm.packing import pack_documents
from docsift.llm.pii import masked
from docsift.llm.q_quality import trusted
from docsift.llm.quality import judged
from docsift.shipping import shipped

REPEATS, SEED = 1.5, 20


@shipped
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the likelihood-ratio threshold."""
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    # written before it is filtered: the optimiser would copy the whole rule into the filter, once for each use of a part of it
    return staged(judged(rows, trusted(spark, sf_dir)).select("_row", "kept"), "judged").where("kept").select("_row.*")


@shipped
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five-word shingles, 0.8): the least doc_id, its least text if it has several.

    Rows without words all stay.  A row is known by its id and its text, so an id
    that is given twice keeps both texts where these are not alike.
    """
    found = groups(docs).where("stays")
    # ids and texts that stay, and whether rows repeat them
    keep = found.groupBy("doc_id", "text_key", "n_shingles").agg(F.count("*").alias("n"))
    keep = staged(keep.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), ((F.col("n") > 1) & (F.col("n_shingles") > 0)).alias("_again")), "kept")
    whole = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").cast("long").alias("_doc"), F.xxhash64(F.col("text").cast("string")).alias("_text"))
    on = F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_key"))
    named = whole.join(small_or_shuffled(keep), on).select("_row", "_doc", "_text", "_again")
    # only repeated rows of what stays meet
    once = named.where("not _again").select("_row").union(named.where("_again").dropDuplicates(["_doc", "_text"]).select("_row"))
    return once.select("_row.*")


@shipped
def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Identifiers replaced by their kind; n_chars follows the text."""
    out = masked(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns) if "n_chars" in docs.columns else out


@shipped
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, those of smaller sources up to REPEATS times on average."""
    return mixed(docs, seed=SEED, repeats=REPEATS)


@shipped
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of 4096 tokens."""
    return pack_documents(docs, capacity=4096, end_id=1)
