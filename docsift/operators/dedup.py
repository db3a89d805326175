"""Exact duplicates of files and of chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.functions.text import file_name, fold_for_hash, text_sha1


#: Sizes that may be broadcast.
SIZES = 1_000_000


def duplicate_groups(files: DataFrame, size: str, content: str, member: str) -> DataFrame:
    """size, hash, n and member, in a row for each file whose content occurs twice or more.

    Only contents of a size that is met twice are hashed, where they are read; only sizes and hashes are
    shuffled, and counted before, so a content that a third of all files share is one row of each task.
    Where more than SIZES sizes are met twice, all contents are hashed, since no shuffle of contents is worth less.
    """
    often = files.groupBy(F.col(size).alias("_size")).agg(F.count("*").alias("_n")).where("_n > 1").select("_size")
    if often.count() <= SIZES:
        files = files.join(F.broadcast(often), F.col(size) == F.col("_size"), "left_semi")
    hashed = files.select(F.col(size).alias("size"), F.sha2(F.col(content).cast("binary"), 256).alias("hash"), F.col(member).alias("member"))
    groups = hashed.groupBy("size", "hash").agg(F.count("*").alias("n")).where("n > 1")
    return hashed.join(groups, ["size", "hash"])


def largest_first(members: DataFrame) -> DataFrame:
    """Rows of ``duplicate_groups`` in the order of a report: the largest groups first."""
    return members.orderBy(F.desc("n"), "size", "hash", "member")


def duplicate_totals(files: DataFrame, size: str, content: str) -> DataFrame:
    """One row: n_groups, n_files in them, and the most files of one group."""
    hashed = files.select(F.col(size).alias("size"), F.sha2(F.col(content).cast("binary"), 256).alias("hash"))
    groups = hashed.groupBy("size", "hash").agg(F.count("*").alias("n")).where("n > 1")
    return groups.agg(F.count("*").alias("n_groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_files"), F.max("n").alias("most"))


def first_seen(chunks: DataFrame, text: str, order: list[str], known: DataFrame | None = None) -> DataFrame:
    """Chunks whose folded text was not seen before in ``order`` nor is among ``known`` hashes (chunk_hash); blanks go.

    The first of a hash is a minimum, so equal chunks combine before they are shuffled.
    """
    hashed = chunks.withColumn("chunk_hash", text_sha1(F.col(text))).where(fold_for_hash(F.col(text)) != "")
    if known is not None:
        hashed = hashed.join(known.select("chunk_hash").distinct(), "chunk_hash", "left_anti")
    first = hashed.groupBy("chunk_hash").agg(F.min(F.struct(*order)).alias("_first"))
    return first.select("chunk_hash", "_first.*")


def marked(chunks: DataFrame, text: str, order: list[str], known: DataFrame | None = None) -> DataFrame:
    """``chunks`` with dup: its folded text is not blank, and an earlier chunk or one of ``known`` (chunk_hash) has it.

    The first of a hash is a minimum, combined before the shuffle; the join back can be split where a text is frequent.
    """
    hashed = chunks.withColumns({"_h": text_sha1(F.col(text)), "_blank": fold_for_hash(F.col(text)) == ""})
    first = hashed.where("not _blank").groupBy(F.col("_h").alias("_f")).agg(F.min(F.struct(*order)).alias("_first"))
    out = hashed.join(first, (F.col("_h") == F.col("_f")) & ~F.col("_blank"), "left")
    dup = ~F.col("_blank") & (F.struct(*order) != F.col("_first"))
    if known is not None:
        out = out.join(known.select(F.col("chunk_hash").alias("_k")).distinct(), F.col("_h") == F.col("_k"), "left")
        dup = dup | (~F.col("_blank") & F.col("_k").isNotNull())
    return out.withColumn("dup", F.coalesce(dup, F.lit(False))).drop("_h", "_blank", "_f", "_first", "_k")


def duplicate_ratio(chunks: DataFrame, file: str, text: str, order: list[str], most: float = 0.8, known: DataFrame | None = None) -> DataFrame:
    """file, n_chunks, n_dup, ratio, skipped: a chunk repeats if an earlier one, in any file, or a known one has its folded text."""
    per = marked(chunks.select(file, *[c for c in order if c != file], text), text, order, known).groupBy(file).agg(F.count("*").alias("n_chunks"), F.count_if("dup").alias("n_dup"))
    return per.withColumn("ratio", F.round(F.col("n_dup") / F.col("n_chunks"), 6)).withColumn("skipped", F.col("n_dup") >= most * F.col("n_chunks"))


def duplicate_summary(chunks: DataFrame, text: str, order: list[str], known: DataFrame | None = None) -> DataFrame:
    """One row: n_unique, n_dup, ratio; blank chunks are neither, but count in the total."""
    m = marked(chunks.select(*order, text), text, order, known)
    some = fold_for_hash(F.col(text)) != ""
    return m.agg(F.count_if(some & ~F.col("dup")).alias("n_unique"), F.count_if("dup").alias("n_dup"), F.round(F.count_if("dup") / F.greatest(F.count("*"), F.lit(1)), 6).alias("ratio"))


def name_counts(chunks: DataFrame, name: str, path: str) -> DataFrame:
    """name, n: chunks by lower-cased file name, taken from the path where the name is missing."""
    own = F.lower(F.coalesce(F.nullif(F.col(name), F.lit("")), file_name(F.col(path))))
    return chunks.groupBy(own.alias("name")).agg(F.count("*").alias("n"))


def with_known_name(files: DataFrame, counts: DataFrame, name: str) -> DataFrame:
    """Adds known: whether a store has chunks of a file of that name."""
    seen = counts.where("n > 0").select(F.col("name").alias("_n"))
    return files.join(seen, F.lower(name) == F.col("_n"), "left").withColumn("known", F.col("_n").isNotNull()).drop("_n")


def next_id(chunks: DataFrame, key: str) -> DataFrame:
    """One row, next_id: the largest whole number among the ids, and one; 0 where there is none."""
    return chunks.agg((F.coalesce(F.max(F.col(key).try_cast("bigint")), F.lit(-1)) + 1).alias("next_id"))


def new_files(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files not in the manifest by path, whole seconds of mtime, and size."""
    seen = manifest.select("path", F.col("mtime").cast("long").alias("mtime"), "size").distinct()
    return files.join(seen, (files["path"] == seen["path"]) & (files["mtime"].cast("long") == seen["mtime"]) & (files["size"] == seen["size"]), "left_anti")
