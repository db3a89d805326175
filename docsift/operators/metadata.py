"""Where chunks come from: the common root of files, relative paths, and running numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docsift.functions.text import extension, file_name


def common_root(files: DataFrame, path: str, parent_of_one: bool = False) -> DataFrame:
    """One row, root: the longest folder path that all files share; a single file is its own root, or with ``parent_of_one`` its folder is.

    What the least and the greatest path share, all between them share, too.
    """
    parts = F.split(F.col(path), "/")
    ends = files.agg(F.min(parts).alias("lo"), F.max(parts).alias("hi"))
    same = F.filter(F.sequence(F.lit(1), F.greatest(F.size("lo"), F.lit(1))), lambda i: F.slice("lo", F.lit(1), i) == F.slice("hi", F.lit(1), i))
    depth = F.when((F.col("lo") == F.col("hi")) & F.lit(parent_of_one), F.greatest(F.size("lo") - 1, F.lit(1))).otherwise(F.size(same))
    return ends.select(F.array_join(F.slice("lo", F.lit(1), depth), "/").alias("root"))


def with_source(chunks: DataFrame, path: str, size: str, root: str) -> DataFrame:
    """Adds file_name, rel_path, source_folder, file_type and size_kb."""
    at = root.rstrip("/")
    below = F.when(F.col(path) == at, ".").when(F.col(path).startswith(at + "/"), F.substr(F.col(path), F.lit(len(at) + 2))).otherwise(F.col(path))
    return chunks.withColumns({
        "file_name": file_name(F.col(path)),
        "rel_path": below,
        "source_folder": F.lit(at.rsplit("/", 1)[-1]),
        "file_type": F.ltrim(extension(F.col(path)), F.lit(".")),
        "size_kb": F.floor(F.col(size) / 1024),
    })


def with_running_id(rows: DataFrame, order: list[str], at: str, to: str = "id", first: int = 0) -> DataFrame:
    """Numbers all rows in ``order``, without gaps: ranges are written to the folder ``at`` in order, and each starts where the last ends.

    Rows are written before they are dealt over ranges, so that what made them runs once.
    One row for each range is all that is counted together.
    """
    spark, schema = rows.sparkSession, rows.schema
    rows.write.parquet(f"{at}/rows")
    at, rows = f"{at}/ranges", spark.read.schema(schema).parquet(f"{at}/rows")
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged.withColumns({"_range": F.spark_partition_id(), "_n": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}).write.parquet(at)
    written = spark.read.parquet(at)
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = written.groupBy("_range").agg(F.count("*").alias("n")).select(F.col("_range").alias("_r"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    return written.join(F.broadcast(starts), F.col("_range") == F.col("_r")).withColumn(to, F.col("_n") + F.col("_start") + first).drop("_range", "_n", "_r", "_start")


def absolute_path(abs_path: str, base: Column, rel_path: str) -> Column:
    """The absolute path where there is one, else base and relative path."""
    return F.coalesce(F.nullif(F.col(abs_path), F.lit("")), F.concat_ws("/", base, F.col(rel_path)))
