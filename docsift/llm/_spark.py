"""Small helpers that the operators of this package share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows under which a narrow table may be broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; the warehouse, which is shared, too, where none is set.

    A warehouse on local disks is refused on a cluster, where each executor would write to its own.
    """
    given = spark.conf.get("spark.checkpoint.dir", None)
    at = given or spark.conf.get("spark.sql.warehouse.dir")
    if not given and (at.startswith("file:") or ":" not in at) and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return at.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back, which cuts its lineage there.

    Lost executors then cost a reread instead of the work behind the table.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/docsift-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_or_shuffled(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast where a count shows at most ``limit`` rows; else leave the join to a shuffle.

    Tasks count by themselves, so no rows meet for it.
    """
    return F.broadcast(df) if df.count() <= limit else df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def numbered(df: DataFrame, group: list[str], order: list[str], bucket_of: list[str], buckets: int, to: str, weight: str | None = None) -> DataFrame:
    """Gapless running numbers (or running sums of ``weight``) from 0 in each group.

    A group is dealt over hash buckets, each bucket is numbered by itself, and
    bucket totals (at most groups x buckets rows) give each bucket its start.
    No task ever holds a whole group.
    """
    from pyspark.sql import Window as W

    value = F.col(weight) if weight else F.lit(1).cast("long")
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(*bucket_of), F.lit(buckets)).cast("int"))
    totals = dealt.groupBy(*group, "_bucket").agg(F.sum(value).alias("_total"))
    before = W.partitionBy(*group).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select(*[F.col(c).alias(f"_g_{c}") for c in group], F.col("_bucket").alias("_b"), F.coalesce(F.sum("_total").over(before), F.lit(0)).cast("long").alias("_start"))
    inside = W.partitionBy(*group, "_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    own = dealt.withColumn("_own", F.coalesce(F.sum(value).over(inside), F.lit(0)).cast("long"))
    on = [own[c].eqNullSafe(starts[f"_g_{c}"]) for c in group] + [own["_bucket"] == starts["_b"]]
    return own.join(starts, on).withColumn(to, F.col("_own") + F.col("_start")).drop("_own", "_start", "_b", "_bucket", *[f"_g_{c}" for c in group])
