"""A commit log for tables that grow by batches.

A batch's rows are written below ``<part>/batch=<id>``, part by part; one row in
``commits/version=<n>`` then makes all of it visible at once.  Readers take the
batches of one version, so a batch that ended between two parts is never seen, and
is written over when it is tried again under the same id.

One writer at a time: a second one that meets the same version fails.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMMIT = "batch string, parts array<string>, stats map<string,double>, at timestamp"


class Conflict(RuntimeError):
    """Another writer has committed the version that this one was to be."""


@dataclass(frozen=True)
class Snapshot:
    """The batches of a version, in the order of their commits, with the parts and numbers of each."""

    root: str
    version: int
    batches: tuple[str, ...] = ()
    parts: dict[str, tuple[str, ...]] = field(default_factory=dict)
    stats: tuple[dict[str, float], ...] = ()

    def total(self, name: str) -> float:
        """A number that batches add up."""
        return sum(s.get(name, 0.0) for s in self.stats)

    def paths(self, part: str) -> list[str]:
        return [f"{self.root}/{part}/batch={b}" for b in self.batches if part in self.parts[b]]

    def read(self, spark: SparkSession, part: str, schema: str | None = None) -> DataFrame | None:
        """The rows of a part; None if no batch has it."""
        paths = self.paths(part)
        if not paths:
            return None
        reader = spark.read.option("basePath", f"{self.root}/{part}")
        return (reader.schema(f"{schema}, batch string") if schema else reader).parquet(*paths).drop("batch")


def snapshot(spark: SparkSession, root: str, version: int | None = None) -> Snapshot:
    """The latest version, or the one given; version 0 is empty."""
    try:
        log = spark.read.schema(f"{COMMIT}, version int").parquet(f"{root}/commits")
    except AnalysisException:
        return Snapshot(root, 0)
    if version is not None:
        log = log.where(F.col("version") <= version)
    rows = log.orderBy("version").collect()  # a row for each batch
    if version and (not rows or rows[-1]["version"] != version):
        raise ValueError(f"no version {version} of {root}")
    return Snapshot(root, rows[-1]["version"] if rows else 0, tuple(r["batch"] for r in rows), {r["batch"]: tuple(r["parts"]) for r in rows}, tuple(r["stats"] for r in rows))


def commit(spark: SparkSession, before: Snapshot, batch: str, parts: list[str], stats: dict[str, float]) -> Snapshot:
    """Make a batch's parts visible as the version after ``before``."""
    if not re.fullmatch(r"[A-Za-z0-9._-]+", batch):
        raise ValueError(f"not a batch id: {batch!r}")
    at = f"{before.root}/commits/version={before.version + 1}"
    row = spark.createDataFrame([(batch, parts, {k: float(v) for k, v in stats.items()})], "batch string, parts array<string>, stats map<string,double>").withColumn("at", F.current_timestamp())
    mode = "error"
    try:
        if spark.read.schema(COMMIT).parquet(at).isEmpty():
            mode = "overwrite"  # a writer ended before its row was there
    except AnalysisException:
        pass
    try:
        row.coalesce(1).write.mode(mode).parquet(at)
    except AnalysisException as e:
        raise Conflict(f"version {before.version + 1} of {before.root} is there") from e
    return snapshot(spark, before.root, before.version + 1)
