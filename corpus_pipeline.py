"""Raw documents to packed sequences, a stage at a time.

Each stage's rows are written as Parquet in the shared folder and read again, so
a lost executor repeats work of one stage only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docsift.llm import stages
from docsift.llm._spark import staged, table

STAGES = [
    ("quality rules", stages.quality),
    ("near-duplicates", stages.near_dedup),
    ("personal data", stages.pii),
    ("mixing", stages.mixing),
    ("packing", stages.packing),
]

#: Near-duplicate groups, tokens and packings are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        rows = staged(stage(spark, rows, sf_dir), name.replace(" ", "-"))
    return rows
