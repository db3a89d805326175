"""op2: near duplicates of documents, four-word shingles."""

from pyspark.sql import DataFrame, SparkSession

from docsift.llm._spark import table
from docsift.llm.minhash import near_duplicates


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)
