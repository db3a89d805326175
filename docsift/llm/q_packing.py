"""op10: all documents into sequences of 4096 tokens."""

from pyspark.sql import DataFrame, SparkSession

from docsift.llm._spark import table
from docsift.llm.packing import pack_documents


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), capacity=4096, end_id=1)
