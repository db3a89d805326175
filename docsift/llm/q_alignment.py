"""op13: documents by a byte-level and a piece vocabulary, aligned by bytes."""

from pyspark.sql import DataFrame, SparkSession

from docsift.llm._spark import table
from docsift.llm.alignment import document_alignment


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_alignment(table(spark, sf_dir, "documents"))
