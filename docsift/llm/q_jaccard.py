"""op11: documents linked at 85 % of their four-word shingles."""

from pyspark.sql import DataFrame, SparkSession

from docsift.llm._spark import table
from docsift.llm.jaccard import joined


def op11_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(table(spark, sf_dir, "documents"), width=4, percent=85)
