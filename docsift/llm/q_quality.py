"""op8: quality rules over documents; documents labelled good are the trusted target."""

from pyspark.sql import DataFrame, SparkSession

from docsift.llm._spark import table
from docsift.llm.quality import quality_rules


def trusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")


def op8_llr_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), trusted(spark, sf_dir))
