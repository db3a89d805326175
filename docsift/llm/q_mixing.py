"""op5: documents mixed by source, smaller sources up to twice."""

from pyspark.sql import DataFrame, SparkSession

from docsift.llm._spark import table
from docsift.llm.mixing import schedule

#: Production parameters: the flattest mixture that shows no source more than twice and the largest once.
REPEATS, SEED = 2.0, 20


def op5_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule(table(spark, sf_dir, "documents"), seed=SEED, repeats=REPEATS)
