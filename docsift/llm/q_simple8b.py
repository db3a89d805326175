"""op3: every document's token ids through Simple-8b files."""

import uuid

from pyspark.sql import DataFrame, SparkSession

from docsift.llm._spark import shared_dir, table
from docsift.llm.simple8b import digest, read_token_files, write_token_files


def op3_simple8b_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/docsift-tokens-{uuid.uuid4().hex}"
    write_token_files(table(spark, sf_dir, "documents"), path, end_id=2)
    return read_token_files(spark, path, "ids_crc32 long", digest)
