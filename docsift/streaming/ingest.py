"""Folders watched as a stream: each micro-batch of new files is appended to a store.

The file source's checkpoint remembers what was read.  A micro-batch is a batch of the
store named after the stream and its number, so one that is tried again adds nothing twice.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docsift.functions.text import extension, file_name
from docsift.sources.files import with_text
from docsift.sources.store import append


def watch(spark: SparkSession, folder: str, store: str, checkpoint: str, files_per_batch: int = 1000) -> StreamingQuery:
    schema = "path string, modificationTime timestamp, length long, content binary"
    raw = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "true").load(folder)

    def add(batch: DataFrame, number: int) -> None:
        # the stream's own id, the same after a restart from its checkpoint
        stream = json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]
        files = batch.select("path", file_name(F.col("path")).alias("name"), extension(F.col("path")).alias("ext"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), "content")
        append(with_text(files), store, batch=f"{stream}-{number}")

    return raw.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
