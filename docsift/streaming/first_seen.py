"""A stream of chunks that keeps, for each text, whether it has been seen: repeats are known without the store.

State is keyed by a chunk's hash, so what a micro-batch costs follows the batch, not the
store behind it.  Each micro-batch is a batch of the commit log, under the stream's own id: chunks
met for the first time, and for each file how many chunks it had and how many repeated.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docsift.functions.text import extension, file_name, fold_for_hash, normalize_text, text_sha1
from docsift.operators.sections import chunks
from docsift.sources import versions
from docsift.sources.files import with_text

ROWS = "path string, chunk_id int, chunk_hash string, chunk string, dup boolean"
COUNTERS = "path string, n_chunks long, n_dup long"


def marked(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """A hash's chunks of one micro-batch, with dup; the first by path and place of a hash not seen before is none.

    Parts pass by one at a time, so a text that a third of all chunks have is never held.  A blank text has no hash and repeats nothing.
    """
    first = None
    for p in parts:
        if key[0] == "":
            yield p.assign(dup=False)
            continue
        p = p.assign(dup=True)
        if not state.exists:
            p = (p if first is None else pd.concat([first, p])).sort_values(["path", "chunk_id"], kind="stable")
            first, p = p.iloc[:1], p.iloc[1:]
        if len(p):
            yield p
    if first is not None:
        state.update((True,))
        yield first.assign(dup=False)


def watch(spark: SparkSession, folder: str, to: str, checkpoint: str, files_per_batch: int = 1000, target: int = 900, most: int = 1300, least: int = 80) -> StreamingQuery:
    """Write the chunks and counters of files that come to ``folder`` below ``to``."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    raw = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "true").load(folder)
    texts = with_text(raw.select("path", file_name(F.col("path")).alias("name"), extension(F.col("path")).alias("ext"), "content"))
    cut = chunks(texts.withColumn("text", normalize_text(F.col("text"))).where("text != ''"), ["path"], "text", target, most, least)
    hashed = cut.select("path", "chunk_id", F.when(fold_for_hash(F.col("chunk")) == "", "").otherwise(text_sha1(F.col("chunk"))).alias("chunk_hash"), "chunk")
    rows = hashed.groupBy("chunk_hash").applyInPandasWithState(marked, ROWS, "seen boolean", "append", GroupStateTimeout.NoTimeout)

    def add(batch: DataFrame, number: int) -> None:
        name = f"{json.loads(spark.read.text(f'{checkpoint}/metadata').first()[0])['id']}-{number}"
        before = versions.snapshot(spark, to)
        if name in before.batches:
            return
        at = f"{to}/marked/batch={name}"
        batch.write.mode("overwrite").parquet(at)
        new = spark.read.schema(ROWS).parquet(at)
        new.where("not dup").drop("dup").write.mode("overwrite").parquet(f"{to}/chunks/batch={name}")
        new.groupBy("path").agg(F.count("*").alias("n_chunks"), F.count_if("dup").alias("n_dup")).write.mode("overwrite").parquet(f"{to}/counters/batch={name}")
        versions.commit(spark, before, name, ["chunks", "counters"], {"chunks": new.where("not dup").count()})

    return rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counters(spark: SparkSession, to: str) -> DataFrame:
    """path, n_chunks, n_dup of all files so far."""
    rows = versions.snapshot(spark, to).read(spark, "counters", COUNTERS)
    rows = spark.createDataFrame([], COUNTERS) if rows is None else rows
    return rows.groupBy("path").agg(F.sum("n_chunks").alias("n_chunks"), F.sum("n_dup").alias("n_dup"))
