"""Duplicate files of a folder, read as little as possible.

Sizes come from the listing; a size met once is never read.  The others are cut into
ranges of ``RANGE`` bytes, hashed apart by as many tasks, and a file's digest is
that of its ranges' digests in order.  So no file has to fit in a row, or in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.functions.text import file_name

RANGE = 64 << 20
#: Bytes held at once.
STEP = 1 << 20


def _opened(path: str):
    """A local file or one of a store that pyarrow knows (hdfs, s3, gs), for reading from any place."""
    from urllib.parse import unquote

    from pyarrow import fs

    if path.startswith("/"):
        return fs.LocalFileSystem().open_input_file(path)
    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file(unquote(path.removeprefix("file:").replace("//", "", 1) if path.startswith("file://") else path.removeprefix("file:")))
    store, at = fs.FileSystem.from_uri(path)
    return store.open_input_file(at)


def same_sized(files: DataFrame, size: str) -> DataFrame:
    """Files whose size another one has, too."""
    often = files.groupBy(F.col(size).alias("_size")).agg(F.count("*").alias("_n")).where("_n > 1").select("_size")
    return files.join(often, F.col(size) == F.col("_size"), "left_semi")


def range_digests(files: DataFrame, path: str, size: str, length: int | None = None) -> DataFrame:
    """path, size, at, digest, read (bytes) of every range; an unreadable file gives rows without a digest, and its error."""
    length = length or RANGE
    last = F.greatest(F.floor((F.col(size) - 1) / length), F.lit(0))
    ranges = files.select(F.col(path).alias("path"), F.col(size).cast("long").alias("size"), F.explode_outer(F.sequence(F.lit(0).cast("long"), last)).alias("at"))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for p, n, at in zip(b["path"], b["size"], b["at"]):
                digest, read, error, left = hashlib.sha256(), 0, None, int(min(length, n - at * length))
                try:
                    if left > 0:
                        with _opened(p) as f:
                            f.seek(int(at * length))
                            while left and (part := f.read(min(STEP, left))):
                                digest.update(part)
                                read, left = read + len(part), left - len(part)
                except OSError as e:
                    error = f"{type(e).__name__}: {e}"
                if left > 0 and error is None:
                    error = "shorter than listed"
                out.append((p, n, at, None if error else digest.hexdigest(), read, error))
            yield pd.DataFrame(out, columns=["path", "size", "at", "digest", "read", "error"])

    # by range, so that one large file is the work of many tasks
    return ranges.repartition(F.col("path"), F.col("at")).mapInPandas(rows, "path string, size long, at long, digest string, read long, error string")


def digests(ranges: DataFrame) -> DataFrame:
    """path, size, hash of files all of whose ranges were read: a hash of the ranges' digests in order, 64 letters for each."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "digest"))), lambda x: x["digest"]), "")
    done = ranges.groupBy("path", "size").agg(joined.alias("j"), F.bool_or(F.col("error").isNotNull()).alias("bad")).where("not bad")
    return done.select("path", "size", F.sha2("j", 256).alias("hash"))


def duplicate_files(files: DataFrame, path: str = "path", size: str = "size") -> DataFrame:
    """size, hash, n, name, path of files that have a duplicate, the largest groups first."""
    found = digests(range_digests(same_sized(files, size), path, size))
    groups = found.groupBy("size", "hash").agg(F.count("*").alias("n")).where("n > 1")
    return found.join(groups, ["size", "hash"]).select("size", "hash", "n", file_name(F.col("path")).alias("name"), "path").orderBy(F.desc("n"), "hash", "path")
