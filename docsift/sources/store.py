"""Chunk stores: chunks with their vectors and origins, a lexical index, filters of what is held, a manifest of files.

A store grows by batches.  A batch writes its part of each of these tables, and one
row in the commit log makes all of them visible together (``docsift.sources.versions``), so a
search or an append never sees half a batch.  Folders below ``staging`` are of no use
once their batch is committed.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, fields, replace

import numpy as np
import pandas as pd
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.functions.text import normalize_text, text_sha1, tokens
from docsift.operators import ivf, membership, postings, retrieval
from docsift.operators.dedup import duplicate_ratio, first_seen, new_files
from docsift.operators.metadata import common_root, with_running_id, with_source
from docsift.operators.models import Model, with_result
from docsift.operators.sections import chunks
from docsift.sources import versions
from docsift.sources.files import existing, scan, with_text


@dataclass(frozen=True)
class StoreConfig:
    model_name: str = "hashing-384"
    dim: int = 384
    chunk_size: int = 900
    hard_max: int = 1300
    min_chunk_len: int = 80
    max_dup_ratio: float = 0.8
    normalize_embeddings: bool = True
    #: "exact", or "ivf" for lists around centroids; ``lists`` 0 is the root of the first batch's chunks, ``probes`` is measured for ``recall``.
    index_type: str = "exact"
    lists: int = 0
    probes: int = 0
    recall: float = 0.95
    overlap: int = 0
    #: Candidates that a model scores, and the weight of its score.
    rerank_top: int = 40
    rerank_weight: float = 0.7
    created_at: float = 0.0
    base_path: str = ""


def configured(spark: SparkSession) -> StoreConfig:
    """A configuration whose fields the session may set, as ``spark.docsift.store.<field>``."""
    given = {f.name: spark.conf.get(f"spark.docsift.store.{f.name}", None) for f in fields(StoreConfig)}
    as_ = {"int": int, "float": float, "bool": lambda v: v.lower() == "true", "str": str}
    return StoreConfig(**{f.name: as_[f.type](given[f.name]) for f in fields(StoreConfig) if given[f.name] is not None})


def hashing_embedder(dim: int) -> Callable[[pd.Series], pd.Series]:
    """Signed feature hashing to unit vectors: the stand-in where no model is at hand."""

    def embed(token_lists: pd.Series) -> pd.Series:
        def one(words) -> list[float]:
            v = np.zeros(dim, np.float64)
            for w in words:
                h = xxhash.xxh64_intdigest(w)
                v[h % dim] += 1.0 if h >> 63 else -1.0
            n = np.linalg.norm(v)
            return (v / n if n else v).astype(np.float32).tolist()

        return token_lists.map(one)

    return embed


def embedded(df: DataFrame, text: str, config: StoreConfig, embed: Callable[[pd.Series], pd.Series] | Model | None = None) -> DataFrame:
    """Adds embedding: by feature hashing, by a function of texts, or by a model that workers hold."""
    if isinstance(embed, Model):
        return with_result(df, text, replace(embed, result="array<float>"), "embedding")
    model = F.pandas_udf(embed or hashing_embedder(config.dim), "array<float>")
    return df.withColumn("embedding", model(tokens(F.col(text)) if embed is None else F.col(text)))


def _chunked(files: DataFrame, config: StoreConfig) -> DataFrame:
    clean = files.withColumn("text", normalize_text(F.col("text"))).where("text != ''")
    cut = chunks(clean, ["path", "mtime", "size"], target=config.chunk_size, most=config.hard_max, least=config.min_chunk_len)
    return cut.withColumn("chunk_hash", text_sha1(F.col("chunk"))).withColumn("chunk_uid", F.xxhash64("path", "chunk_id"))


def _staged(df: DataFrame, store: str, name: str) -> DataFrame:
    at = f"{store}/staging/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def _described(cut: DataFrame, store: str, config: StoreConfig, first: int) -> DataFrame:
    """Adds id (running, over all batches), where chunks come from, their lengths, and the time."""
    rows = with_source(cut, "path", "size", config.base_path).withColumns({"abs_path": F.col("path"), "chunk_len": F.length("chunk"), "created_at": F.lit(time.time())})
    return with_running_id(rows, ["path", "chunk_id"], f"{store}/staging/ids-{uuid.uuid4().hex}", first=first)


def add_chunks(rows: DataFrame, store: str, before: versions.Snapshot, batch: str, config: StoreConfig, files: DataFrame | None = None) -> versions.Snapshot:
    """Write and commit a batch of chunks (id, chunk, chunk_hash, embedding, and any others), and the manifest rows of its files."""
    spark = rows.sparkSession
    place = lambda part: f"{store}/{part}/batch={batch}"
    rows.write.mode("overwrite").parquet(place("chunks"))
    written = spark.read.schema(rows.schema).parquet(place("chunks"))
    held = postings.write(written, "id", "chunk", place("postings"))
    membership.filter_of(written.select("chunk_hash"), "chunk_hash", held.texts).write.mode("overwrite").parquet(place("filters"))
    parts = ["chunks", "postings", "filters"]
    if config.index_type == "ivf" and held.texts:
        centres = _centres(written, store, config)
        ivf.write(written, "id", "embedding", centres, place("vectors"))
        parts.append("vectors")
    if files is not None:
        files.select("path", F.col("mtime").cast("long").alias("mtime"), F.col("size").cast("long").alias("size")).write.mode("overwrite").parquet(place("manifest"))
        parts.append("manifest")
    return versions.commit(spark, before, batch, parts, {"chunks": held.texts, "words": held.words})


def _centres(written: DataFrame, store: str, config: StoreConfig) -> np.ndarray:
    """The store's centroids; the first batch with chunks fits them."""
    spark = written.sparkSession
    try:
        return ivf.load(spark, f"{store}/centres")
    except AnalysisException:
        centres = ivf.centroids(written, "id", "embedding", config.dim, config.lists or None)
        ivf.save(spark, centres, f"{store}/centres")
        return centres


def build(files: DataFrame, store: str, config: StoreConfig = StoreConfig(), embed=None) -> None:
    """Write a store for files (path, mtime, size, text)."""
    spark = files.sparkSession
    root = config.base_path or common_root(files, "path").first()[0] or ""
    config = replace(config, base_path=root, created_at=config.created_at or time.time())
    before = versions.snapshot(spark, store)
    if not before.version:
        rows = _described(_chunked(files, config), store, config, 0)
        before = add_chunks(embedded(rows, "chunk", config, embed), store, before, "build", config)
    if "vectors" in before.parts["build"] and not config.probes:
        config = replace(config, probes=ivf.probes_for(_vectors(spark, before), ivf.load(spark, f"{store}/centres"), config.recall))
    # the configuration comes last: a store is valid once it has one
    spark.createDataFrame([asdict(config)]).write.mode("overwrite").parquet(f"{store}/config")


def _vectors(spark: SparkSession, state: versions.Snapshot) -> DataFrame | None:
    """key, vector, list of all batches; None if there are none."""
    paths = state.paths("vectors")
    out = None
    for p in paths:  # lists are folders inside a batch's folder
        rows = spark.read.parquet(p).select("key", "vector", "list")
        out = rows if out is None else out.union(rows)
    return out


#: What a folder must hold to be a store.
PARTS = ("chunks", "config")


def catalog(paths: DataFrame, path: str, parts: tuple[str, ...] = PARTS) -> DataFrame:
    """name, valid for each folder of a listing (paths folder/part or folder/part/...), in order of names."""
    cut = F.split(F.col(path), "/")
    held = [F.max(F.col("_part") == p) for p in parts]
    valid = held[0]
    for x in held[1:]:
        valid = valid & x
    rows = paths.select(F.get(cut, 0).alias("name"), F.get(cut, 1).alias("_part")).where("_part is not null")
    return rows.groupBy("name").agg(valid.alias("valid")).orderBy("name")


def stores_in(spark: SparkSession, folder: str) -> DataFrame:
    """The stores and other folders directly below ``folder``."""
    at = folder.rstrip("/")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(at).select("path")
    return catalog(found.select(F.substring_index("path", f"{at.removeprefix('file://')}/", -1).alias("path")), "path")


def config_of(spark: SparkSession, store: str) -> StoreConfig:
    return StoreConfig(**spark.read.parquet(f"{store}/config").first().asDict())


def read(spark: SparkSession, store: str, dim: int | None = None, version: int | None = None) -> DataFrame:
    """The chunks of a store, by default of its latest version; ValueError if its vectors are not of the size expected."""
    if dim is not None and (own := config_of(spark, store).dim) != dim:
        raise ValueError(f"the store has vectors of {own} numbers, not {dim}")
    return versions.snapshot(spark, store, version).read(spark, "chunks")


def manifest(spark: SparkSession, store: str, version: int | None = None) -> DataFrame:
    """Files of appends; empty if there were none."""
    rows = versions.snapshot(spark, store, version).read(spark, "manifest", "path string, mtime long, size long")
    return spark.createDataFrame([], "path string, mtime long, size long") if rows is None else rows


#: Kinds of files that an append takes; a fixed value.
APPENDED = (".txt", ".md", ".pdf", ".docx")


def append(files: DataFrame, store: str, embed=None, batch: str | None = None) -> int:
    """Add new files' new chunks; files that mostly repeat others are left out.  Returns the chunks added.

    A chunk repeats if the store or an earlier chunk of the batch has its folded text; a path
    named twice is taken once.  Filters of the store's hashes are asked first, and only chunks that
    these cannot rule out meet its rows.  A ``batch`` that the store already has adds nothing.
    """
    spark, config = files.sparkSession, config_of(files.sparkSession, store)
    before, batch = versions.snapshot(spark, store), batch or uuid.uuid4().hex
    if batch in before.batches:
        return 0
    seen = before.read(spark, "manifest", "path string, mtime long, size long")
    fresh = files.dropDuplicates(["path"]) if seen is None else new_files(files, seen).dropDuplicates(["path"])
    cut = _staged(_chunked(fresh, config), store, "cut")
    known = membership.known_among(cut, "chunk_hash", before.read(spark, "chunks").select("chunk_hash"), before.read(spark, "filters"))
    known = _staged(known.distinct(), store, "known")
    accepted = duplicate_ratio(cut, "path", "chunk", ["path", "chunk_id"], config.max_dup_ratio, known).where("not skipped").select("path")
    new = first_seen(cut.join(accepted, "path", "left_semi"), "chunk", ["path", "chunk_id"], known)
    rows = _described(cut.join(new.select("path", "chunk_id"), ["path", "chunk_id"], "left_semi"), store, config, int(before.total("chunks")))
    took = rows.select("path", "mtime", "size").distinct()
    after = add_chunks(embedded(rows, "chunk", config, embed), store, before, batch, config, took)
    return int(after.stats[-1]["chunks"])


def append_paths(spark: SparkSession, paths: list[str], store: str, embed=None, batch: str | None = None, admitted: tuple[str, ...] = APPENDED) -> int:
    """``append`` of files and of all files below folders; what is not there, or of another kind, is left out before anything is read."""
    some = existing(spark, paths)
    return append(with_text(scan(spark, some, admitted)), store, embed, batch) if some else 0


def search(spark: SparkSession, store: str, query: str, query_vector: list[float], file: str = "file_name", score=None, k: int = 30, top_k: int = 8, min_score: float = 0.15, per_file: int = 2, w_dense: float = 0.65, w_sparse: float = 0.35, version: int | None = None, exact: bool = False) -> DataFrame:
    """Dense and lexical candidates of a store, mixed, reranked by ``score`` if given, and gated.

    Postings of the query's words are read, and vectors of the lists probed (all with ``exact``, or
    where the store has no lists); then the chunks of at most 2k candidates, by id.
    """
    config, state = config_of(spark, store), versions.snapshot(spark, store, version)
    if len(query_vector) != config.dim:
        raise ValueError(f"the store has vectors of {config.dim} numbers, the query {len(query_vector)}")
    rows, lists = state.read(spark, "chunks"), _vectors(spark, state)
    if lists is None:
        dense = retrieval.dense_top_k(rows, "id", "embedding", query_vector, k)
    else:
        centres = ivf.load(spark, f"{store}/centres")
        dense = ivf.top_k(lists, centres, query_vector, k, None if exact else config.probes or None).withColumnRenamed("key", "id")
    sparse = postings.top_k(state.read(spark, "postings"), postings.Statistics(int(state.total("chunks")), int(state.total("words"))), query, k).withColumnRenamed("key", "id")
    found = retrieval.hybrid(dense, sparse, "id", w_dense, w_sparse).withColumn("mix", F.round("mix", 6))
    best = found.collect()  # at most 2k
    mixed = spark.createDataFrame(best, found.schema)
    hits = rows.drop("embedding").where(F.col("id").isin([r["id"] for r in best])).join(F.broadcast(mixed), "id")
    reranked = retrieval.rerank(hits, "id", "chunk", score, config.rerank_top, config.rerank_weight).withColumn("final", F.round("final", 8))
    return retrieval.gated(reranked, "id", file, "chunk", top_k, min_score, per_file, "final")
