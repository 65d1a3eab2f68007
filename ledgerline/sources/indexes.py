"""Chunk indexes and their vectors: several as one, resumable building, payloads."""

from __future__ import annotations

import base64
import gzip
import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files


def stacked(indexes: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(chunk tables, vector tables) of several indexes as one: (index_no, chunk_id, doc_id, v, ...).

    Each chunk has one vector of its own index and each vector a chunk, else this fails.
    """
    out = None
    for i, (chunks, vectors) in enumerate(indexes):
        met = chunks.join(vectors, "chunk_id", "full_outer").withColumn("index_no", F.lit(i))
        whole = F.when(F.col("doc_id").isNotNull() & F.col("v").isNotNull(), F.col("doc_id")).otherwise(F.raise_error(F.concat(F.lit(f"index {i}: no pair for chunk "), F.col("chunk_id").cast("string"))))
        met = met.withColumn("doc_id", whole)
        out = met if out is None else out.unionByName(met, allowMissingColumns=True)
    return out


def embed_shards(chunks: DataFrame, path: str, model: Callable[[list[str]], list[list[float]]], shards: int, settings: dict) -> int:
    """Vectors of chunks (chunk_id, text) by shard; shards that are there under the same settings are left, the number made is given.

    Spark commits a shard's files as a whole, so a broken run leaves no half shard behind.
    """
    spark = chunks.sparkSession
    side = f"{path}.basis.json"
    if files.exists(spark, side):
        files.check_basis(json.loads(files.read_text(spark, side)), settings)
    else:
        files.write_text(spark, side, json.dumps(settings, sort_keys=True))
    keyed = chunks.withColumn("shard", F.pmod(F.xxhash64("chunk_id"), F.lit(shards)).cast("int"))
    done = [s for s in range(shards) if files.exists(spark, f"{path}/shard={s}/_SUCCESS")]
    made = 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("chunk_id"), pa.array(model(b.column("text").to_pylist()), pa.list_(pa.float32()))], names=["chunk_id", "v"])

    for s in range(shards):
        if s not in done:
            part = keyed.where(F.col("shard") == s).select(F.col("chunk_id").cast("bigint").alias("chunk_id"), "text")
            part.mapInArrow(run, "chunk_id bigint, v array<float>").write.mode("overwrite").parquet(f"{path}/shard={s}")
            made += 1
    return made


def build(docs: DataFrame, path: str, chunk: Callable[[DataFrame], DataFrame], model: Callable[[list[str]], list[list[float]]], settings: dict, shards: int = 4) -> dict:
    """Chunks of documents and their vectors under a folder, with what made them; gives the numbers.

    chunk: documents -> (chunk_id, doc_id, text). Documents that changed since (by their digest) or other
    settings stop it; a broken run goes on where it stopped; as many vectors as chunks have to come out.
    """
    spark = docs.sparkSession
    basis = settings | {"documents": files.table_digest(docs)}
    if not files.exists(spark, f"{path}/chunks.basis.json"):
        files.with_basis(chunk(docs), f"{path}/chunks", basis, overwrite=True)
    chunks = files.read_basis(spark, f"{path}/chunks", basis)
    embed_shards(chunks, f"{path}/vectors", model, shards, basis)
    n = chunks.count()
    vectors(spark, f"{path}/vectors", n)
    meta = {"n_chunks": n, "n_docs": chunks.select("doc_id").distinct().count(), "basis": files.digest(basis)}
    files.write_guarded(spark, f"{path}/meta.json", json.dumps(meta, sort_keys=True))
    return meta


def zipped(chunks: DataFrame, found: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Rows of two tables that belong together by position, as a join on the number that stands for it; the tables have to have equal lengths."""
    a, b = chunks.count(), found.count()
    met = chunks.join(found, key)
    if a != b or met.count() != a:
        raise ValueError(f"{a} rows against {b}")
    return met


def vectors(spark: SparkSession, path: str, n: int) -> DataFrame:
    """All shards' vectors; fails unless there are n."""
    out = spark.read.schema("chunk_id bigint, v array<float>, shard int").parquet(path).drop("shard")
    if (found := out.count()) != n:
        raise ValueError(f"{found} vectors, {n} chunks")
    return out


def packed(value) -> str:
    """Compact JSON, gzipped, in base64."""
    return base64.b64encode(gzip.compress(json.dumps(value, ensure_ascii=False, separators=(",", ":")).encode("utf-8"), mtime=0)).decode("ascii")


def unpacked(text: str):
    return json.loads(gzip.decompress(base64.b64decode(text)))
