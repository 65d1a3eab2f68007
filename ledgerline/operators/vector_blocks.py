"""A saved vector index whose blocks end an exact search early.

Every vector goes to the nearest of some centers (fitted on a bounded sample; they shape blocks, never
results), and those of a center to blocks of about BLOCK rows. A block knows its mean, the largest distance
from it and the largest norm, so no vector in it scores more against a query than mean * query + radius *
|query|, or norm * |query|.

A search first takes each query's POOL blocks of the highest bound, and twice as many until these hold k
documents (or there are no more): the score of the k-th one is what all others have to reach. Then it goes
through all blocks whose bound does. Both steps are tables of (query, block), the second as long as what
cannot be skipped. Queries are met with bounds in passes, each written before the next one begins. Scores
are rounded before they rank, ties end with the id.

Vectors have one dimension in an index; others, and null ones, are refused. Repeated chunks count each
time; a document's score is that of its best chunk.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.scratch import scratch, shared_dir
from ..sources.tables import table
from . import dense

#: Rows of a block, rows of the sample, centers at most, rounds of fitting; blocks of the first pool; queries of a pass.
BLOCK, SAMPLE, CENTERS, ROUNDS, POOL, PASS = 1024, 20_000, 256, 4, 4, 1 << 13
#: Scores are rounded; a bound this near is still looked at.
NEAR = 1e-5
BLOCKS = "center int, part int, n int, mean binary, radius double, norm double, chunks array<bigint>, docs array<bigint>, vectors binary"


def _nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.argmin((centers**2).sum(1) - 2 * (x @ centers.T), axis=1)


def fit(chunks: DataFrame, n_centers: int) -> np.ndarray:
    """Centers of the SAMPLE vectors of the smallest hashes."""
    rows = chunks.select("chunk", "v").orderBy(F.xxhash64("chunk"), "chunk").limit(SAMPLE).select("v").toArrow().column("v").to_pylist()
    if not rows:
        return np.zeros((0, 0))
    x = np.array(rows, np.float64)
    centers = x[np.linspace(0, len(x) - 1, min(n_centers, len(x))).astype(int)]
    for _ in range(ROUNDS):
        of = _nearest(x, centers)
        sums, n = np.zeros_like(centers), np.bincount(of, minlength=len(centers))
        np.add.at(sums, of, x)
        centers = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centers)
    return centers


def build(chunks: DataFrame, block: int = BLOCK) -> DataFrame:
    """chunks (chunk, doc, v) -> one row a block (see BLOCKS); to be written."""
    sizes = chunks.agg(F.count("*").alias("n"), F.count("v").alias("known"), F.min(F.size("v")).alias("low"), F.max(F.size("v")).alias("high")).first()
    if sizes.n != sizes.known or sizes.low != sizes.high:
        raise ValueError("vectors of one dimension are wanted, none null")
    centers = fit(chunks, max(1, min(CENTERS, -(-sizes.n // block))))

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            yield pa.RecordBatch.from_arrays([b.column("chunk"), b.column("doc"), b.column("v"), pa.array(_nearest(x, centers).astype(np.int32))], names=["chunk", "doc", "v", "center"])

    def blocked(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks().sort_by("chunk")
        x = rows.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1)
        mean = x.mean(0)
        return pa.Table.from_pylist(
            [
                {
                    "center": rows.column("center")[0].as_py(), "part": rows.column("part")[0].as_py(), "n": len(x), "mean": mean.tobytes(),
                    "radius": float(np.sqrt(((x - mean) ** 2).sum(1).max())), "norm": float(np.sqrt((x**2).sum(1).max())),
                    "chunks": rows.column("chunk").to_pylist(), "docs": rows.column("doc").to_pylist(), "vectors": np.ascontiguousarray(x).tobytes(),
                }
            ],
            schema=pa.schema([("center", pa.int32()), ("part", pa.int32()), ("n", pa.int32()), ("mean", pa.binary()), ("radius", pa.float64()), ("norm", pa.float64()), ("chunks", pa.list_(pa.int64())), ("docs", pa.list_(pa.int64())), ("vectors", pa.binary())]),
        )

    each = scratch(chunks.select("chunk", "doc", "v").mapInArrow(assigned, "chunk bigint, doc bigint, v array<double>, center int"), "assigned")
    counts = each.groupBy("center").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))  # a row a center
    dealt = each.join(F.broadcast(counts), "center").withColumn("part", F.pmod(F.xxhash64("chunk"), F.col("parts")).cast("int")).drop("parts")
    return dealt.groupBy("center", "part").applyInArrow(blocked, BLOCKS)


def _bounds(blocks: DataFrame, asked: pa.Table, best: int | None) -> tuple[DataFrame, object]:
    """(query, center, part, bound): of each task the `best` blocks of each query, or those whose bound reaches the query's least."""
    q = np.array(asked.column("qv").to_pylist(), np.float64).reshape(asked.num_rows, -1)
    least = None if best else asked.column("least").to_numpy()
    sent = blocks.sparkSession.sparkContext.broadcast((asked.column("query").to_numpy(), q, np.sqrt((q**2).sum(1)), least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q, size, least = sent.value
        for b in batches:
            means = np.array([np.frombuffer(m) for m in b.column("mean").to_pylist()]).reshape(b.num_rows, -1)
            bound = np.minimum(means @ q.T + b.column("radius").to_numpy()[:, None] * size, b.column("norm").to_numpy()[:, None] * size) + NEAR
            if best:
                row = dense.first_rows(bound, best)
                column = np.broadcast_to(np.arange(len(names)), row.shape)
                row, column = row.ravel(), column.ravel()
            else:
                row, column = np.nonzero(bound >= least)
            yield pa.RecordBatch.from_arrays([pa.array(names[column]), b.column("center").take(pa.array(row)), b.column("part").take(pa.array(row)), pa.array(bound[row, column])], names=["query", "center", "part", "bound"])

    return blocks.select("center", "part", "mean", "radius", "norm").mapInArrow(run, "query bigint, center int, part int, bound double"), sent


def _scored(blocks: DataFrame, pairs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """pairs (query, center, part) -> (query, doc, score): the k best documents of each query in each block, by their best chunk there."""
    asked = pairs.join(queries.select("query", "qv"), "query").select(F.col("center").alias("of"), F.col("part").alias("at"), "query", "qv")

    def score(rows: pa.Table, asked: pa.Table) -> pa.Table:
        names, docs, scores = [], [], []
        if rows.num_rows and asked.num_rows:
            q = np.array(asked.column("qv").to_pylist(), np.float64)
            own = asked.column("query").to_numpy()
            for ids, of, data in zip(rows.column("chunks"), rows.column("docs"), rows.column("vectors")):
                chunk, doc = ids.values.to_numpy(), of.values.to_numpy()
                s = np.round(np.frombuffer(data.as_py()).reshape(len(chunk), -1) @ q.T, 6)
                s[chunk[:, None] == own[None, :]] = -np.inf  # no query meets itself
                known, at = np.unique(doc, return_inverse=True)
                most = np.full((len(known), len(own)), -np.inf)
                np.maximum.at(most, at, s)
                row = dense.first_rows(most, k)
                column = np.broadcast_to(np.arange(len(own)), row.shape)
                real = most[row, column] > -np.inf
                names.append(own[column[real]])
                docs.append(known[row[real]])
                scores.append(most[row, column][real])
        joined = lambda x, t: pa.array(np.concatenate(x).astype(t) if x else np.zeros(0, t))
        return pa.table({"query": joined(names, np.int64), "doc": joined(docs, np.int64), "score": joined(scores, np.float64)})

    met = blocks.select("center", "part", "chunks", "docs", "vectors").groupBy("center", "part").cogroup(asked.groupBy("of", "at"))
    return met.applyInArrow(score, "query bigint, doc bigint, score double")


def _top(scored: DataFrame, k: int) -> DataFrame:
    return dense.top(scored.groupBy("query", "doc").agg(F.max("score").alias("score")), k, "doc")


def search(blocks: DataFrame, queries: DataFrame, k: int, pool: int = POOL) -> tuple[DataFrame, dict]:
    """blocks: a written index; queries (query, qv) -> ((query, doc, score, rank), how many pairs of query and block there are and were scored)."""
    spark = blocks.sparkSession
    n_blocks, n = blocks.count(), queries.count()
    path = f"{shared_dir(spark)}/vectors-{uuid.uuid4().hex}"
    parts, scored = max(1, -(-2 * n // PASS)), 0
    kind = "query bigint, doc bigint, score double, rank int"
    for p in range(parts if n and n_blocks else 0):
        some = queries.where(F.pmod(F.xxhash64("query"), F.lit(parts)) == p).select("query", "qv")
        asked, taken = some.toArrow(), pool
        while True:
            bounds, sent = _bounds(blocks, asked, taken)
            rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("bound"), "center", "part"))
            first = scratch(bounds.withColumn("rank", rank).where(F.col("rank") <= taken), "bounds")
            sent.destroy()
            known = scratch(_top(_scored(blocks, first, some, k), k), "pool")
            short = some.join(known.groupBy("query").agg(F.count("*").alias("n")), "query", "left").where(F.coalesce("n", F.lit(0)) < k)
            if taken >= n_blocks or short.isEmpty():
                break
            taken *= 2
        least = known.groupBy("query").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
        wanted = some.join(least, "query", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf")))).toArrow()
        bounds, sent = _bounds(blocks, wanted, None)
        pairs = scratch(bounds, "pairs")
        sent.destroy()
        scored += pairs.count()
        _top(_scored(blocks, pairs, some, k), k).write.mode("append").parquet(path)
    if not n or not n_blocks:
        return spark.createDataFrame([], kind), {"pairs": 0, "scored": 0}
    return spark.read.schema(kind).parquet(path), {"pairs": n * n_blocks, "scored": scored}


def dense_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten documents of each query by their best chunk, through an index of blocks."""
    blocks = scratch(build(dense.chunks(spark, sf_dir), 64), "blocks")
    return search(blocks, dense.queries(spark, sf_dir), 10)[0].select("query", "doc", "score", "rank")


QUERIES = {"dense_blocks": dense_blocks}
ORACLES = {"dense_blocks": dense.ORACLES["dense_doc_max"]}
