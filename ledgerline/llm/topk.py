"""Exact top-k search by a three-phase uniform threshold.

A vector's score against a query is an integer inner product, the sum of partial scores over equal
slices of the dimensions. Each slice is a score list.

1. Every partition gives, for each query and slice, the vectors of its k best partial scores, with
   their whole scores, and the lowest partial score. The k-th best score of a query among these is one
   that the answer must reach.
2. What is left of that score above the lists' lowest scores, divided evenly among the slices, is the
   cutoff: a vector under it in every slice can't be in the answer. The cutoffs of a block of queries
   (bounded in size) are sent to all partitions, which return all entries that reach them.
3. Scores of the entries' vectors that are not known in every slice are looked up and added exactly.

Copies: of equal vectors only the k + 1 smallest ids can be in an answer (one may be the query's own),
so those stand for the others, and equal queries are one search. Queries are met in blocks of at most
BLOCK distinct ones, each against all vectors.

Vectors that are null, empty or hold null or non-finite components take no part. Vectors of different
lengths have no score with each other. Repeated rows (the same vec_id and vector) count once; other
vectors under one vec_id are candidates and queries of their own, and a query never meets its own id.
An empty table gives no rows.

The first phase makes the lists by the whole product, as vectors have no stored lists; the second makes
it again rather than keep scores of all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Distinct queries in a block at most, slices of the dimensions, cells of a matrix at a time.
BLOCK, SLICES, CELLS = 2048, 2, 1 << 21


def quantised(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, q): components times scale, rounded down; only vectors of finite components."""
    x = F.col(column).cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    whole = vectors.select(F.col(key).cast("bigint").alias("vec_id"), F.transform(x, lambda v: F.floor(v * scale).cast("bigint")).alias("q"), fine.alias("fine"))
    return whole.where(F.col("fine") & (F.size("q") > 0) & F.col("vec_id").isNotNull()).select("vec_id", "q")


def matrix(batch: pa.RecordBatch, dim: int, column: str = "q") -> tuple[np.ndarray, np.ndarray]:
    """Rows of a batch whose vectors have dim components: (row numbers, [n, dim])."""
    lists = batch.column(column)
    sizes = np.asarray(lists.value_lengths())
    rows = np.flatnonzero(sizes == dim)
    flat = lists.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
    return rows, flat.reshape(-1, dim)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer a @ b.T: in doubles where these hold every sum, else in integers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def slices_of(dim: int, slices: int) -> list[slice]:
    edges = np.linspace(0, dim, min(slices, dim) + 1).astype(int)
    return [slice(i, j) for i, j in zip(edges[:-1], edges[1:])]


def _search_block(base: DataFrame, queries: np.ndarray, keys: np.ndarray, k: int, slices: int) -> DataFrame:
    """(key, vec_id, score): the k best ids of each query of a block, ties to smaller ids."""
    spark = base.sparkSession
    dim = queries.shape[1]
    cuts = slices_of(dim, slices)
    m = len(cuts)
    sent = spark.sparkContext.broadcast(queries)

    def blocks(batches: Iterator[pa.RecordBatch]):
        """(ids, partial scores [slice][vector, query], first query) in bounded pieces."""
        q = sent.value
        for batch in batches:
            rows, x = matrix(batch, dim)
            if not len(rows):
                continue
            ids = batch.column("vec_id").to_numpy(zero_copy_only=False)[rows]
            step = max(1, CELLS // len(ids))
            for at in range(0, len(q), step):
                yield ids, [product(x[:, c], q[at : at + step, c]) for c in cuts], at

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, parts, at in blocks(batches):
            n, w = parts[0].shape
            take, whole = min(k, n), sum(parts)
            for i, s in enumerate(parts):
                top = np.argpartition(s, n - take, axis=0)[n - take :]
                query = np.broadcast_to(np.arange(at, at + w, dtype=np.int32), top.shape)
                lowest = np.broadcast_to(s.min(0), top.shape)
                yield pa.RecordBatch.from_arrays([pa.array(query.ravel()), pa.array(np.full(top.size, i, np.int32)), pa.array(ids[top].ravel()), pa.array(np.take_along_axis(whole, top, 0).ravel()), pa.array(lowest.ravel())], names=["query", "slice", "vec_id", "score", "lowest"])

    # phase 1
    lists = base.mapInArrow(gather, "query int, slice int, vec_id bigint, score bigint, lowest bigint")
    # a vector may head several slices
    seen = lists.groupBy("query", "vec_id", "score").agg(*(F.min(F.when(F.col("slice") == i, F.col("lowest"))).alias(f"low{i}") for i in range(m)))
    ranked = seen.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")))
    lows = [F.min(f"low{i}").alias(f"low{i}") for i in range(m)]
    kth = ranked.groupBy("query").agg(F.min(F.when(F.col("rank") <= k, F.col("score"))).alias("bound"), F.count("*").alias("n"), F.array(*lows).alias("lows"))
    cutoffs = np.full((m, len(queries)), np.iinfo(np.int64).min)
    for r in kth.collect():  # one row for each query of the block
        if r.n >= k:
            spare = r.bound - sum(r.lows)
            cutoffs[:, r.query] = [low + -(-spare // m) if spare > 0 else low for low in r.lows]
    cut = spark.sparkContext.broadcast(cutoffs)

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, parts, at in blocks(batches):
            w = parts[0].shape[1]
            reach = np.stack([s >= cut.value[i, at : at + w] for i, s in enumerate(parts)])
            v, q = np.nonzero(reach.any(0))
            known = [np.where(reach[i, v, q], s[v, q], 0) for i, s in enumerate(parts)]
            missing = (~reach[:, v, q] * (1 << np.arange(m))[:, None]).sum(0)
            if len(v):
                yield pa.RecordBatch.from_arrays([pa.array((q + at).astype(np.int32)), pa.array(ids[v]), pa.array(sum(known)), pa.array(missing.astype(np.int32))], names=["query", "vec_id", "known", "missing"])

    # phase 2
    entries = common.scratch(base.mapInArrow(collect, "query int, vec_id bigint, known bigint, missing int"), "entries")

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = sent.value
        for batch in batches:
            rows, x = matrix(batch, dim)
            at = batch.column("query").to_numpy(zero_copy_only=False)[rows]
            missing = batch.column("missing").to_numpy(zero_copy_only=False)[rows]
            score = batch.column("known").to_numpy(zero_copy_only=False)[rows].copy()
            exact = np.abs(x).max(initial=0) * np.abs(q).max(initial=0) * dim < 2**53
            for i, c in enumerate(cuts):
                use = (missing >> i) & 1 == 1
                if exact:
                    score[use] += np.einsum("ij,ij->i", x[use][:, c].astype(np.float64), q[at[use]][:, c].astype(np.float64)).astype(np.int64)
                else:
                    score[use] += np.einsum("ij,ij->i", x[use][:, c], q[at[use]][:, c])
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(batch.column("vec_id").to_numpy(zero_copy_only=False)[rows]), pa.array(score)], names=["query", "vec_id", "score"])

    # phase 3: entries known in every slice need no look-up
    whole = entries.where("missing = 0").select("query", "vec_id", F.col("known").alias("score"))
    left = entries.where("missing <> 0").join(base, "vec_id").select("query", "vec_id", "known", "missing", "q").mapInArrow(resolve, "query int, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    best = whole.unionByName(left).withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")
    names = spark.createDataFrame(pa.table({"query": pa.array(np.arange(len(keys), dtype=np.int32)), "key": pa.array(keys)}))
    return best.join(F.broadcast(names), "query").select("key", "vec_id", "score")


def top_k(vectors: DataFrame, is_query, k: int = 5, slices: int = SLICES) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows of `vectors` (vec_id, q) where is_query holds, against all other ids."""
    vectors = common.scratch(vectors.withColumn("key", F.sha2(F.array_join("q", ","), 256)), "vectors")
    # the k + 1 smallest ids of each distinct vector
    order = F.row_number().over(Window.partitionBy("key").orderBy("vec_id"))
    base = vectors.select("vec_id", "q", "key").distinct().withColumn("n", order).where(F.col("n") <= k + 1).select("vec_id", "q")
    base = common.scratch(base, "base")
    asked = vectors.where(is_query).select("vec_id", "key").distinct()
    distinct = common.scratch(vectors.where(is_query).groupBy("key").agg(F.first("q").alias("q"), F.size(F.first("q")).alias("dim")), "queries")
    dims = [(r.dim, r.n) for r in distinct.groupBy("dim").agg(F.count("*").alias("n")).collect()]
    found = None
    for dim, n in dims:
        # hashed blocks of half the most on average: the bound holds with near certainty, and is checked
        count = -(-n * 2 // BLOCK) if n > BLOCK else 1
        for b in range(count):
            rows = distinct.where((F.col("dim") == dim) & (F.pmod(F.xxhash64("key"), F.lit(count)) == b)).select("key", "q").toArrow()
            for at in range(0, rows.num_rows, BLOCK):
                part = rows.slice(at, BLOCK)
                queries = np.array(part.column("q").combine_chunks().flatten().to_numpy(zero_copy_only=False)).reshape(-1, dim)
                hits = _search_block(base, queries, np.array(part.column("key").to_pylist(), dtype=object), k + 1, slices)
                found = hits if found is None else found.unionByName(hits)
    if found is None:
        found = vectors.where("false").select("key", "vec_id", F.lit(0).cast("bigint").alias("score"))
    met = asked.withColumnRenamed("vec_id", "query_id").join(found, "key").where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantised(common.read(spark, sf_dir, "embeddings"))
    return top_k(vectors, F.col("vec_id") % 50 == 0)


#: The same by scoring every pair.
OP1_SQL = """
with v as (
  select distinct vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as q
  from embeddings
  where embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select a.vec_id as query_id, b.vec_id as vec_id,
         list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) as score
  from v a join v b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id and len(a.q) = len(b.q)
), r as (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s
)
select query_id, cast(rank as integer) as rank, vec_id, cast(score as bigint) as score from r where rank <= 5
"""

QUERIES = {"op1_topk": op1_topk}
ORACLES = {"op1_topk": OP1_SQL}
