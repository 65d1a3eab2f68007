"""Exact vector search: a stated set of queries against every chunk, chunk scores to document scores.

Queries are met in passes of at most PASS, each sent to the workers as one matrix of that bounded size.
A worker multiplies it with batches of chunks and keeps the k best ids of each query as it goes, so a
task gives k rows for each query however many chunks it has read, and no row is made for a pair. Where
there are several passes, each is ranked and written and its matrix destroyed before the next one begins.
Document scores need a document's chunks together: chunks are dealt and sorted by document, and the best
scores of a document that a batch ends in go on to the next. Scores are rounded before they rank, so
ties are ties, and end with the id.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.scratch import shared_dir
from ..sources.tables import table

#: Every QUERY_STEP-th id is a query; queries of a pass, cells of a product at a time, documents of a list.
QUERY_STEP, PASS, CELLS, DEPTH = 100, 1 << 14, 1 << 21, 100


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0).cast("double"), lambda s, x: s + x)


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chunk, doc, label, v): embeddings as chunks, four to a document."""
    e = table(spark, sf_dir, "embeddings").where("embedding is not null and not exists(embedding, x -> x is null)")
    return e.select(F.col("vec_id").alias("chunk"), F.expr("vec_id div 4").alias("doc"), "label", F.col("embedding").cast("array<double>").alias("v"))


def merged(chunks: DataFrame, n: int) -> DataFrame:
    """An index of chunks n times as large, beside the one of chunks: n neighbours of a document become their mean; ids are below 0.

    The last chunks of a document, where fewer than n are left, are in no larger one.
    """
    group = F.expr(f"chunk div {n}")
    some = chunks.groupBy("doc", group.alias("g")).agg(F.sort_array(F.collect_list(F.struct("chunk", "v"))).alias("vs")).where(F.size("vs") == n)
    some = some.where(F.size(F.array_distinct(F.transform("vs", lambda x: F.size(x["v"])))) == 1)
    dims = F.sequence(F.lit(0), F.size(F.col("vs")[0]["v"]) - 1)
    mean = F.transform(dims, lambda i: F.aggregate("vs", F.lit(0.0).cast("double"), lambda t, x: t + x["v"][i]) / n)
    return some.select((-F.col("g") - 1).alias("chunk"), "doc", mean.alias("v"))


def queries(spark: SparkSession, sf_dir: str, step: int = QUERY_STEP) -> DataFrame:
    """(query, qv, qlabel): the vectors whose id is divisible by step."""
    return chunks(spark, sf_dir).where(F.col("chunk") % step == 0).select(F.col("chunk").alias("query"), F.col("v").alias("qv"), F.col("label").alias("qlabel"))


def first_rows(scores: np.ndarray, k: int) -> np.ndarray:
    """For each column the rows of its k highest scores, [k, columns]; of equal ones the first rows."""
    n = len(scores)
    if n <= k:
        return np.broadcast_to(np.arange(n)[:, None], scores.shape)
    bound = np.partition(scores, n - k, axis=0)[n - k]
    above, equal = scores > bound, scores == bound
    taken = above | (equal & (np.cumsum(equal, axis=0) <= k - above.sum(0)))
    return np.nonzero(taken.T)[1].reshape(-1, k).T


class Best:
    """The k best (score, id) of each query so far."""

    def __init__(self, n_queries: int, k: int):
        self.k = k
        self.scores = np.full((0, n_queries), -np.inf)
        self.ids = np.zeros((0, n_queries), np.int64)

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        """ids ascend; scores: [ids, queries], -inf where there is none."""
        rows = first_rows(scores, self.k)
        scores = np.concatenate([self.scores, np.take_along_axis(scores, rows, 0)])
        ids = np.concatenate([self.ids, ids[rows]])
        order = np.lexsort((ids, -scores), axis=0)[: self.k]
        self.scores, self.ids = np.take_along_axis(scores, order, 0), np.take_along_axis(ids, order, 0)


def document_scores(scores: np.ndarray, starts: np.ndarray, weights: tuple[float, ...]) -> np.ndarray:
    """[documents, queries]: the sum of weight i times the i-th best score of each document's rows."""
    left, out = scores.copy(), 0.0
    sizes = np.diff(np.append(starts, len(scores)))
    for i, w in enumerate(weights):
        most = np.maximum.reduceat(left, starts, axis=0)
        out = out + np.where(most > -np.inf, w * most, -np.inf if i == 0 else 0.0)
        if i + 1 < len(weights):
            same = left == np.repeat(most, sizes, axis=0)
            before = np.cumsum(same, axis=0)
            first = same & (before - np.repeat(before[starts] - same[starts], sizes, axis=0) == 1)
            left[first] = -np.inf
    # halves away from zero, as SQL rounds
    return np.sign(out) * np.floor(np.abs(out) * 1e6 + 0.5) / 1e6


def _search_pass(found: DataFrame, names: np.ndarray, owns: np.ndarray, vectors: list[np.ndarray], k: int, weights: tuple[float, ...] | None) -> tuple[DataFrame, Broadcast]:
    by_dim = {}
    for i, v in enumerate(vectors):
        by_dim.setdefault(len(v), []).append(i)
    sent = found.sparkSession.sparkContext.broadcast([(dim, names[at], owns[at], np.stack([vectors[i] for i in at])) for dim, at in by_dim.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(len(own), k) for _, _, own, _ in sent.value]
        held = [(np.zeros(0, np.int64), np.zeros((0, len(own)))) for _, _, own, _ in sent.value]
        for b in batches:
            sizes = np.asarray(b.column("v").value_lengths())
            for at, (dim, _, own, q) in enumerate(sent.value):
                rows = np.flatnonzero(sizes == dim)
                if not len(rows):
                    continue
                x = b.column("v").take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                ids = b.column("chunk").to_numpy()[rows]
                if weights is None:
                    order = np.argsort(ids, kind="stable")
                    ids, x = ids[order], x[order]
                docs = ids if weights is None else b.column("doc").to_numpy()[rows]
                step = max(1, CELLS // max(1, len(own)))
                for i in range(0, len(ids), step):
                    s = np.round(x[i : i + step] @ q.T, 6)
                    s[ids[i : i + step, None] == own[None, :]] = -np.inf  # no query meets itself
                    if weights is None:
                        best[at].add(ids[i : i + step], s)
                        continue
                    d, s = np.concatenate([held[at][0], docs[i : i + step]]), np.concatenate([held[at][1], s])
                    starts = np.flatnonzero(np.append(True, d[1:] != d[:-1]))
                    last = starts[-1]
                    if last:
                        best[at].add(d[starts[:-1]], document_scores(s[:last], starts[:-1], weights))
                    rest = -np.sort(-s[last:], axis=0)[: len(weights)]
                    held[at] = (np.full(len(rest), d[last]), rest)
        for b, (d, s), (_, names, _, _) in zip(best, held, sent.value):
            if len(d):
                b.add(d[:1], document_scores(s, np.zeros(1, np.int64), weights))
            real = b.scores > -np.inf
            yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(names, real.shape)[real]), pa.array(b.ids[real]), pa.array(b.scores[real])], names=["query", "id", "score"])

    return found.mapInArrow(run, "query bigint, id bigint, score double"), sent


def search(chunks: DataFrame, queries: DataFrame, k: int, weights: tuple[float, ...] | None = None) -> DataFrame:
    """(query, chunk, score, rank) of the k best chunks of each query, or, with weights, (query, doc, score, rank).

    A document's score is the sum of weight i times its i-th best chunk score, (1.0,) for its best; fewer
    chunks, fewer terms. A query never meets the chunk of its own id, or that of its column `own` where there
    is one; queries of several vectors have a row for each, under ids of their own, and share a pass.
    """
    name = "chunk" if weights is None else "doc"
    found = chunks.select("chunk", "v") if weights is None else chunks.select("chunk", "doc", "v").repartition("doc").sortWithinPartitions("doc", "chunk")
    n = queries.count()
    parts = 1 if n <= PASS else -(-2 * n // PASS)
    path = f"{shared_dir(queries.sparkSession)}/passes-{uuid.uuid4().hex}" if parts > 1 else None
    out = queries.sparkSession.createDataFrame([], "query bigint, id bigint, score double")
    for p in range(parts):
        rows = queries.where(F.pmod(F.xxhash64("query"), F.lit(parts)) == p).select("query", (F.col("own") if "own" in queries.columns else F.col("query")).alias("own"), "qv").toArrow()
        for at in range(0, rows.num_rows, PASS):
            part = rows.slice(at, PASS)
            out, sent = _search_pass(found, part.column("query").to_numpy(), part.column("own").to_numpy(), [np.array(v) for v in part.column("qv").to_pylist()], k, weights)
            if path:
                top(out, k, "id").drop("rank").write.mode("append").parquet(path)
                sent.destroy()
    if path:
        out = queries.sparkSession.read.schema("query bigint, id bigint, score double").parquet(path)
    return top(out, k, "id").select("query", F.col("id").alias(name), "score", "rank")


def pair_scores(pairs: DataFrame, chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """pairs (query, doc) -> (query, chunk, doc, score) of the documents' chunks; for lists of candidates."""
    met = pairs.select("query", "doc").join(chunks.select("chunk", "doc", "v"), "doc").join(queries.select("query", "qv"), "query")
    return met.where("chunk <> query and size(v) = size(qv)").select("query", "chunk", "doc", F.round(dot(F.col("v"), F.col("qv")), 6).alias("score"))


def top(scored: DataFrame, k: int, tie: str, by: str = "query", score: str = "score") -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), tie))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def doc_max(scored: DataFrame) -> DataFrame:
    """(query, doc, score): a document's best chunk score."""
    return scored.groupBy("query", "doc").agg(F.max("score").alias("score"))


def doc_weighted(scored: DataFrame, weights: list[float]) -> DataFrame:
    """(query, doc, score): the sum of weight i times the i-th best chunk score; fewer chunks, fewer terms."""
    rank = F.row_number().over(Window.partitionBy("query", "doc").orderBy(F.desc("score"), "chunk"))
    ranked = scored.withColumn("i", rank).where(F.col("i") <= len(weights))
    best = ranked.groupBy("query", "doc").agg(F.sort_array(F.collect_list(F.struct("i", "score"))).alias("s"))
    total = F.aggregate("s", F.lit(0.0).cast("double"), lambda t, x: t + F.array(*map(F.lit, weights))[x["i"] - 1] * x["score"])
    return best.select("query", "doc", F.round(total, 6).alias("score"))


def best_chunks(scored: DataFrame) -> DataFrame:
    """(query, doc, chunk, score): the best chunk of each document, the lowest number on ties."""
    best = F.max_by(F.struct("chunk", "score"), F.struct("score", (-F.col("chunk")).alias("n")))
    return scored.groupBy("query", "doc").agg(best.alias("b")).select("query", "doc", "b.chunk", "b.score")


def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(chunks(spark, sf_dir), queries(spark, sf_dir), 10)


def dense_doc_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(chunks(spark, sf_dir), queries(spark, sf_dir), 10, (1.0,))


def dense_doc_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(chunks(spark, sf_dir), queries(spark, sf_dir), 10, (1.0, 0.1))


def best_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    every, asked = chunks(spark, sf_dir), queries(spark, sf_dir)
    docs = search(every, asked, 10, (1.0,)).select("query", "doc", "rank")
    return docs.join(best_chunks(pair_scores(docs, every, asked)), ["query", "doc"]).select("query", "doc", "chunk", "score", "rank")


def overlap_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that the first five of two lists share, and the score gap between ranks 1 and 10."""
    every, asked = chunks(spark, sf_dir), queries(spark, sf_dir)
    best, weighted = search(every, asked, 10, (1.0,)), search(every, asked, 5, (1.0, 0.1))
    a = best.groupBy("query").agg(
        F.collect_set(F.when(F.col("rank") <= 5, F.col("doc"))).alias("a"),
        F.round(F.max(F.when(F.col("rank") == 1, F.col("score"))) - F.max(F.when(F.col("rank") == 10, F.col("score"))), 6).alias("gap"),
    )
    b = weighted.groupBy("query").agg(F.collect_set("doc").alias("b"))
    return a.join(b, "query").select("query", F.size(F.array_intersect("a", "b")).cast("bigint").alias("overlap"), "gap")


SCORED_SQL = f"""
c as (select vec_id as chunk, vec_id // 4 as doc, label, cast(embedding as double[]) as v from embeddings where embedding is not null),
scored as (
  select q.chunk as query, q.label as qlabel, c.chunk, c.doc, c.label, round(list_dot_product(c.v, q.v), 6) as score
  from c join c q on q.chunk % {QUERY_STEP} = 0 and c.chunk <> q.chunk),
docmax as (select query, qlabel, doc, max(score) as score from scored group by all),
ranked as (select *, row_number() over (partition by query, doc order by score desc, chunk) as i from scored),
weighted as (select query, doc, round(coalesce(max(case when i = 1 then 1.0 * score end), 0) + coalesce(max(case when i = 2 then 0.1 * score end), 0), 6) as score from ranked group by all)"""


def top_sql(source: str, k: int, tie: str, columns: str) -> str:
    return f"select {columns}, rank from (select *, cast(row_number() over (partition by query order by score desc, {tie}) as integer) as rank from {source}) where rank <= {k}"


QUERIES = {"dense_topk": dense_topk, "dense_doc_max": dense_doc_max, "dense_doc_weighted": dense_doc_weighted, "best_chunk": best_chunk, "overlap_signals": overlap_signals}
ORACLES = {
    "dense_topk": f"with {SCORED_SQL} {top_sql('scored', 10, 'chunk', 'query, chunk, score')}",
    "dense_doc_max": f"with {SCORED_SQL} {top_sql('docmax', 10, 'doc', 'query, doc, score')}",
    "dense_doc_weighted": f"with {SCORED_SQL} {top_sql('weighted', 10, 'doc', 'query, doc, score')}",
    "best_chunk": f"""with {SCORED_SQL}, t as ({top_sql('docmax', 10, 'doc', 'query, doc')})
select t.query, t.doc, r.chunk, r.score, t.rank from t join ranked r on r.query = t.query and r.doc = t.doc and r.i = 1""",
    "overlap_signals": f"""with {SCORED_SQL}, a as ({top_sql('docmax', 10, 'doc', 'query, doc, score')}), b as ({top_sql('weighted', 5, 'doc', 'query, doc')}),
o as (select a.query, count(b.doc) as overlap from a left join b on a.query = b.query and a.doc = b.doc where a.rank <= 5 group by 1),
g as (select query, round(max(case when rank = 1 then score end) - max(case when rank = 10 then score end), 6) as gap from a group by 1)
select query, overlap, gap from o join g using (query)""",
}
