"""Models outside the engine behind plain callables, with deterministic stand-ins.

A callable takes texts (or a request) and returns values; it runs on Arrow batches in workers. Calls
are cached by the digest of their request: only requests that a cache table lacks are sent.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import table

DIMENSIONS = 64


def embed_stub(texts: list[str], dimensions: int = DIMENSIONS) -> list[list[float]]:
    """Hashed bags of words, of length one (zero without words)."""
    out = []
    for t in texts:
        v = [0.0] * dimensions
        for w in (t or "").lower().split():
            h = int.from_bytes(hashlib.sha1(w.encode()).digest()[:8], "big")
            v[h % dimensions] += 1.0 if h >> 63 else -1.0
        n = math.sqrt(sum(x * x for x in v))
        out.append([x / n for x in v] if n else v)
    return out


def embed(df: DataFrame, key: str, text: str, model: Callable[[list[str]], list[list[float]]] = embed_stub, prefix: str = "") -> DataFrame:
    """(key, v): vectors of texts, with a prefix for queries."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = model([prefix + (t or "") for t in b.column(text).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(vectors, pa.list_(pa.float32()))], names=[key, "v"])

    return df.select(key, text).mapInArrow(run, f"{key} {kind}, v array<float>")


def overlap_stub(queries: list[str], texts: list[str]) -> list[float]:
    """Share of a query's distinct words that are in a text."""
    out = []
    for q, t in zip(queries, texts):
        words = set((q or "").lower().split())
        out.append(len(words & set((t or "").lower().split())) / len(words) if words else 0.0)
    return out


def rerank(pairs: DataFrame, model: Callable[[list[str], list[str]], list[float]] = overlap_stub) -> DataFrame:
    """pairs (qid, doc_id, query, text) -> (qid, doc_id, score)."""
    kinds = {c: pairs.schema[c].dataType.simpleString() for c in ("qid", "doc_id")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = model(b.column("query").to_pylist(), b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("qid"), b.column("doc_id"), pa.array(scores, pa.float64())], names=["qid", "doc_id", "score"])

    return pairs.select("qid", "doc_id", "query", "text").mapInArrow(run, f"qid {kinds['qid']}, doc_id {kinds['doc_id']}, score double")


def request_key(body) -> str:
    return hashlib.sha256(json.dumps(body, sort_keys=True, ensure_ascii=False).encode()).hexdigest()


def ask(requests: DataFrame, cache: DataFrame | None, model: Callable[[str], str | None], tries: int = 2) -> DataFrame:
    """requests (key, body) -> (key, reply, error): replies of the cache, and of the model for what it lacks.

    A reply that is no JSON object is asked for again, up to `tries`; then it is an error and no reply.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            replies, errors = [], []
            for body in b.column("body").to_pylist():
                reply = error = None
                for _ in range(tries):
                    try:
                        got = model(body)
                        if got is not None and isinstance(json.loads(got), dict):
                            reply, error = got, None
                            break
                        error = "format"
                    except Exception as e:  # noqa: BLE001 kept beside the request, which may be retried
                        error = str(e)[:200] or type(e).__name__
                replies.append(reply)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(replies, pa.string()), pa.array(errors, pa.string())], names=["key", "reply", "error"])

    distinct = requests.select("key", "body").dropDuplicates(["key"])
    if cache is None:
        return distinct.mapInArrow(run, "key string, reply string, error string")
    new = distinct.join(cache.select("key"), "key", "left_anti").mapInArrow(run, "key string, reply string, error string")
    old = distinct.join(cache.select("key", "reply"), "key").select("key", "reply", F.lit(None).cast("string").alias("error"))
    return old.unionByName(new)


def rewrite_stub(text: str) -> str | None:
    """Long words of a question, its first line only; none for a question without any."""
    words = [w for w in text.split("\n")[0].split() if len(w) > 3]
    return " ".join(words) or None


def rewrite(queries: DataFrame, model: Callable[[str], str | None] = rewrite_stub, most: int = 300) -> DataFrame:
    """queries (qid, query) -> (qid, query, rewritten): the question itself where the model fails or gives too long a text."""
    kind = queries.schema["qid"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for q in b.column("query").to_pylist():
                try:
                    got = model(q or "")
                except Exception:  # noqa: BLE001 a failed rewrite keeps the question
                    got = None
                out.append(got if got and len(got) <= most else q)
            yield pa.RecordBatch.from_arrays([b.column("qid"), b.column("query"), pa.array(out, pa.string())], names=["qid", "query", "rewritten"])

    return queries.select("qid", "query").mapInArrow(run, f"qid {kind}, query string, rewritten string")


def needs_rewrite(signals: DataFrame, most_overlap: int = 0, most_gap: float = 0.0588) -> DataFrame:
    """signals (query, overlap, gap): lists that agree little and scores that differ little."""
    return signals.where((F.col("overlap") <= most_overlap) & (F.col("gap") <= most_gap))


def messages(query, contexts, history=None):
    """A prompt as a column: numbered contexts, earlier turns, the question."""
    numbered = F.array_join(F.transform(contexts, lambda c, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), c)), "\n")
    past = F.lit("") if history is None else F.concat(F.array_join(history, "\n"), F.lit("\n"))
    return F.concat(F.lit("Contexts:\n"), numbered, F.lit("\n\n"), past, F.lit("Question: "), query)


def rerank_stub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 candidates of benchmark items by the overlap stand-in: the five best."""
    from . import lexical

    run = lexical.benchmark_run(spark, sf_dir)
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pairs = run.select(F.col("query").alias("qid"), F.col("doc").alias("doc_id")).join(items, "qid").join(docs, "doc_id")
    scored = rerank(pairs).withColumn("score", F.round("score", 6))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "doc_id"))
    return scored.withColumn("rank", rank).where("rank <= 5")


def embed_stub_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = embed(table(spark, sf_dir, "benchmark"), "item_id", "text")
    return items.select("item_id", F.size("v").cast("bigint").alias("n"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + (x * x).cast("double")), 4).alias("length"))


QUERIES = {"rerank_stub": rerank_stub, "embed_stub": embed_stub_query}
ORACLES: dict[str, str] = {}
