"""BM25 over an inverted index of word tokens.

An index is three tables: postings (term, doc, tf, dl), document frequencies (term, df) and the corpus
(n, avgdl). Made for one run, it has only postings of the terms that the queries use; saved, it has all
of them sorted by term, so a later search reads the row groups of its terms only. The best documents of
each query come from block maxima (`best`, see blockmax): no row is made for a query and document that
merely share a term. `search` gives the scores of all of these, for those who want whole lists. Scores
are rounded before they rank, so ties are ties, and end with the id.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.scratch import scratch
from ..sources.tables import spread, table
from . import blockmax

K1, B = 1.5, 0.75
#: Terms that are sent to the tasks to be picked out of the texts; more are joined.
SENT = 1 << 20


@dataclass(frozen=True)
class Index:
    postings: DataFrame
    terms: DataFrame
    corpus: DataFrame
    #: (doc, dl, terms, tfs), a row for each document, of an index made for one run.
    counted: DataFrame | None = None


def documents(df: DataFrame, key: str, text, tokenizer: Callable[[Column], Column] = T.tokens) -> DataFrame:
    """(doc, tokens, dl); tokenizer: a column function from text to an array of words."""
    return df.select(F.col(key).alias("doc"), tokenizer(text).alias("tokens")).withColumn("dl", F.size("tokens"))


def postings(docs: DataFrame, used: DataFrame | None = None) -> DataFrame:
    """(doc, dl, term, tf); used (term): the terms that are wanted."""
    each = docs.select("doc", "dl", F.explode("tokens").alias("term"))
    if used is not None:
        each = each.join(used, "term", "left_semi")
    return each.groupBy("doc", "dl", "term").agg(F.count("*").alias("tf"))


def counted(docs: DataFrame, used: DataFrame | None = None) -> DataFrame:
    """docs (doc, tokens, dl) -> (doc, dl, terms, tfs), a row for each: its distinct terms, of the used ones, with their counts.

    More than SENT used terms are not picked out here.
    """
    kind = docs.schema["doc"].dataType.simpleString()
    names = None if used is None else used.where("term is not null").select("term").distinct().limit(SENT + 1).toArrow().column("term").combine_chunks()
    sent = docs.sparkSession.sparkContext.broadcast(None if names is None or len(names) > SENT else names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = sent.value
        for b in batches:
            words = b.column("tokens").flatten()
            row = np.repeat(np.arange(b.num_rows), np.asarray(pc.fill_null(pc.list_value_length(b.column("tokens")), 0)))
            if wanted is None:
                encoded = words.dictionary_encode(null_encoding="encode")
                known, code = encoded.dictionary, np.asarray(encoded.indices)
            else:
                known, code = wanted, np.asarray(pc.fill_null(pc.index_in(words, wanted), -1))
                row, code = row[code >= 0], code[code >= 0]
            each, tf = np.unique(row * (len(known) + 1) + code, return_counts=True)
            ends = np.searchsorted(each, np.arange(b.num_rows + 1) * (len(known) + 1)).astype(np.int32)
            terms = pa.ListArray.from_arrays(ends, known.take(pa.array(each % (len(known) + 1))))
            yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("dl"), terms, pa.ListArray.from_arrays(ends, pa.array(tf.astype(np.int64)))], names=["doc", "dl", "terms", "tfs"])

    return docs.select("doc", "dl", "tokens").mapInArrow(run, f"doc {kind}, dl int, terms array<string>, tfs array<bigint>")


def idf(n, df):
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def corpus_of(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def frequencies(found: DataFrame) -> DataFrame:
    # reading tf keeps both uses of the postings alike, so that their exchange is made once
    return found.groupBy("term").agg(F.count_if(F.col("tf") > 0).alias("df"))


def index(docs: DataFrame, used: DataFrame | None = None) -> Index:
    """An index made for one run: texts are read once, and what is counted in them is written."""
    each = scratch(counted(docs, used), "counted")
    found = each.select("doc", "dl", F.explode(F.arrays_zip("terms", "tfs")).alias("x")).select("doc", "dl", F.col("x.terms").alias("term"), F.col("x.tfs").alias("tf"))
    if used is not None and used.limit(SENT + 1).count() > SENT:
        found = found.join(used, "term", "left_semi")
    rows, distinct = each.agg(F.count("*"), F.count_distinct("doc")).first()
    if rows != distinct:  # rows of one id are one document where they are as long
        found = found.groupBy("doc", "dl", "term").agg(F.sum("tf").alias("tf"))
    return Index(found, frequencies(found), corpus_of(each), each)


def save_index(docs: DataFrame, folder: str, settings: dict) -> None:
    """Writes an index with the settings it was made by; an existing folder is an error."""
    found = postings(docs)
    # the document deals out a term that many documents have
    ordered = found.repartitionByRange("term", "doc").sortWithinPartitions("term", "doc")
    ordered.write.parquet(f"{folder}/postings")
    spark = docs.sparkSession
    frequencies(spark.read.parquet(f"{folder}/postings")).write.parquet(f"{folder}/terms")
    corpus = corpus_of(docs).withColumn("settings", F.lit(json.dumps(settings, sort_keys=True)))
    corpus.coalesce(1).write.parquet(f"{folder}/corpus")


def open_index(spark: SparkSession, folder: str, settings: dict, n: int | None = None) -> Index:
    """A saved index; ValueError where it was made by other settings, or of another number of documents than n."""
    corpus = spark.read.parquet(f"{folder}/corpus")
    known = corpus.first()
    if json.loads(known.settings) != settings:
        raise ValueError(f"the index was made by {known.settings}, not by {json.dumps(settings, sort_keys=True)}")
    if n is not None and known.n != n:
        raise ValueError(f"the index has {known.n} documents, the corpus {n}")
    return Index(spark.read.parquet(f"{folder}/postings"), spark.read.parquet(f"{folder}/terms"), corpus.drop("settings"))


def stats(docs: DataFrame) -> DataFrame:
    """(term, df, idf) of every term."""
    n = docs.agg(F.count("*").alias("n"))
    return frequencies(postings(docs)).join(F.broadcast(n)).select("term", "df", F.round(idf(F.col("n"), F.col("df")), 6).alias("idf"))


def impact(avgdl):
    """What a posting adds for a term of weight 1."""
    return F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / avgdl))


def weighted(terms: DataFrame, queries: DataFrame, n: int) -> DataFrame:
    """queries (query, term, qtf) -> (query, term, weight); terms that no document has are left out."""
    return queries.join(terms, "term").select("query", "term", (F.col("qtf") * idf(F.lit(n), F.col("df"))).alias("weight"))


def search(found: Index, queries: DataFrame) -> DataFrame:
    """queries (query, term, qtf) -> (query, doc, score) for all documents with a term in common; duplicates in queries count."""
    corpus = found.corpus.first()
    each = found.postings.select("term", "doc", impact(F.lit(corpus.avgdl)).alias("impact")).join(weighted(found.terms, queries, corpus.n), "term")
    return each.groupBy("query", "doc").agg(F.round(F.sum(F.col("weight") * F.col("impact")), 6).alias("score")).where("score > 0")


def partial(found: Index, queries: DataFrame, k: int) -> DataFrame:
    """The k best of each query in each part of the documents, with how much of the part was scored (blockmax.partial)."""
    corpus = found.corpus.first()  # one row, read once
    tokens, cores = int(corpus.n * (corpus.avgdl or 0)), queries.sparkSession.sparkContext.defaultParallelism
    # smaller parts where there would be fewer than cores
    parts = max(1, -(-tokens // blockmax.PART), min(cores, tokens // blockmax.LEAST))
    postings = found.postings.select("doc", "term", impact(F.lit(corpus.avgdl)).alias("impact"))
    return blockmax.partial(postings, weighted(found.terms, queries, corpus.n), parts, k, queries.count())


def best(found: Index, queries: DataFrame, k: int) -> DataFrame:
    """queries (query, term, qtf) -> (query, doc, score, rank): the k best documents of each, ties by id."""
    return top(partial(found, queries, k).select("query", "doc", "score"), k)


def scores(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """search by an index made for these queries."""
    return search(index(docs, queries.select("term").distinct()), queries)


def top(scored: DataFrame, k: int, by: str = "query", score: str = "score", tie: str = "doc") -> DataFrame:
    """The k best rows of each query with their rank; a bounded heap of each task comes before the shuffle."""
    order = Window.partitionBy(by).orderBy(F.desc(score), tie)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def query_terms(df: DataFrame, key: str, text, tokenizer: Callable[[Column], Column] = T.tokens) -> DataFrame:
    return df.select(F.col(key).alias("query"), F.explode(tokenizer(text)).alias("term")).groupBy("query", "term").agg(F.count("*").alias("qtf"))


def benchmark_run(spark: SparkSession, sf_dir: str, text=None, k: int = 10) -> DataFrame:
    """(query, doc, score, rank): benchmark items ranked over documents."""
    docs = documents(spread(table(spark, sf_dir, "documents")), "doc_id", F.col("text") if text is None else text)
    asked = query_terms(table(spark, sf_dir, "benchmark"), "item_id", F.col("text"))
    return best(index(docs, asked.select("term").distinct()), asked, k)


def bm25_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every term with its document frequency and weight."""
    return stats(documents(spread(table(spark, sf_dir, "documents")), "doc_id", F.col("text")))


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_run(spark, sf_dir).select(F.col("query").alias("item_id"), F.col("doc").alias("doc_id"), "score", "rank")


def bm25_meta_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat_ws(" ", T.joined_metadata(F.col("lang"), F.col("source")), "text")
    return benchmark_run(spark, sf_dir, text).select(F.col("query").alias("item_id"), F.col("doc").alias("doc_id"), "score", "rank")


TOKENS_SQL = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+')"


def run_ctes(text: str = "text", k: int = 10) -> str:
    """The SQL of benchmark_run, as common table expressions ending in `run`."""
    return f"""
d as (select doc_id, {TOKENS_SQL.format(text)} as toks from documents),
dl as (select doc_id, len(toks) as dl from d),
corpus as (select count(*) as n, avg(dl) as avgdl from dl),
tf as (select doc_id, term, count(*) as tf from (select doc_id, unnest(toks) as term from d) group by all),
dfs as (select term, count(*) as df from tf group by term),
q as (select item_id, term, count(*) as qtf from (select item_id, unnest({TOKENS_SQL.format('text')}) as term from benchmark) group by all),
scored as (
  select q.item_id, tf.doc_id,
         round(sum(q.qtf * (ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + {K1} * (1 - {B} + {B} * dl / avgdl)))), 6) as score
  from q join tf using (term) join dfs using (term) join dl on dl.doc_id = tf.doc_id cross join corpus
  group by all having score > 0),
run as (
  select * from (select *, cast(row_number() over (partition by item_id order by score desc, doc_id) as integer) as rank from scored)
  where rank <= {k})"""


QUERIES = {"bm25_stats": bm25_stats, "bm25_topk": bm25_topk, "bm25_meta_prefix": bm25_meta_prefix}
ORACLES = {
    "bm25_stats": f"""
with d as (select doc_id, {TOKENS_SQL.format('text')} as toks from documents),
tf as (select distinct doc_id, unnest(toks) as term from d),
n as (select count(*) as n from d)
select term, count(*) as df, round(ln(1 + (max(n) - count(*) + 0.5) / (count(*) + 0.5)), 6) as idf
from tf cross join n group by term""",
    "bm25_topk": f"with {run_ctes()} select item_id, doc_id, score, rank from run",
    "bm25_meta_prefix": f"with {run_ctes('''concat_ws(' ', nullif(lang, ''), nullif(source, ''), text)''')} select item_id, doc_id, score, rank from run",
}
