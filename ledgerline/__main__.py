"""Commands: python -m ledgerline COMMAND name=value ...

Each command reads tables from files, runs operators and writes a table or a report; an output that
exists stops it unless overwrite=true. `query` runs any registered query over a folder of tables.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config
from .operators import answers, chunking, conditions, corpus, external, lexical, metrics, pools, reports, spans
from .plans import answering, catalog
from .session import local
from .sources import files, indexes

DEFAULTS = {
    "out": "out", "overwrite": False, "cores": "*", "data": ".", "query": "", "records": "", "corpus": "${data}/corpus.parquet", "queries": "${data}/queries.parquet",
    "index": "${data}/index", "run": "", "base": "", "gold": "", "key": "doc_id", "seed": 20260929, "top_k": 10, "depth": 100, "size": 512, "overlap": 64,
    "targets": {"dev": 100, "test": 100}, "fields": ["lang", "source"], "excluded": [], "most_docs": pools.MOST_DOCS, "phrase": "", "parts": [],
}


def table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path) if path.endswith((".json", ".jsonl")) else spark.read.option("header", True).csv(path) if path.endswith(".csv") else spark.read.parquet(path)


def ingest(spark, c):
    """Label archives (records: their folder) to one row for each document."""
    read = files.labels(spark, c["records"], "conference_number string, question_number string, context string, date string, meeting_name string, committee_name string, agenda string")
    rows = read.select("split", "record.*").withColumn("doc_id", files_key())
    return corpus.build(rows, "doc_id", "question_number", ["conference_number", "context", "date", "meeting_name", "committee_name", "agenda"], "split")


def files_key():
    from .functions.text import content_key

    return content_key(F.col("conference_number"), F.col("context"))


def splits(spark, c):
    """Clusters (cluster, kind, n) to a split of each."""
    rows = {r.cluster: (r.kind, r.n) for r in table(spark, c["records"]).select("cluster", "kind", "n").collect()}
    made = corpus.assign_splits(rows, c["seed"], list(c["targets"].items()))
    return spark.createDataFrame(sorted(made.items()), "cluster string, split string")


def meta_dict(spark, c):
    """Document frequencies of the values of fields."""
    docs = table(spark, c["corpus"])
    return conditions.dictionary(conditions.long_form(docs, c["key"], {f: F.array(F.col(f).cast("string")) for f in c["fields"]}))


def conditions_of(spark, c):
    """Conditions in query texts (qid, query), by patterns and the values of the corpus's fields."""
    docs = table(spark, c["corpus"])
    values = conditions.long_form(docs, c["key"], {f: F.array(F.col(f).cast("string")) for f in c["fields"] if f in docs.columns}).select("field", "value").distinct()
    texts = table(spark, c["queries"]).select("qid", F.col("query").alias("text"))
    return conditions.extract(texts, "qid", conditions.entries(values))


def index(spark, c):
    """A BM25 index and, beside it, chunks with the stand-in's vectors."""
    docs = table(spark, c["corpus"])
    settings = {"k1": lexical.K1, "b": lexical.B, "tokenizer": "words"}
    lexical.save_index(lexical.documents(docs, c["key"], F.col("text")), f"{c['index']}/bm25", settings)

    def cut(d: DataFrame) -> DataFrame:
        parts = chunking.by_sentences(d.select(F.col(c["key"]).alias("doc_id"), "text"), "doc_id", c["size"], c["overlap"])
        met = parts.join(d.select(F.col(c["key"]).alias("doc_id"), "text"), "doc_id")
        piece = F.col("text").substr(F.col("start") + 1, F.col("end") - F.col("start"))
        return met.select(F.xxhash64("doc_id", "chunk_no").alias("chunk_id"), "doc_id", piece.alias("text"))

    return spark.createDataFrame([indexes.build(docs.select(c["key"], "text"), f"{c['index']}/chunks", cut, external.embed_stub, {"size": c["size"], "overlap": c["overlap"]})])


def search(spark, c):
    """Queries (qid, query) over the BM25 index: a ranking (qid, rank, doc_id)."""
    found = lexical.open_index(spark, f"{c['index']}/bm25", {"k1": lexical.K1, "b": lexical.B, "tokenizer": "words"}, table(spark, c["corpus"]).count())
    asked = lexical.query_terms(table(spark, c["queries"]), "qid", F.col("query"))
    return lexical.best(found, asked, c["depth"]).select(F.col("query").alias("qid"), "rank", F.col("doc").alias("doc_id"))


def rerank(spark, c):
    """Second scores of a ranking's candidates by the stand-in."""
    texts = table(spark, c["corpus"]).select(F.col(c["key"]).alias("doc_id"), "text")
    run = table(spark, c["run"]).withColumn("rank", F.col("rank").cast("int"))
    return external.rerank(files.pairs(run, table(spark, c["queries"]).select("qid", "query"), texts, c["depth"]))


def _ranked(spark, c, run: str) -> DataFrame:
    found = table(spark, run).select(F.col("qid").alias("query"), F.col("rank").cast("int").alias("rank"), F.col("doc_id").alias("doc"))
    gold = table(spark, c["gold"]).select(F.col("qid").alias("query"), F.col("doc_id").alias("doc"))
    return metrics.per_query(metrics.gold_ranks(gold, found))


def score(spark, c):
    """Recall and reciprocal rank of a ranking against gold (qid, doc_id)."""
    each = _ranked(spark, c, c["run"])
    names = [n for n in each.columns if n.startswith(("recall_", "mrr_"))]
    return each.agg(F.count("*").alias("n"), *(F.round(F.avg(n), 6).alias(n) for n in names))


def score_multi(spark, c):
    """Set metrics of a ranking against gold (qid, gold array)."""
    run = table(spark, c["run"]).groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("rank").cast("int").alias("rank"), F.col("doc_id").alias("doc")))), lambda x: x["doc"]).alias("docs"))
    each = metrics.set_metrics(table(spark, c["gold"]).join(run, "qid").withColumnRenamed("qid", "query"))
    return each.agg(F.count("*").alias("n"), *(F.round(F.avg(n), 6).alias(n) for n in each.columns if n.startswith(("recall_", "complete_", "hit_"))))


def compare(spark, c):
    """A ranking against a base: the mean difference of the reciprocal rank, its interval and the verdict."""
    a, b = (_ranked(spark, c, c[x]).select("query", F.col("mrr_10").alias(x)) for x in ("run", "base"))
    paired = a.join(b, "query").select(F.col("query").cast("string").alias("cluster"), (F.col("run") - F.col("base")).alias("diff"))
    mean, low, high = metrics.bootstrap(metrics.cluster_sums(paired), seed=c["seed"])
    return spark.createDataFrame([(mean, low, high, metrics.verdict(mean, low, high))], "mean double, low double, high double, verdict string")


def make_pools(spark, c):
    """Pools of documents (records: key, doc, cluster) that share a key over several clusters."""
    return pools.find(table(spark, c["records"]), ["key"], c["most_docs"])


def freeze(spark, c):
    """Records without excluded keys; their digest goes beside them."""
    kept, made = files.freeze(table(spark, c["records"]), c["key"], c["excluded"])
    files.write_guarded(spark, f"{c['out']}.sha256", made, c["overwrite"])
    return kept


def generate(spark, c):
    """Prompts (qid, prompt) to answers by the stand-in."""
    return answering.generate(table(spark, c["queries"]))


def judge(spark, c):
    """Answers (qid, answer, contexts, gold) with all checks that need no judge."""
    return answering.record_checks(table(spark, c["records"]), c["phrase"], [], c["parts"]).drop("contexts")


def report(spark, c):
    """Judged records (gold_n, answer_in_chunk, keys, refusal) by what their contexts had."""
    return reports.refusal_table(table(spark, c["records"]))


def speakers(spark, c):
    """Spans of parts (key, text, part, role) in texts."""
    return spans.find_spans(table(spark, c["records"]), "key")


def query(spark, c):
    """A registered query (query=name) over the tables in data."""
    return catalog.queries()[c["query"]](spark, c["data"])


COMMANDS: dict[str, Callable[[SparkSession, dict], DataFrame]] = {
    "ingest": ingest, "splits": splits, "meta-dict": meta_dict, "conditions": conditions_of, "index": index, "search": search, "rerank": rerank, "score": score, "score-multi": score_multi,
    "compare": compare, "pools": make_pools, "freeze": freeze, "generate": generate, "judge": judge, "report": report, "speakers": speakers, "query": query,
}


def main(args: list[str], spark: SparkSession | None = None) -> int:
    if not args or args[0] not in COMMANDS:
        print(__doc__, *(f"  {name}: {f.__doc__}" for name, f in COMMANDS.items()), sep="\n")
        return 2
    c = config.load(DEFAULTS, args[1:])
    spark = spark or local(str(c["cores"]))
    files.refuse_existing(spark, c["out"], c["overwrite"])
    made = COMMANDS[args[0]](spark, c)
    made.write.mode("overwrite" if c["overwrite"] else "errorifexists").parquet(c["out"])
    print(f"{args[0]}: {spark.read.parquet(c['out']).count()} rows in {c['out']}")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
