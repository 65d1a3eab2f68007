"""Retrieval metrics: ranks of gold documents, recall, MRR, grouping sets, multi-document gold, validation, bootstrap."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.scratch import scratch
from ..sources.tables import spread, table
from . import dictionary, lexical

KS, MRR_K = (1, 5, 10), 10

#: Picks of the bootstrap in memory at a time.
PICKS = 1 << 22


def distinct_ranks(run: DataFrame) -> DataFrame:
    """run (query, rank, doc): a document's first place only, ranks counted anew."""
    first = run.groupBy("query", "doc").agg(F.min("rank").alias("rank"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("rank", "doc")))


def gold_ranks(gold: DataFrame, run: DataFrame) -> DataFrame:
    """gold (query, doc, ...) with the rank of its document, null where the run lacks it."""
    hit = distinct_ranks(run).select("query", "doc", "rank")
    return gold.join(hit, ["query", "doc"], "left")


def per_query(ranked: DataFrame, ks=KS, mrr_k: int = MRR_K) -> DataFrame:
    """Recall at k (0 or 1) and the reciprocal rank, 0 beyond mrr_k."""
    columns = {f"recall_{k}": F.when(F.col("rank") <= k, 1.0).otherwise(0.0) for k in ks}
    return ranked.withColumns(columns | {f"mrr_{mrr_k}": F.when(F.col("rank") <= mrr_k, 1.0 / F.col("rank")).otherwise(0.0)})


def metric_table(scored: DataFrame, metrics: list[str], breakdowns: list[str]) -> DataFrame:
    """Grouping sets (), (b1), (b2), ...: number and means of metrics."""
    sets = ", ".join(["()", *(f"({b})" for b in breakdowns)])
    means = ", ".join(f"round(avg({m}), 6) as {m}" for m in metrics)
    names = ", ".join(breakdowns)
    return scored.sparkSession.sql(f"select {names}, count(*) as n, {means} from {{scored}} group by grouping sets ({sets})", scored=scored)


def set_metrics(lists: DataFrame, ks=(5, 10)) -> DataFrame:
    """lists (query, docs, gold arrays): recall, complete and hit at each k."""
    columns = {}
    for k in ks:
        hits = F.size(F.array_intersect(F.slice("docs", 1, k), "gold"))
        columns |= {f"recall_{k}": F.round(hits / F.size("gold"), 6), f"complete_{k}": (hits == F.size("gold")).cast("double"), f"hit_{k}": (hits > 0).cast("double")}
    return lists.withColumns(columns)


def validate(gold: DataFrame, run: DataFrame, least: int) -> DataFrame:
    """One row of counts: queries that are extra, missing, short of `least` documents, and repeated ranks."""
    g, r = gold.select("query").distinct(), run.select("query").distinct()
    extra = r.join(g, "query", "left_anti").agg(F.count("*").alias("extra"))
    missing = g.join(r, "query", "left_anti").agg(F.count("*").alias("missing"))
    short = run.groupBy("query").agg(F.countDistinct("doc").alias("n")).where(F.col("n") < least).agg(F.count("*").alias("short_lists"))
    ranks = run.groupBy("query", "rank").agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("repeated_ranks"))
    return extra.join(missing).join(short).join(ranks)  # one row each


def cluster_sums(paired: DataFrame) -> DataFrame:
    """paired (cluster, diff; null where a side has no value) -> sum and count of each cluster."""
    return paired.where("diff is not null").groupBy("cluster").agg(F.round(F.sum("diff"), 6).alias("total"), F.count("*").alias("n"))


def bootstrap(clusters: DataFrame, resamples: int = 10_000, seed: int = 20260929, alpha: float = 0.05) -> tuple[float, float, float]:
    """(mean, low, high): clusters resampled with replacement; a mean is the sums' sum over the counts' sum.

    Clusters are few next to rows: their sums and counts come to the driver, in the order of their names.
    """
    rows = clusters.orderBy("cluster").select("total", "n").toArrow()
    total, n = rows.column("total").to_numpy(), rows.column("n").to_numpy()
    rng, means = np.random.default_rng(seed), np.empty(resamples)
    step = max(1, PICKS // max(1, len(n)))  # some resamples at a time, so memory does not grow with their number
    for i in range(0, resamples, step):
        picks = rng.integers(0, len(n), size=(min(step, resamples - i), len(n)))
        means[i : i + step] = total[picks].sum(1) / n[picks].sum(1)
    low, high = np.quantile(means, [alpha / 2, 1 - alpha / 2])
    return float(total.sum() / n.sum()), float(low), float(high)


def verdict(point: float, low: float, high: float, least: float = 0.01) -> str:
    """adopt, reject or hold."""
    if low > 0 and point >= least:
        return "adopt"
    return "reject" if high < 0 else "hold"


def metadata_verdict(single: str, recall: tuple[float, float, float], complete_high: float, least: float = 0.01) -> tuple[str, str]:
    """A held single-document verdict falls to the multi-document one, which loses an adoption if completeness fell."""
    if single != "hold":
        return single, "single"
    found = verdict(*recall, least)
    return ("hold" if found == "adopt" and complete_high < 0 else found), "multi"


def answer_verdict(composite: tuple[float, float, float], safety: list[bool], least: float = 0.02) -> str:
    """Reject a loss; hold what is not surely and clearly better, or fails a safety condition; else adopt."""
    point, low, high = composite
    if high < 0:
        return "reject"
    return "hold" if low <= 0 or point < least or not all(safety) else "adopt"


def item_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, query, start, end): all places of benchmark items in documents, overlapping ones too."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), F.col("text").alias("form"))
    docs = spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text"))
    return dictionary.occurrences(docs, items, "doc").join(items, "form").select("doc", "query", "start", "end")


def benchmark_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query, doc, lang): documents that hold a benchmark item's text, of any length."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "lang")
    return item_places(spark, sf_dir).select("query", "doc").distinct().join(docs, "doc").select("query", "doc", "lang")


def recall_mrr_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = per_query(gold_ranks(benchmark_gold(spark, sf_dir), lexical.benchmark_run(spark, sf_dir)))
    return metric_table(ranked, ["recall_1", "recall_5", "recall_10", "mrr_10"], ["lang"])


def multi_gold_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = benchmark_gold(spark, sf_dir).groupBy("query").agg(F.sort_array(F.collect_set("doc")).alias("gold"))
    run = lexical.benchmark_run(spark, sf_dir).groupBy("query").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc"))), lambda x: x["doc"]).alias("docs"))
    out = set_metrics(gold.join(run, "query", "left").withColumn("docs", F.coalesce("docs", F.array().cast("array<bigint>"))))
    return out.select(F.col("query").alias("item_id"), F.size("gold").cast("bigint").alias("n_gold"), *(f"{m}_{k}" for k in (5, 10) for m in ("recall", "complete", "hit")))


def two_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query, cluster, diff) of the reciprocal rank between plain and prefixed BM25, per gold document; cluster is the source."""
    from ..functions import text as T

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.col("source").alias("cluster"))
    gold = scratch(benchmark_gold(spark, sf_dir).select("query", "doc"), "gold")  # read twice
    a = per_query(gold_ranks(gold, lexical.benchmark_run(spark, sf_dir))).select("query", "doc", F.col("mrr_10").alias("a"))
    b = per_query(gold_ranks(gold, lexical.benchmark_run(spark, sf_dir, F.concat_ws(" ", T.joined_metadata(F.col("lang"), F.col("source")), "text")))).select("query", "doc", F.col("mrr_10").alias("b"))
    return a.join(b, ["query", "doc"]).join(docs, "doc").select("query", "cluster", (F.col("b") - F.col("a")).alias("diff"))


def cluster_sums_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_sums(two_runs(spark, sf_dir))


def paired_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    point, low, high = bootstrap(cluster_sums(two_runs(spark, sf_dir)))
    return spark.createDataFrame([(point, low, high, verdict(point, low, high))], "point double, low double, high double, verdict string")


def run_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    # both are read several times, and small
    return validate(scratch(benchmark_gold(spark, sf_dir).select("query", "doc"), "gold"), scratch(lexical.benchmark_run(spark, sf_dir), "run"), 10)


def g2_rank_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold pairs by the best rank of two lists: top 5, top 20, beyond or absent."""
    from ..functions import text as T

    gold = scratch(benchmark_gold(spark, sf_dir).select("query", "doc"), "gold")  # read twice
    text = F.concat_ws(" ", T.joined_metadata(F.col("lang"), F.col("source")), "text")
    a = gold_ranks(gold, lexical.benchmark_run(spark, sf_dir, k=50)).withColumnRenamed("rank", "a")
    b = gold_ranks(gold, lexical.benchmark_run(spark, sf_dir, text, 50)).withColumnRenamed("rank", "b")
    best = F.least("a", "b")
    kind = F.when(best <= 5, "top5").when(best <= 20, "top20").when(best.isNotNull(), "beyond").otherwise("absent")
    return a.join(b, ["query", "doc"]).groupBy(kind.alias("rank_type")).agg(F.count("*").alias("n"))


GOLD_SQL = "gold as (select b.item_id, d.doc_id, d.lang, d.source from documents d join benchmark b on contains(d.text, b.text))"
RANKED_SQL = """ranked as (select g.*, r.rank from gold g left join run r on r.item_id = g.item_id and r.doc_id = g.doc_id),
per as (select *, case when rank <= 1 then 1.0 else 0.0 end as recall_1, case when rank <= 5 then 1.0 else 0.0 end as recall_5,
  case when rank <= 10 then 1.0 else 0.0 end as recall_10, case when rank <= 10 then 1.0 / rank else 0.0 end as mrr_10 from ranked)"""
PREFIXED = "concat_ws(' ', nullif(lang, ''), nullif(source, ''), text)"


def _two(k: int = 10) -> str:
    first = lexical.run_ctes(k=k)
    second = lexical.run_ctes(PREFIXED, k)
    for name in ("d", "dl", "corpus", "tf", "dfs", "q", "scored", "run"):
        second = second.replace(f"\n{name} as", f"\n{name}_2 as")
    import re

    second = re.sub(r"\b(from|join) (d|dl|corpus|tf|dfs|q|scored)\b(?!_2)", lambda m: f"{m[1]} {m[2]}_2 {m[2]}", second).replace("(select doc_id, unnest(toks) as term from d_2 d)", "(select doc_id, unnest(toks) as term from d_2)")
    return f"{first},{second}, {GOLD_SQL}"


QUERIES = {
    "recall_mrr_table": recall_mrr_table,
    "multi_gold_metrics": multi_gold_metrics,
    "cluster_sums": cluster_sums_query,
    "paired_bootstrap": paired_bootstrap,
    "run_validation": run_validation,
    "g2_rank_type": g2_rank_type,
}
ORACLES = {
    "recall_mrr_table": f"""with {lexical.run_ctes()}, {GOLD_SQL}, {RANKED_SQL}
select lang, count(*) as n, round(avg(recall_1), 6) as recall_1, round(avg(recall_5), 6) as recall_5, round(avg(recall_10), 6) as recall_10, round(avg(mrr_10), 6) as mrr_10
from per group by grouping sets ((), (lang))""",
    "multi_gold_metrics": f"""with {lexical.run_ctes()}, {GOLD_SQL},
g as (select item_id, list(distinct doc_id) as gold from gold group by item_id),
r as (select item_id, list(doc_id order by rank) as docs from run group by item_id),
j as (select g.item_id, gold, coalesce(docs, []) as docs from g left join r using (item_id)),
h as (select *, len(list_intersect(docs[1:5], gold)) as h5, len(list_intersect(docs[1:10], gold)) as h10 from j)
select item_id, len(gold) as n_gold, round(h5 / len(gold), 6) as recall_5, cast(h5 = len(gold) as double) as complete_5, cast(h5 > 0 as double) as hit_5,
  round(h10 / len(gold), 6) as recall_10, cast(h10 = len(gold) as double) as complete_10, cast(h10 > 0 as double) as hit_10 from h""",
    "cluster_sums": f"""with {_two()},
x as (select g.item_id, g.doc_id, g.source as cluster,
  case when r2.rank <= 10 then 1.0 / r2.rank else 0.0 end - case when r1.rank <= 10 then 1.0 / r1.rank else 0.0 end as diff
  from gold g left join run r1 on r1.item_id = g.item_id and r1.doc_id = g.doc_id left join run_2 r2 on r2.item_id = g.item_id and r2.doc_id = g.doc_id)
select cluster, round(sum(diff), 6) as total, count(*) as n from x group by cluster""",
    "run_validation": f"""with {lexical.run_ctes()}, {GOLD_SQL}
select (select count(*) from (select distinct item_id from run) r where item_id not in (select item_id from gold)) as extra,
  (select count(*) from (select distinct item_id from gold) g where item_id not in (select item_id from run)) as missing,
  (select count(*) from (select item_id from run group by item_id having count(distinct doc_id) < 10)) as short_lists,
  (select count(*) from (select item_id, rank from run group by all having count(*) > 1)) as repeated_ranks""",
    "g2_rank_type": f"""with {_two(50)},
x as (select least(r1.rank, r2.rank) as best from gold g left join run r1 on r1.item_id = g.item_id and r1.doc_id = g.doc_id left join run_2 r2 on r2.item_id = g.item_id and r2.doc_id = g.doc_id)
select case when best <= 5 then 'top5' when best <= 20 then 'top20' when best is not null then 'beyond' else 'absent' end as rank_type, count(*) as n from x group by all""",
}
