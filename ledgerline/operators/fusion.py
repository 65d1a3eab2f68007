"""Ranked lists: reciprocal-rank and min-max fusion, reranking, filters, stage records, slot replacement.

A list is rows (query, list_no, rank, doc, score). Ties keep the order in which documents are first
seen (list by list, then rank), so every order here ends with that key. Sums run over the lists in
order, so they are the same however rows were dealt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import dense

RRF_K, DEPTH, TOP = 60, 100, 10


def rrf(lists: DataFrame, k: int = RRF_K, weights: list[float] | None = None) -> DataFrame:
    """(query, doc, score, rank): the sum of weight / (k + rank) over lists."""
    weight = F.lit(1.0) if weights is None else F.array(*map(F.lit, weights))[F.col("list_no")]
    term = lists.select("query", "doc", F.struct("list_no", "rank").alias("seen"), (weight / (k + F.col("rank"))).alias("t"))
    each = term.groupBy("query", "doc").agg(F.sort_array(F.collect_list(F.struct("seen", "t"))).alias("ts"))
    score = F.round(F.aggregate("ts", F.lit(0.0).cast("double"), lambda s, x: s + x["t"]), 9)
    return _ranked(each.select("query", "doc", score.alias("score"), F.col("ts")[0]["seen"].alias("seen")))


def _ranked(fused: DataFrame) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "seen"))
    return fused.withColumn("rank", rank).drop("seen")


def minmax(lists: DataFrame) -> DataFrame:
    """Scores of each list between 0 (its last) and 1 (its first); all 0 where they are equal."""
    w = Window.partitionBy("query", "list_no")
    high, low = F.max("score").over(w), F.min("score").over(w)
    return lists.withColumn("score", F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(0.0))


def convex(lists: DataFrame, alpha: float = 0.5) -> DataFrame:
    """(query, doc, score, rank): alpha of list 0 and 1 - alpha of list 1, 0 where a list lacks the document."""
    normal = minmax(lists)
    each = normal.groupBy("query", "doc").agg(
        F.min(F.struct("list_no", "rank")).alias("seen"),
        F.max(F.when(F.col("list_no") == 0, F.col("score"))).alias("a"),
        F.max(F.when(F.col("list_no") == 1, F.col("score"))).alias("b"),
    )
    score = F.round(alpha * F.coalesce("a", F.lit(0.0)) + (1 - alpha) * F.coalesce("b", F.lit(0.0)), 9)
    return _ranked(each.select("query", "doc", score.alias("score"), "seen"))


def rerank_head(ranked: DataFrame, second: Column, depth: int) -> DataFrame:
    """The first `depth` documents by their second score, the others as they were."""
    head = F.col("rank") <= depth
    order = Window.partitionBy("query").orderBy(F.when(head, 0).otherwise(1), F.when(head, -second), "rank")
    return ranked.withColumn("new_rank", F.row_number().over(order))


def matched_first(ranked: DataFrame, matched: Column, rank: str = "rank") -> DataFrame:
    """Matched documents first, both parts in their order."""
    order = Window.partitionBy("query").orderBy(F.when(matched, 0).otherwise(1), rank)
    return ranked.withColumn("new_rank", F.row_number().over(order))


def append_missing(ranked: DataFrame, more: DataFrame) -> DataFrame:
    """more (query, doc, rank) whose documents the list lacks go to its end, in order."""
    last = ranked.groupBy("query").agg(F.max("rank").alias("last"))
    new = more.join(ranked, ["query", "doc"], "left_anti").join(last, "query", "left")
    at = F.row_number().over(Window.partitionBy("query").orderBy("rank")) + F.coalesce("last", F.lit(0))
    return ranked.select("query", "doc", "rank").unionByName(new.select("query", "doc", at.alias("rank")))


def swap_gold(docs: Column, gold: Column, k: int) -> Column:
    """The first k with gold in the last slot; null where it is there already."""
    head = F.slice(docs, 1, k)
    return F.when(~F.array_contains(head, gold), F.concat(F.slice(docs, 1, k - 1), F.array(gold)))


def drop_gold(docs: Column, gold: Column, k: int) -> Column:
    """The first k without gold, others moving up; null where it is not there."""
    return F.when(F.array_contains(F.slice(docs, 1, k), gold), F.slice(F.array_remove(docs, gold), 1, k))


def reuse(now: Column, before: Column, k: int) -> Column:
    """Current evidence first, earlier cited evidence at the end in place of its tail; k items."""
    kept = F.array_except(before, now)
    room = F.greatest(F.lit(k) - F.size(kept), F.lit(0))
    return F.slice(F.concat(F.slice(now, F.lit(1), room), kept), 1, k)


def label_list(spark: SparkSession, sf_dir: str, depth: int = DEPTH) -> DataFrame:
    """(query, doc, score, rank): documents with a chunk of the query's label, by number of such chunks but the query's own.

    The first depth + 1 documents of each label are enough, as a query takes one chunk of one document away.
    """
    every = dense.chunks(spark, sf_dir).where("label is not null")
    counted = every.groupBy("label", "doc").agg(F.count("*").alias("n"))
    first = dense.top(counted, depth + 1, "doc", "label", "n").drop("rank")
    asked = dense.queries(spark, sf_dir).select("query", F.expr("query div 4").alias("own"), F.col("qlabel").alias("label"))
    met = first.join(asked, "label").select("query", "doc", (F.col("n") - (F.col("doc") == F.col("own")).cast("int")).cast("double").alias("score"))
    return dense.top(met.where("score > 0"), depth, "doc")


def two_lists(spark: SparkSession, sf_dir: str, depth: int = DEPTH) -> DataFrame:
    """List 0: documents by best chunk; list 1: documents with a chunk of the query's label, by number of such chunks."""
    a = dense.search(dense.chunks(spark, sf_dir), dense.queries(spark, sf_dir), depth, (1.0,))
    b = label_list(spark, sf_dir, depth)
    return a.select("query", F.lit(0).alias("list_no"), "rank", "doc", "score").unionByName(b.select("query", F.lit(1).alias("list_no"), "rank", "doc", "score"))


def _top(fused: DataFrame) -> DataFrame:
    return fused.where(F.col("rank") <= TOP).select("query", "doc", F.round("score", 6).alias("score"), "rank")


def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top(rrf(two_lists(spark, sf_dir)))


def rrf_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top(rrf(two_lists(spark, sf_dir), 20, [2.0, 1.0]))


def minmax_convex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top(convex(two_lists(spark, sf_dir)))


def rerank_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RRF candidates, the first 20 by their weighted chunk score."""
    fused = rrf(two_lists(spark, sf_dir))
    scored = dense.pair_scores(fused, dense.chunks(spark, sf_dir), dense.queries(spark, sf_dir))
    second = dense.doc_weighted(scored, [1.0, 0.1]).withColumnRenamed("score", "second")
    out = rerank_head(fused.join(second, ["query", "doc"]), F.col("second"), 20)
    return out.where(F.col("new_rank") <= TOP).select("query", "doc", "second", F.col("new_rank").alias("rank"))


def best_match_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RRF candidates, those with the most chunks of the query's label first (two at least)."""
    lists = two_lists(spark, sf_dir)
    most = lists.where("list_no = 1").withColumn("top", F.max("score").over(Window.partitionBy("query")))
    matched = most.where("score = top and top >= 2").select("query", "doc", F.lit(True).alias("matched"))
    out = matched_first(rrf(lists).join(matched, ["query", "doc"], "left"), F.coalesce("matched", F.lit(False)))
    return out.where(F.col("new_rank") <= TOP).select("query", "doc", F.coalesce("matched", F.lit(False)).alias("matched"), F.col("new_rank").alias("rank"))


def stage_explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fused top with the rank of each list, null where absent."""
    lists = two_lists(spark, sf_dir)
    each = [lists.where(F.col("list_no") == i).select("query", "doc", F.col("rank").alias(f"rank_{i}")) for i in (0, 1)]
    out = rrf(lists).where(F.col("rank") <= TOP)
    for e in each:
        out = out.join(e, ["query", "doc"], "left")
    return out.select("query", "doc", F.round("score", 6).alias("score"), "rank", "rank_0", "rank_1")


def fused_arrays(spark: SparkSession, sf_dir: str, k: int = 20) -> DataFrame:
    """(query, docs): the fused first k as an array in order."""
    fused = rrf(two_lists(spark, sf_dir)).where(F.col("rank") <= k)
    return fused.groupBy("query").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc"))), lambda x: x["doc"]).alias("docs"))


def swap_gold_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold is the eighth document of a query."""
    gold = F.col("docs")[7]
    out = fused_arrays(spark, sf_dir).select("query", swap_gold(F.col("docs"), gold, 5).alias("swapped"), drop_gold(F.col("docs"), F.col("docs")[1], 5).alias("dropped"))
    return out.select("query", F.array_join("swapped", ",").alias("swapped"), F.array_join("dropped", ",").alias("dropped"))


def evidence_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five of a query, with the first two of the query before it kept."""
    a = fused_arrays(spark, sf_dir)
    before = a.select((F.col("query") + dense.QUERY_STEP).alias("query"), F.slice("docs", 1, 2).alias("before"))
    out = a.join(before, "query").select("query", reuse(F.slice("docs", 1, 5), F.col("before"), 5).alias("docs"))
    return out.select("query", F.array_join("docs", ",").alias("docs"))


LISTS_SQL = f"""{dense.SCORED_SQL},
a as ({dense.top_sql('docmax', DEPTH, 'doc', 'query, 0 as list_no, doc, score')}),
same as (select query, doc, cast(count(*) as double) as score from scored where label = qlabel group by all),
b as ({dense.top_sql('same', DEPTH, 'doc', 'query, 1 as list_no, doc, score')}),
lists as (select * from a union all select * from b)"""


def rrf_sql(k: int = RRF_K, weights: tuple[float, float] = (1.0, 1.0)) -> str:
    return f"""{LISTS_SQL},
each as (select query, doc, min(list_no * 1000 + rank) as seen,
  round(coalesce(max(case when list_no = 0 then {weights[0]} / ({k} + rank) end), 0) + coalesce(max(case when list_no = 1 then {weights[1]} / ({k} + rank) end), 0), 9) as score
  from lists group by all),
fused as (select query, doc, score, cast(row_number() over (partition by query order by score desc, seen) as integer) as rank from each)"""


_TOP_SQL = f"select query, doc, round(score, 6) as score, rank from fused where rank <= {TOP}"
_ARRAYS = "arrays as (select query, list(doc order by rank) as docs from fused where rank <= 20 group by 1)"
QUERIES = {
    "rrf_fuse": rrf_fuse,
    "rrf_weighted": rrf_weighted,
    "minmax_convex": minmax_convex,
    "rerank_top": rerank_top,
    "best_match_filter": best_match_filter,
    "stage_explain": stage_explain,
    "swap_gold": swap_gold_query,
    "evidence_reuse": evidence_reuse,
}
ORACLES = {
    "rrf_fuse": f"with {rrf_sql()} {_TOP_SQL}",
    "rrf_weighted": f"with {rrf_sql(20, (2.0, 1.0))} {_TOP_SQL}",
    "minmax_convex": f"""with {LISTS_SQL},
n as (select *, max(score) over w as hi, min(score) over w as lo from lists window w as (partition by query, list_no)),
m as (select query, list_no, doc, rank, case when hi > lo then (score - lo) / (hi - lo) else 0.0 end as s from n),
each as (select query, doc, min(list_no * 1000 + rank) as seen,
  round(0.5 * coalesce(max(case when list_no = 0 then s end), 0) + 0.5 * coalesce(max(case when list_no = 1 then s end), 0), 9) as score from m group by all),
fused as (select query, doc, score, cast(row_number() over (partition by query order by score desc, seen) as integer) as rank from each) {_TOP_SQL}""",
    "rerank_top": f"""with {rrf_sql()},
j as (select f.query, f.doc, f.rank, w.score as second from fused f join weighted w using (query, doc)),
o as (select query, doc, second, cast(row_number() over (partition by query order by case when rank <= 20 then 0 else 1 end, case when rank <= 20 then -second end, rank) as integer) as rank from j)
select * from o where rank <= {TOP}""",
    "best_match_filter": f"""with {rrf_sql()},
m as (select query, doc from (select *, max(score) over (partition by query) as top from b) where score = top and top >= 2),
o as (select f.query, f.doc, m.doc is not null as matched, cast(row_number() over (partition by f.query order by case when m.doc is not null then 0 else 1 end, rank) as integer) as rank
  from fused f left join m on m.query = f.query and m.doc = f.doc)
select * from o where rank <= {TOP}""",
    "stage_explain": f"""with {rrf_sql()}
select f.query, f.doc, round(f.score, 6) as score, f.rank, a.rank as rank_0, b.rank as rank_1
from fused f left join a on a.query = f.query and a.doc = f.doc left join b on b.query = f.query and b.doc = f.doc where f.rank <= {TOP}""",
    "swap_gold": f"""with {rrf_sql()}, {_ARRAYS}
select query, array_to_string(list_append(docs[1:4], docs[8]), ',') as swapped, array_to_string(list_filter(docs, lambda x: x <> docs[2])[1:5], ',') as dropped from arrays""",
    "evidence_reuse": f"""with {rrf_sql()}, {_ARRAYS},
j as (select a.query, a.docs[1:5] as now, b.docs[1:2] as before from arrays a join arrays b on b.query + {dense.QUERY_STEP} = a.query),
k as (select query, now, list_filter(before, lambda x: not list_contains(now, x)) as kept from j)
select query, array_to_string(list_concat(now[1:5 - len(kept)], kept)[1:5], ',') as docs from k""",
}
