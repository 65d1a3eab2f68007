"""The composite retriever: lists, fusion, reranking, filter and stage records by a configuration.

A query goes through one DataFrame plan for all queries at once: dense list, BM25 list (or their convex
sum), condition list, fused order, reranked head, best-match filter, cut. Presets are the published
configurations; `replace` of a frozen dataclass derives others.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import dense, fusion, lexical
from ..sources.scratch import scratch
from ..sources.tables import spread, table


@dataclass(frozen=True)
class Config:
    hybrid: bool = True
    fusion: str = "rrf"  # or "score"
    rrf_k: int = 60
    alpha: float = 0.5
    weights: tuple[float, ...] | None = None
    depth: int = 100
    top_k: int = 10
    doc_weights: tuple[float, ...] | None = None
    meta_prefix: tuple[str, ...] = ()
    conditions: bool = False
    fuse_conditions: bool = True
    min_fields: int = 2
    best_filter: bool = False
    rerank_depth: int = 0
    offsets: tuple[int, ...] = field(default=(-1, 0, 1))
    #: Whether a rewritten query adds a dense and a BM25 list; chunks that a chunk of each further index spans.
    rewrite: bool = False
    sizes: tuple[int, ...] = ()

    def __post_init__(self):
        if self.conditions and not self.fuse_conditions and self.fusion != "score":
            raise ValueError("a condition list that is not fused needs score fusion")
        if self.fusion not in ("rrf", "score"):
            raise ValueError(f"no fusion {self.fusion!r}")


DENSE = Config(hybrid=False)
HYBRID = Config()
PREFIXED = replace(HYBRID, meta_prefix=("lang", "source"))
CONDITIONS = replace(PREFIXED, conditions=True)
FILTERED = replace(CONDITIONS, best_filter=True)
WEIGHTED_DOCS = replace(FILTERED, doc_weights=(1.0, 0.1))
WEIGHTED_LISTS = replace(FILTERED, weights=(2.0, 1.0, 1.0))
SMALL_K = replace(FILTERED, rrf_k=20)
CONVEX = replace(FILTERED, fusion="score")
CONVEX_UNFUSED = replace(CONVEX, fuse_conditions=False)
RERANKED = replace(CONVEX_UNFUSED, rerank_depth=20)
SIZES = replace(FILTERED, sizes=(2,))
REWRITTEN = replace(SIZES, rewrite=True)
REWRITTEN_CONVEX = replace(CONVEX, rewrite=True)
#: Words of a rewritten item.
REWRITE = 12
PRESETS = {n.lower(): v for n, v in globals().items() if isinstance(v, Config)}


def retrieve(config: Config, dense_docs: DataFrame, lexical_docs: DataFrame | None = None, matches: DataFrame | None = None, second: DataFrame | None = None, match_scores: DataFrame | None = None, rewritten: list[DataFrame] = ()) -> DataFrame:
    """(query, doc, rank, fused_rank, rank_0, rank_1, rank_2, matched); with rewritten lists rank_3 and rank_4, too.

    dense_docs, lexical_docs: (query, doc, score); matches: (query, doc, matches) of conditions;
    second: (query, doc, second) of a reranker; match_scores: dense scores of the matched documents, where
    dense_docs has only the head of its list; rewritten: (query, doc, score) of the rewritten queries, dense
    and BM25, which follow the other lists. Without a list its ranks are null.
    """
    named = lambda df, i: df.select("query", F.lit(i).alias("list_no"), "rank", "doc", F.col("score").cast("double").alias("score"))
    lists = [named(dense.top(dense_docs, config.depth if config.hybrid else config.top_k, "doc"), 0)]
    if config.hybrid:
        found = lexical_docs if config.fusion == "score" else lexical_docs.where("score > 0")
        lists.append(named(dense.top(found, config.depth, "doc"), 1))
    matched = None
    conditions = None
    if config.hybrid and config.conditions and matches is not None:
        best = matches.withColumn("most", F.max("matches").over(Window.partitionBy("query"))).where(F.col("most") >= config.min_fields)
        order = Window.partitionBy("query").orderBy(F.desc("matches"), F.desc_nulls_last("score"), "doc")
        met = best.where(F.col("matches") >= config.min_fields).join(dense_docs if match_scores is None else match_scores, ["query", "doc"], "left")
        conditions = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= config.depth)
        if config.best_filter:
            matched = best.where("matches = most").select("query", "doc", F.lit(True).alias("matched"))
        if config.fuse_conditions and config.fusion == "rrf":
            lists.append(named(conditions.withColumn("score", F.col("matches")), 2))
    more = [named(dense.top(x.where("score > 0") if i else x, config.depth, "doc"), 3 + i) for i, x in enumerate(rewritten)]
    if config.hybrid:
        lists += more
    every = lists[0]
    for x in lists[1:]:
        every = every.unionByName(x)
    if not config.hybrid:
        fused = every.select("query", "doc", "rank")
    elif config.fusion == "rrf":
        fused = fusion.rrf(every, config.rrf_k, list(config.weights) if config.weights else None).select("query", "doc", "rank")
    else:
        fused = fusion.convex(every.where("list_no < 2"), config.alpha).select("query", "doc", "rank")
        both = fused.withColumns({"list_no": F.lit(0), "score": F.lit(0.0)})
        if conditions is not None and config.fuse_conditions:
            both = both.unionByName(named(conditions.withColumn("score", F.col("matches")), 2))
        for x in more:
            both = both.unionByName(x)
        if more or (conditions is not None and config.fuse_conditions):
            fused = fusion.rrf(both, config.rrf_k).select("query", "doc", "rank")
        elif conditions is not None and matched is not None:
            fused = fusion.append_missing(fused, conditions.join(matched, ["query", "doc"], "left_semi").select("query", "doc", "rank"))
    out = fused.withColumn("fused_rank", F.col("rank"))
    if config.rerank_depth and second is not None:
        out = fusion.rerank_head(out.join(second, ["query", "doc"], "left"), F.coalesce("second", F.lit(float("-inf"))), config.rerank_depth).drop("rank", "second").withColumnRenamed("new_rank", "rank")
    if matched is not None:
        out = out.join(matched, ["query", "doc"], "left").withColumn("matched", F.coalesce("matched", F.lit(False)))
        out = fusion.matched_first(out, F.col("matched")).drop("rank").withColumnRenamed("new_rank", "rank")
    else:
        out = out.withColumn("matched", F.lit(False))
    out = out.where(F.col("rank") <= config.top_k)
    # one join for the ranks of all lists
    ranks = every.groupBy("query", "doc").agg(*(F.max(F.when(F.col("list_no") == i, F.col("rank"))).alias(f"rank_{i}") for i in range(5)))
    out = out.join(ranks, ["query", "doc"], "left")
    return out.select("query", "doc", "rank", "fused_rank", *(f"rank_{i}" for i in range(5 if rewritten else 3)), "matched")


def benchmark_inputs(spark: SparkSession, sf_dir: str, config: Config) -> dict:
    """Benchmark items over documents: vectors, BM25, and source and language as conditions.

    Chunks are the embeddings, four to a document, and beside them those of further indexes; an item's vector
    is the one of its number. Rewritten, an item has its first REWRITE words and the vector of the next number.
    Original and rewritten queries go through each index in one pass.
    """
    from ..functions import text as T
    from ..operators.conditions import field_values, matches

    base = dense.chunks(spark, sf_dir).select("chunk", "doc", "v")
    every = base
    for n in config.sizes:
        every = every.unionByName(dense.merged(base, n))
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), "text")
    ids = items.select("query").distinct()
    vectors = base.select(F.col("chunk").alias("own"), F.col("v").alias("qv"))
    asked = ids.join(vectors, ids["query"] == vectors["own"]).select("query", "own", "qv", F.lit(0).alias("variant"))
    if config.rewrite:
        asked = asked.unionByName(ids.join(vectors, ids["query"] + 1 == vectors["own"]).select("query", "own", "qv", F.lit(1).alias("variant")))
    # the list's number is a part of the query's
    one = asked.select((F.col("query") * 2 + F.col("variant")).alias("query"), "own", "qv")
    apart = lambda df: [df.where(F.col("query") % 2 == i).withColumn("query", F.expr("query div 2")) for i in (0, 1)]
    weights = config.doc_weights or (1.0,)
    found = apart(dense.search(every, one, config.depth if config.hybrid else config.top_k, weights).drop("rank"))
    inputs = {"dense_docs": found[0]}
    if not config.hybrid:
        return inputs
    docs = spread(table(spark, sf_dir, "documents"))
    text = F.concat_ws(" ", T.joined_metadata(*map(F.col, config.meta_prefix)), "text") if config.meta_prefix else F.col("text")
    texts = items.select((F.col("query") * 2).alias("query"), "text")
    if config.rewrite:
        texts = texts.unionByName(items.select((F.col("query") * 2 + 1).alias("query"), F.concat_ws(" ", F.slice(F.split("text", " "), 1, REWRITE)).alias("text")))
    terms = lexical.query_terms(texts, "query", F.col("text"))
    # the head of the list is all that is read of it
    ranked = apart(lexical.best(lexical.index(lexical.documents(docs, "doc_id", text), terms.select("term").distinct()), terms, config.depth).drop("rank"))
    inputs["lexical_docs"] = ranked[0]
    if config.rewrite:
        inputs["rewritten"] = [found[1], ranked[1]]
    asked = asked.where("variant = 0").select("query", "qv")
    if config.conditions:
        wanted = items.select("query", F.when(F.col("query") % 2 == 0, "en").otherwise("fr").alias("lang"), F.concat(F.lit("src"), (F.col("query") % 20).cast("string")).alias("source")).distinct()
        conditions = wanted.select("query", F.explode(F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source"))).alias("field", "value"))
        keyed = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "lang", "source")
        # no more is asked of them than those with min_fields, which are read twice
        counts = scratch(matches(field_values(keyed, "doc", {"lang": F.array("lang"), "source": F.array("source")}), conditions, config.min_fields), "matches")
        inputs["matches"] = counts
        met = dense.pair_scores(counts, every, asked)
        inputs["match_scores"] = dense.doc_weighted(met, list(weights))
    return inputs


def _query(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        config = PRESETS[name]
        return retrieve(config, **benchmark_inputs(spark, sf_dir, config))

    return run


def _sql(meta: bool = False, conditions: bool = False, best: bool = False, fusion: str = "rrf", sizes: bool = False, rewrite: bool = False) -> str:
    """fusion: rrf, convex (conditions appended), or none (the dense list alone); sizes: an index of pairs of chunks, too; rewrite: five lists, by rrf."""
    text = "concat_ws(' ', nullif(lang, ''), nullif(source, ''), text)" if meta else "text"
    head = "select query, doc, rank, score from (select *, row_number() over (partition by query order by score desc, doc) as rank from {0}) where rank <= {1}"
    pairs = "union all select -1 - a.chunk // 2, a.doc, list_transform(range(1, len(a.v) + 1), lambda i: (a.v[i] + b.v[i]) / 2) from e a join e b on b.chunk = a.chunk + 1 where a.chunk % 2 = 0"
    vectors = f"""
e as (select vec_id as chunk, vec_id // 4 as doc, cast(embedding as double[]) as v from embeddings where embedding is not null),
x as (select * from e {pairs if sizes else ''}),
v as (select q.chunk as query, c.doc, max(round(list_dot_product(c.v, q.v), 6)) as score from x c join e q on c.chunk <> q.chunk where q.chunk in (select item_id from benchmark) group by all),
v2 as (select q.chunk - 1 as query, c.doc, max(round(list_dot_product(c.v, q.v), 6)) as score from x c join e q on c.chunk <> q.chunk where q.chunk - 1 in (select item_id from benchmark) group by all)"""
    if fusion == "none":
        return f"""with {vectors}
select query, doc, cast(rank as integer) as rank, cast(rank as integer) as fused_rank, cast(rank as integer) as rank_0, cast(null as integer) as rank_1, cast(null as integer) as rank_2, false as matched
from ({head.format('v', 10)})"""
    cond = """
m as (select q.item_id as query, d.doc_id as doc, (d.lang = case when q.item_id % 2 = 0 then 'en' else 'fr' end)::int + (d.source = 'src' || (q.item_id % 20)::varchar)::int as matches
  from (select distinct item_id from benchmark) q cross join documents d),
mm as (select *, max(matches) over (partition by query) as most from m where matches > 0),
c as (select mm.query, mm.doc, mm.matches, v.score from mm left join v on v.query = mm.query and v.doc = mm.doc where most >= 2 and matches >= 2),
l2 as (select query, 2 as list_no, doc, rank, matches as score from (select *, row_number() over (partition by query order by matches desc, score desc nulls last, doc) as rank from c) where rank <= 100),
best as (select query, doc from mm where most >= 2 and matches = most),"""
    if fusion == "rrf":
        terms = " + ".join(f"coalesce(max(case when list_no = {i} then 1.0 / (60 + rank) end), 0)" for i in range(5 if rewrite else 3))
        each = f"""select query, doc, min(list_no * 1000 + rank) as seen, round({terms}, 9) as score from lists group by all"""
        more = ""
    else:
        each = """select query, doc, min(list_no * 1000 + rank) as seen,
  round(0.5 * coalesce(max(case when list_no = 0 then s end), 0) + 0.5 * coalesce(max(case when list_no = 1 then s end), 0), 9) as score
  from (select query, list_no, doc, rank, case when hi > lo then (score - lo) / (hi - lo) else 0.0 end as s
    from (select *, max(score) over w as hi, min(score) over w as lo from lists window w as (partition by query, list_no))) group by all"""
        more = """union all select l2.query, l2.doc, coalesce(z.last, 0) + row_number() over (partition by l2.query order by l2.rank)
  from l2 join best on best.query = l2.query and best.doc = l2.doc left join (select query, count(*) as last from each group by 1) z on z.query = l2.query
  where not exists (select 1 from each x where x.query = l2.query and x.doc = l2.doc)"""
    fused_conditions = conditions and fusion == "rrf"
    ctes = lexical.run_ctes(text)
    again = ""
    if rewrite:  # the same scores for the rewritten items
        again = ctes[ctes.index("\nq as") : ctes.index("\nrun as")].replace("\nq as", "\nq2 as").replace("\nscored as", "\nscored2 as").replace("from q join", "from q2 q join")
        again = again.replace("lower(text)", f"lower(array_to_string(string_split(text, ' ')[1:{REWRITE}], ' '))")
        again += f"""
s2 as (select item_id as query, doc_id as doc, score from scored2),
l3 as (select query, 3 as list_no, doc, rank, score from ({head.format('v2', 100)})),
l4 as (select query, 4 as list_no, doc, rank, score from ({head.format('s2', 100)})),"""
    return f"""with {ctes},
s as (select item_id as query, doc_id as doc, score from scored),{vectors},{again}
l0 as (select query, 0 as list_no, doc, rank, score from ({head.format('v', 100)})),
l1 as (select query, 1 as list_no, doc, rank, score from ({head.format('s', 100)})),{cond}
lists as (select * from l0 union all select * from l1 {'union all select * from l2' if fused_conditions else ''} {'union all select * from l3 union all select * from l4' if rewrite else ''}),
each as ({each}),
fused as (select query, doc, row_number() over (partition by query order by score desc, seen) as fused_rank from each {more}),
f as (select f.query, f.doc, f.fused_rank, {'best.doc is not null' if best else 'false'} as matched from fused f left join best on best.query = f.query and best.doc = f.doc),
r as (select *, row_number() over (partition by query order by case when matched then 0 else 1 end, fused_rank) as rank from f)
select r.query, r.doc, cast(r.rank as integer) as rank, cast(fused_rank as integer) as fused_rank, cast(l0.rank as integer) as rank_0, cast(l1.rank as integer) as rank_1,
  {'cast(l2.rank as integer)' if fused_conditions else 'cast(null as integer)'} as rank_2, {'cast(l3.rank as integer) as rank_3, cast(l4.rank as integer) as rank_4,' if rewrite else ''} matched
from r left join l0 on l0.query = r.query and l0.doc = r.doc left join l1 on l1.query = r.query and l1.doc = r.doc left join l2 on l2.query = r.query and l2.doc = r.doc
{'left join l3 on l3.query = r.query and l3.doc = r.doc left join l4 on l4.query = r.query and l4.doc = r.doc' if rewrite else ''} where r.rank <= 10"""


QUERIES = {f"retrieve_{n}": _query(n) for n in ("dense", "hybrid", "prefixed", "conditions", "filtered", "convex_unfused", "sizes", "rewritten")}
ORACLES = {
    "retrieve_dense": _sql(fusion="none"),
    "retrieve_hybrid": _sql(),
    "retrieve_prefixed": _sql(True),
    "retrieve_conditions": _sql(True, True),
    "retrieve_filtered": _sql(True, True, True),
    "retrieve_convex_unfused": _sql(True, True, True, "convex"),
    "retrieve_sizes": _sql(True, True, True, sizes=True),
    "retrieve_rewritten": _sql(True, True, True, sizes=True, rewrite=True),
}
