"""Five lists in one retriever, by hand."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import dense
from ledgerline.plans import retrieval

KIND = "query bigint, doc bigint, score double"


def lists(spark):
    of = lambda *docs: spark.createDataFrame([(1, d, 10.0 - i) for i, d in enumerate(docs)], KIND)
    matches = spark.createDataFrame([(1, 40, 2), (1, 11, 2), (1, 12, 1)], "query bigint, doc bigint, matches bigint")
    return of(10, 11, 12), of(11, 20), matches, [of(30, 10), of(20, 30)]


def test_five_lists_by_reciprocal_ranks(spark):
    a, b, matches, more = lists(spark)
    config = replace(retrieval.CONDITIONS, rewrite=True, weights=(2.0, 1.0, 1.0, 0.5, 0.5), top_k=9)
    out = {r.doc: r for r in retrieval.retrieve(config, a, b, matches, rewritten=more).collect()}
    ranks = {0: (10, 11, 12), 1: (11, 20), 2: (11, 40), 3: (30, 10), 4: (20, 30)}
    score = {}
    for n, docs in ranks.items():
        for i, d in enumerate(docs, 1):
            score[d] = score.get(d, 0) + config.weights[n] / (60 + i)
    assert sorted(out, key=lambda d: out[d]["rank"]) == sorted(score, key=lambda d: -score[d])
    for d, r in out.items():
        assert [r[f"rank_{i}"] for i in range(5)] == [docs.index(d) + 1 if d in docs else None for docs in ranks.values()]
    plain = retrieval.retrieve(retrieval.CONDITIONS, a, b, matches)
    assert plain.columns == ["query", "doc", "rank", "fused_rank", "rank_0", "rank_1", "rank_2", "matched"]


def test_rewritten_lists_beside_a_score_fusion(spark):
    a, b, matches, more = lists(spark)
    out = {r.doc: r["rank"] for r in retrieval.retrieve(replace(retrieval.REWRITTEN_CONVEX, best_filter=False), a, b, matches, rewritten=more).collect()}
    # convex: 11 (0.5 * 0.5 + 0.5), 10 (0.5), then 12 and 20 (0)
    fused, conditions, lists_ = (11, 10, 12, 20), (11, 40), ((30, 10), (20, 30))
    score = {}
    for docs in (fused, conditions, *lists_):
        for i, d in enumerate(docs, 1):
            score[d] = score.get(d, 0) + 1 / (60 + i)
    assert sorted(out, key=out.get)[:3] == sorted(score, key=lambda d: -score[d])[:3] and set(out) == set(score)


def test_merged_chunks(spark):
    rows = [(0, 0, [1.0, 3.0]), (1, 0, [3.0, 5.0]), (2, 0, [0.0, 0.0]), (4, 1, [1.0, 1.0]), (5, 1, [2.0]), (6, 1, [1.0, 0.0]), (7, 1, [0.0, 1.0])]
    got = {r.chunk: (r.doc, r.v) for r in dense.merged(spark.createDataFrame(rows, "chunk bigint, doc bigint, v array<double>"), 2).collect()}
    assert got == {-1: (0, [2.0, 4.0]), -4: (1, [0.5, 0.5])}


def test_queries_of_several_vectors(spark):
    chunks = spark.createDataFrame([(i, i // 2, [float(i), 1.0]) for i in range(8)], "chunk bigint, doc bigint, v array<double>")
    asked = spark.createDataFrame([(10, 7, [1.0, 0.0]), (11, 3, [-1.0, 0.0])], "query bigint, own bigint, qv array<double>")
    got = {(r.query, r["rank"]): r.chunk for r in dense.search(chunks, asked, 2).collect()}
    assert got == {(10, 1): 6, (10, 2): 5, (11, 1): 0, (11, 2): 1}
    with pytest.raises(ValueError):
        replace(retrieval.HYBRID, fusion="none")
    assert chunks.where(F.col("chunk") < 0).count() == 0
