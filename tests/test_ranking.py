"""Hand-computed cases of ranking, fusion and metrics."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import dense, fusion, lexical, metrics
from ledgerline.plans import retrieval


def lists(spark, *named, scores=None):
    rows = [(0, i, r + 1, d, float((scores or {}).get(d, 1.0 / (r + 1)))) for i, docs in enumerate(named) for r, d in enumerate(docs)]
    return spark.createDataFrame(rows, "query int, list_no int, rank int, doc string, score double")


def order(df, rank="rank"):
    return [r.doc for r in df.orderBy(rank).collect()]


def scored(spark, rows):
    return spark.createDataFrame([(0, i, d, float(s)) for i, (d, s) in enumerate(rows)], "query int, chunk int, doc string, score double")


def test_document_scores(spark):
    s = scored(spark, [("x", 3.5), ("y", 4.25), ("x", 1.0), ("z", 4.25), ("y", 0.5), ("x", 6.0)])
    assert order(dense.top(dense.doc_max(s), 9, "doc")) == ["x", "y", "z"]
    assert order(dense.top(dense.doc_max(s), 1, "doc")) == ["x"]
    weighted = lambda w: {r.doc: r.score for r in dense.doc_weighted(s, w).collect()}
    assert weighted([1.0, 2.0, 3.0]) == {"x": 16.0, "y": 5.25, "z": 4.25}
    assert weighted([0.0, 1.0]) == {"x": 3.5, "y": 0.5, "z": 0.0}
    assert weighted([1.0]) == {r.doc: r.score for r in dense.doc_max(s).collect()}
    assert dense.best_chunks(s).where("doc = 'x'").first().chunk == 5


def test_equal_chunks_have_the_lowest_number(spark):
    found = dense.best_chunks(scored(spark, [("m", 0.25), ("n", 0.5), ("m", 0.25), ("n", 0.5)])).collect()
    assert {r.doc: r.chunk for r in found} == {"m": 0, "n": 1}


@pytest.mark.parametrize(("weights", "cells", "passes"), [(None, 1 << 21, 1 << 14), ((1.0,), 40, 1 << 14), ((1.0, 0.5, 0.25), 1 << 21, 3)])
def test_search_equals_all_pairs(spark, monkeypatch, weights, cells, passes):
    """Ties, copies, vectors of other lengths, a document of many chunks, small products and several passes."""
    monkeypatch.setattr(dense, "CELLS", cells)
    monkeypatch.setattr(dense, "PASS", passes)
    rng = random.Random(6)
    vectors = [[rng.randint(-2, 2) / 2 for _ in range(4)] for _ in range(150)]
    rows = [(i, 3 if 40 <= i < 110 else i // 4 + 100, vectors[i % 90]) for i in range(150)] + [(500, 900, [1.0, 2.0]), (501, 900, [0.5, 1.0]), (502, 901, [2.0, 2.0])]
    every = spark.createDataFrame(rows, "chunk bigint, doc bigint, v array<double>")
    asked = every.where("chunk % 20 = 0").select(F.col("chunk").alias("query"), F.col("v").alias("qv"))
    want = {}
    for q, _, qv in rows:
        if q % 20 == 0:
            best = {}
            for c, d, v in rows:
                if c != q and len(v) == len(qv):
                    best.setdefault(c if weights is None else d, []).append(round(sum(x * y for x, y in zip(v, qv)), 6))
            total = {k: sum(w * s for w, s in zip(weights or (1.0,), sorted(found, reverse=True))) for k, found in best.items()}
            want |= {(q, r + 1): (k, total[k]) for r, k in enumerate(sorted(total, key=lambda k: (-total[k], k))[:7])}
    got = dense.search(every.repartition(3), asked, 7, weights).collect()
    assert {(r.query, r["rank"]): (r[1], r.score) for r in got} == want
    assert dense.search(every.where("false"), asked, 7, weights).count() == 0 == dense.search(every, asked.where("false"), 7, weights).count()


def test_saved_index(spark, tmp_path):
    texts = [(0, "red fish blue fish"), (1, "one fish"), (2, ""), (3, "blue sky, blue sea"), (4, None)]
    docs = lexical.documents(spark.createDataFrame(texts, "id int, text string"), "id", F.col("text")).where("tokens is not null")
    asked = lexical.query_terms(spark.createDataFrame([(7, "Blue fish fish"), (8, "none")], "q int, text string"), "q", F.col("text"))
    settings = {"k1": lexical.K1, "b": lexical.B, "tokenizer": "words"}
    folder = str(tmp_path / "index")
    lexical.save_index(docs, folder, settings)
    found = lexical.open_index(spark, folder, settings, docs.count())
    key = lambda df: sorted((r.query, r.doc, r.score) for r in df.collect())
    assert key(lexical.search(found, asked)) == key(lexical.scores(docs, asked)) and len(key(lexical.search(found, asked))) == 3
    with pytest.raises(ValueError, match="settings|made by"):
        lexical.open_index(spark, folder, settings | {"b": 0.5})
    with pytest.raises(ValueError, match="documents"):
        lexical.open_index(spark, folder, settings, 9)
    letters = lexical.documents(spark.createDataFrame(texts[:2], "id int, text string"), "id", F.col("text"), lambda t: F.split(t, ""))
    assert letters.where("id = 1" if "id" in letters.columns else "doc = 1").first().dl == 8


def test_rrf(spark):
    assert order(fusion.rrf(lists(spark, ["p", "q", "r"], ["r", "p"]), 10)) == ["p", "r", "q"]
    assert order(fusion.rrf(lists(spark, ["p", "q"], ["s", "t"]))) == ["p", "s", "q", "t"]  # ties by list
    assert order(fusion.rrf(lists(spark, ["p", "q"], ["s", "t"]), 1, [1.0, 3.0])) == ["s", "t", "p", "q"]


def test_minmax(spark):
    got = fusion.minmax(lists(spark, ["u", "v", "w", "x"], scores={"u": 12.0, "v": 9.0, "w": 6.0, "x": 4.0})).orderBy("rank").collect()
    assert [round(r.score, 9) for r in got] == [1.0, 0.625, 0.25, 0.0]
    assert {r.score for r in fusion.minmax(lists(spark, ["u"], scores={"u": 3.0})).collect()} == {0.0}


def test_matched_first(spark):
    df = lists(spark, ["m", "n", "o", "p", "q"])
    assert order(fusion.matched_first(df, F.col("doc").isin("q", "n")), "new_rank") == ["n", "q", "m", "o", "p"]
    assert order(fusion.matched_first(df, F.lit(False)), "new_rank") == ["m", "n", "o", "p", "q"]


def test_rerank_head(spark):
    df = lists(spark, ["m", "n", "o", "p", "q"])
    second = F.when(F.col("doc") == "n", 2.0).when(F.col("doc") == "p", 7.0).otherwise(1.0)
    assert order(fusion.rerank_head(df, second, 2), "new_rank") == ["n", "m", "o", "p", "q"]
    assert order(fusion.rerank_head(df, second, 4), "new_rank") == ["p", "n", "m", "o", "q"]


def test_append_missing(spark):
    more = spark.createDataFrame([(0, "b", 1), (0, "z", 2)], "query int, doc string, rank int")
    assert order(fusion.append_missing(lists(spark, ["a", "b"]), more)) == ["a", "b", "z"]


def test_slots(spark):
    df = spark.createDataFrame([(["a", "b", "c", "d"],)], "docs array<string>")
    row = df.select(
        fusion.swap_gold(F.col("docs"), F.lit("d"), 3).alias("swap"), fusion.swap_gold(F.col("docs"), F.lit("b"), 3).alias("none"),
        fusion.drop_gold(F.col("docs"), F.lit("b"), 3).alias("drop"), fusion.reuse(F.col("docs"), F.array(F.lit("x"), F.lit("a")), 4).alias("reuse"),
    ).first()
    assert (row.swap, row.none, row.drop, row.reuse) == (["a", "b", "d"], None, ["a", "c", "d"], ["a", "b", "c", "x"])


def test_recall_and_mrr(spark):
    ranks = spark.createDataFrame([(0, 2), (1, 10), (2, 11), (3, None), (4, 5)], "query int, rank int")
    rows = {r.query: r for r in metrics.per_query(ranks).collect()}
    assert [[int(rows[q][f"recall_{k}"]) for k in (1, 5, 10)] for q in range(5)] == [[0, 1, 1], [0, 0, 1], [0, 0, 0], [0, 0, 0], [0, 1, 1]]
    assert [round(rows[q].mrr_10, 6) for q in range(5)] == [0.5, 0.1, 0.0, 0.0, 0.2]


def test_duplicates_before_rank(spark):
    run = spark.createDataFrame([(0, 1, "s"), (0, 2, "t"), (0, 3, "s"), (0, 4, "u"), (0, 5, "t")], "query int, rank int, doc string")
    assert {r.doc: r.rank for r in metrics.distinct_ranks(run).collect()} == {"s": 1, "t": 2, "u": 3}


def test_set_metrics(spark):
    df = spark.createDataFrame([(0, list("pqrstuvw"), ["r", "q", "w", "z"])], "query int, docs array<string>, gold array<string>")
    r = metrics.set_metrics(df).first()
    assert (r.recall_5, r.complete_5, r.hit_5, r.recall_10, r.complete_10) == (0.5, 0.0, 1.0, 0.75, 0.0)


def test_bootstrap_is_seeded_and_clustered(spark):
    rows = [(f"c{i % 7}", float(i % 3)) for i in range(50)]
    clusters = metrics.cluster_sums(spark.createDataFrame(rows, "cluster string, diff double"))
    a, b = metrics.bootstrap(clusters, 500), metrics.bootstrap(clusters, 500)
    assert a == b and a[1] <= a[0] <= a[2]


@pytest.mark.parametrize(("ci", "want"), [((0.02, 0.01, 0.03), "adopt"), ((0.005, 0.001, 0.01), "hold"), ((-0.1, -0.2, -0.01), "reject"), ((0.02, -0.01, 0.05), "hold")])
def test_verdict(ci, want):
    assert metrics.verdict(*ci) == want


def test_other_verdicts():
    assert metrics.metadata_verdict("adopt", (0, 0, 0), 0) == ("adopt", "single")
    assert metrics.metadata_verdict("hold", (0.05, 0.01, 0.1), -0.1) == ("hold", "multi")
    assert metrics.metadata_verdict("hold", (0.05, 0.01, 0.1), 0.1) == ("adopt", "multi")
    assert metrics.answer_verdict((0.05, 0.01, 0.1), [True, True]) == "adopt"
    assert metrics.answer_verdict((0.05, 0.01, 0.1), [True, False]) == "hold"
    assert metrics.answer_verdict((-0.05, -0.1, -0.01), [True]) == "reject"


def test_top_equals_full_sort(spark):
    rng = random.Random(1)
    rows = [(q, d, round(rng.random(), 2)) for q in range(5) for d in range(60)]
    df = spark.createDataFrame(rows, "query int, doc int, score double")
    got = {(r.query, r["rank"]): r.doc for r in lexical.top(df, 10).collect()}
    for q in range(5):
        want = sorted((x for x in rows if x[0] == q), key=lambda x: (-x[2], x[1]))[:10]
        assert [got[q, i + 1] for i in range(10)] == [x[1] for x in want]


def test_partitions_do_not_matter(spark):
    rows = [(0, i, i % 4, f"d{i % 9}", i / 7) for i in range(1, 40)]
    df = spark.createDataFrame(rows, "query int, list_no int, rank int, doc string, score double").dropDuplicates(["list_no", "doc"])
    assert order(fusion.rrf(df.repartition(1))) == order(fusion.rrf(df.repartition(7)))


def test_presets():
    assert {"dense", "hybrid", "reranked"} <= set(retrieval.PRESETS)
    with pytest.raises(ValueError):
        retrieval.Config(conditions=True, fuse_conditions=False)
    with pytest.raises(ValueError):
        retrieval.Config(fusion="other")


def test_reranked_and_filtered(spark):
    """Reranking the head comes before the filter, and the filter keeps its order."""
    dense_docs = spark.createDataFrame([(0, d, 5.0 - i) for i, d in enumerate("klmn")], "query int, doc string, score double")
    second = spark.createDataFrame([(0, "k", 1.0), (0, "l", 3.0), (0, "m", 2.0)], "query int, doc string, second double")
    matches = spark.createDataFrame([(0, "n", 3), (0, "k", 3), (0, "l", 1)], "query int, doc string, matches int")
    config = retrieval.Config(conditions=True, best_filter=True, rerank_depth=3, weights=(1.0, 1.0, 0.0))
    assert order(retrieval.retrieve(config, dense_docs, dense_docs, matches, second)) == ["k", "n", "l", "m"]
