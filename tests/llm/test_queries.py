"""Queries on the small tables: SQL twins where there are, the pipeline's stages against their operators."""

import duckdb

import corpus_pipeline
from ledgerline.llm import common, registry
from .conftest import documents, prose


def test_topk_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf_dir}/embeddings.parquet'")
    want = con.execute(registry.oracles()["op1_topk"]).fetchall()
    got = registry.queries()["op1_topk"](spark, sf_dir).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_url_filters_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{sf_dir}/pages.parquet'")
    want = con.execute(registry.oracles()["op6_url_filters"]).fetchall()
    got = registry.queries()["op6_url_filters"](spark, sf_dir).select("page_id", "blocked", "n_active", "lists", "reason").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_language_of_held_out_rows(spark, sf_dir):
    out = registry.queries()["op2_langid"](spark, sf_dir).where("held_out").join(common.read(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    n, right = out.count(), out.where("lang = lang_pred").count()
    assert n and right / n > 0.98


def test_pipeline(spark, sf_dir):
    docs = common.read(spark, sf_dir, "documents")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.scratch(stage(spark, docs, sf_dir), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    kept = docs.count()
    assert 0 < kept < before
    assert corpus_pipeline.run(spark, sf_dir).count() == kept


def test_planted_cases(spark, sf_dir):
    """Copies, repeated passages and benchmark passages go, clean documents come through unchanged."""
    clean = [(k, prose(2000 + k, 150)) for k in range(30)]
    copies = [(100 + k, clean[k][1]) for k in range(5)]
    near = [(110 + k, clean[10 + k][1] + " one more") for k in range(5)]
    passage = prose(3000, 60)
    holders = [(200 + k, f"{prose(4000 + k, 60)} {passage} {prose(5000 + k, 60)}") for k in range(6)]
    items = [r.text for r in common.read(spark, sf_dir, "benchmark").orderBy("item_id").limit(3).collect()]
    leaks = [(300 + k, f"{prose(6000 + k, 60)} {t} {prose(7000 + k, 40)}") for k, t in enumerate(items)]
    docs = documents(spark, clean + copies + near + holders + leaks).select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.scratch(stage(spark, docs, sf_dir), name)
    kept = {r.doc_id: r.text for r in docs.collect()}
    assert {k: kept.get(k) for k, _ in clean} == dict(clean)
    assert set(kept) == {k for k, _ in clean + holders}
    words = set(passage.split())
    for k, t in holders:
        assert passage not in kept[k] and kept[k].split()[:59] == t.split()[:59]
        assert len([w for w in t.split() if w in words]) - len([w for w in kept[k].split() if w in words]) >= 58


def test_stages_take_odd_rows(spark, sf_dir, edge, nothing):
    for docs in (edge, nothing):
        for name, stage in corpus_pipeline.STAGES:
            docs = common.scratch(stage(spark, docs, sf_dir), name)
    odd = documents(spark, [(1, None), (2, "123 456"), (3, prose(1, 50))])
    assert [r.doc_id for r in corpus_pipeline.language_id(spark, odd, sf_dir).collect()] == [3]
