"""A growing index against one that is built of the living documents alone."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import lexical, segments

SETTINGS = {"k1": lexical.K1, "b": lexical.B, "tokenizer": "words"}


def docs(spark, texts):
    return lexical.documents(spark.createDataFrame(sorted(texts.items()), "id bigint, text string").repartition(2), "id", F.coalesce("text", F.lit("")))


def ranking(index, asked):
    return sorted((r.query, r["rank"], r.doc, round(r.score, 5)) for r in lexical.best(index, asked, 7).collect())


def test_add_delete_replace(spark, tmp_path):
    rng = random.Random(5)
    said = lambda: " ".join(rng.choice("abcdefgh") * rng.randint(1, 2) for _ in range(rng.randint(0, 12)))
    asked = lexical.query_terms(spark.createDataFrame([(1, "a bb c"), (2, "h h dd"), (3, "zz")], "q int, text string"), "q", F.col("text"))
    folder = str(tmp_path / "index")
    at = segments.create(spark, folder, SETTINGS)
    first = {i: said() for i in range(30)} | {90: "", 91: "zz only once"}
    at = at.add(docs(spark, first))
    early = at
    changed = {i: said() for i in range(20, 40)}
    at = at.add(docs(spark, changed))  # ten of them replace
    at = at.delete(spark.createDataFrame([(3,), (91,), (25,), (777,)], "doc bigint"))
    living = {i: t for i, t in (first | changed).items() if i not in (3, 91, 25)}
    whole = ranking(lexical.index(docs(spark, living)), asked)
    assert ranking(at.index(), asked) == whole and whole
    found, built = at.index(), lexical.index(docs(spark, living))
    assert {(r.term, r.df) for r in found.terms.collect()} == {(r.term, r.df) for r in built.terms.collect()}
    assert tuple(found.corpus.first()) == pytest.approx(tuple(built.corpus.first()))
    # a reader of an older snapshot keeps it; the latest one opens as it is
    assert ranking(early.index(), asked) == ranking(lexical.index(docs(spark, first)), asked)
    again = segments.open_snapshot(spark, folder, SETTINGS)
    assert (again.number, again.segments, again.deletions) == (at.number, at.segments, at.deletions)
    small = at.compact()
    assert len(small.segments) == 1 and not small.deletions and ranking(small.index(), asked) == whole
    assert small.compact() is small
    assert set(segments.removable(spark, folder, SETTINGS, small.number)) == {*at.segments, *at.deletions}
    assert segments.removable(spark, folder, SETTINGS, 0) == []


def test_guards(spark, tmp_path):
    folder = str(tmp_path / "index")
    at = segments.create(spark, folder, SETTINGS)
    with pytest.raises(segments.Conflict):
        segments.create(spark, folder, SETTINGS)
    assert at.delete(spark.createDataFrame([(1,)], "doc bigint")) is at
    assert at.add(docs(spark, {1: "x"}).where("false")) is at
    with pytest.raises(ValueError):
        at.index()
    with pytest.raises(ValueError):
        at.add(docs(spark, {1: "x"}).withColumn("doc", F.lit(None).cast("bigint")))
    one = at.add(docs(spark, {1: "x"}))
    with pytest.raises(segments.Conflict):  # two changes of one state: the second has to be taken again
        at.add(docs(spark, {2: "y"}))
    assert [r.doc for r in one.living("docs").collect()] == [1]
    with pytest.raises(ValueError):
        segments.open_snapshot(spark, folder, SETTINGS | {"b": 0.1})
    none = one.delete(spark.createDataFrame([(1,)], "doc bigint"))
    asked = lexical.query_terms(spark.createDataFrame([(1, "x")], "q int, text string"), "q", F.col("text"))
    assert lexical.best(none.index(), asked, 3).count() == 0
