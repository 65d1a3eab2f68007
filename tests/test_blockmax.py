"""Block maxima against the scores of all documents."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import blockmax, lexical


def corpus(spark, n=1500, seed=4):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    rows = [(i, " ".join(["common", *rng.choices(words, weights, k=rng.randint(1, 60))])) for i in range(n)]
    rows += [(2000 + i, rows[i % 7][1]) for i in range(90)]  # ties
    rows += [(3000, None), (3001, ""), (3002, "common " * 5000)]
    return lexical.documents(spark.createDataFrame(rows, "id bigint, text string").repartition(5), "id", F.coalesce("text", F.lit("")))


def queries(spark, seed=5, n=40):
    rng = random.Random(seed)
    rows = [(f"q{i:02}", " ".join(["common", *(f"w{min(int(rng.expovariate(0.02)), 320)}" for _ in range(rng.randint(1, 8)))])) for i in range(n)]
    rows += [("none", "absent"), ("rare", "w299 w298 w297"), ("twice", "w1 w1 w2 common common"), ("empty", "")]
    return lexical.query_terms(spark.createDataFrame(rows, "q string, text string"), "q", F.col("text"))


@pytest.mark.parametrize(("part", "asked", "span", "k"), [(2_000_000, 200_000, 64, 10), (4000, 60, 8, 10), (4000, 60, 3, 1), (9000, 1000, 16, 400)])
def test_same_as_all_scores(spark, monkeypatch, part, asked, span, k):
    monkeypatch.setattr(blockmax, "PART", part)
    monkeypatch.setattr(blockmax, "ASKED", asked)
    monkeypatch.setattr(blockmax, "SPAN", span)
    docs, terms = corpus(spark), queries(spark)
    found = lexical.index(docs)
    key = lambda df: sorted((r.query, r["rank"], r.doc, round(r.score, 5)) for r in df.collect())
    assert key(lexical.best(found, terms, k)) == key(lexical.top(lexical.search(found, terms), k))


def test_rows_that_go_on(spark, monkeypatch):
    monkeypatch.setattr(blockmax, "PART", 8000)
    monkeypatch.setattr(blockmax, "SPAN", 8)
    terms = queries(spark)
    rows = lexical.partial(lexical.index(corpus(spark)), terms, 5).collect()
    parts = {r.part for r in rows}
    assert len(parts) > 3 and len(rows) <= 5 * len(parts) * len({r.query for r in terms.collect()})
    assert all(r.scored <= r.runs for r in rows)
    seen = {(r.query, r.part): (r.scored, r.runs) for r in rows}
    assert sum(s for s, _ in seen.values()) < 0.8 * sum(n for _, n in seen.values())


def test_nothing_to_rank(spark):
    docs, terms = corpus(spark), queries(spark)
    assert lexical.best(lexical.index(docs), terms.where("false"), 5).count() == 0
    assert lexical.best(lexical.index(docs.where("false")), terms, 5).count() == 0


def test_a_document_in_several_rows(spark):
    """Rows of one id add up, as they do in the whole list."""
    docs = lexical.documents(spark.createDataFrame([("a", "x y"), ("a", "x x z"), ("b", "x"), ("é", "x")], "id string, text string"), "id", F.col("text"))
    terms = lexical.query_terms(spark.createDataFrame([(1, "x z")], "q int, text string"), "q", F.col("text"))
    found = lexical.index(docs)
    got, want = ({(r.doc, r["rank"]): round(r.score, 5) for r in df.collect()} for df in (lexical.best(found, terms, 9), lexical.top(lexical.search(found, terms), 9)))
    assert got == want and len(got) == 3


def test_texts_are_read_once(spark):
    """An index made for one run and its search: each text goes through the tokenizer once, and the traversal is dealt out."""
    seen = spark.sparkContext.accumulator(0)

    def words(text):
        seen.add(1)
        return text.split()

    rows = [(i, f"common w{i % 7} w{i % 11} w{i % 7}") for i in range(300)]
    docs = lexical.documents(spark.createDataFrame(rows, "id bigint, text string").repartition(3), "id", F.col("text"), F.udf(words, "array<string>").asNondeterministic())
    terms = lexical.query_terms(spark.createDataFrame([(1, "common w3 w5"), (2, "w10")], "q int, text string"), "q", F.col("text"))
    found = lexical.index(docs, terms.select("term").distinct())
    got = lexical.best(found, terms, 5).collect()
    assert len(got) == 10 and seen.value == len(rows)
    want = lexical.top(lexical.search(lexical.Index(found.postings, found.terms, found.corpus), terms), 5)
    assert sorted((r.query, r["rank"], r.doc) for r in got) == sorted((r.query, r["rank"], r.doc) for r in want.collect())
    assert {r.term for r in found.postings.select("term").distinct().collect()} == {"common", "w3", "w5", "w10"}
