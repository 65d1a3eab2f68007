"""The automaton against searching for each form, and bitmaps against counting."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.operators import bitmaps, conditions, dictionary


def by_search(text, forms, left_out=""):
    kept = [i for i, c in enumerate(text) if c not in left_out]
    bare = "".join(text[i] for i in kept)
    return sorted((kept[m.start()], kept[m.start() + len(f) - 1] + 1, f) for f in forms for m in re.finditer(f"(?={re.escape(f)})", bare))


@pytest.mark.parametrize(("alphabet", "lane"), [("ab", 512), ("abé漢", 7), ("a", 3), ("ab\U0001f600", 2)])
def test_automaton(monkeypatch, alphabet, lane):
    monkeypatch.setattr(dictionary, "LANE", lane)
    rng = random.Random(lane)
    for n in (1, 5, 60):
        forms = sorted({"".join(rng.choice(alphabet) for _ in range(rng.randint(1, 6))) for _ in range(n)})
        text = "".join(rng.choice(alphabet + "x") for _ in range(700))
        found = dictionary.Automaton(forms)
        end, form = found.find(dictionary.code_points(text))
        assert sorted((int(e - found.sizes[f]), int(e), forms[f]) for e, f in zip(end, form)) == by_search(text, forms)
    assert len(dictionary.Automaton([]).find(dictionary.code_points("abc"))[0]) == 0


def test_occurrences(spark, monkeypatch):
    monkeypatch.setattr(dictionary, "FORMS", 40)  # several blocks
    forms = ["he", "she", "his", "hers", "e h", "a.b", "\U0001f600x", "shehe", "ee" * 30, "", None, "he"]
    texts = [(1, "ushers and she he hers"), (2, None), (3, ""), (4, "he"), (4, "he"), (5, "a.b axb \U0001f600x\U0001f600x"), (6, "s" + "he" * 3000), (7, "end he"), (8, "r start")]
    df = spark.createDataFrame([(*t, 1) for t in texts], "k int, text string, form int").repartition(2)
    got = dictionary.occurrences(df, spark.createDataFrame([(f,) for f in forms], "form string"), "k")
    want = [(k, f, s, e, t[s - 1] if s else None, t[e] if e < len(t) else None) for k, t in texts if t for s, e, f in by_search(t, {f for f in forms if f})]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    loose = dictionary.occurrences(df, spark.createDataFrame([("hers",), ("ab",)], "form string"), "k", " .")
    assert {(r.k, r.form, r.start, r.end) for r in loose.collect()} >= {(1, "hers", 2, 6), (1, "hers", 18, 22), (5, "ab", 0, 3)}
    assert dictionary.occurrences(df, spark.createDataFrame([("",)], "form string"), "k").count() == 0


def test_leftmost_longest(spark):
    rng = random.Random(1)
    forms = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 4))) for _ in range(12)})
    texts = [(k, "".join(rng.choice("abx") for _ in range(80))) for k in range(20)]
    found = dictionary.occurrences(spark.createDataFrame(texts, "k int, text string"), spark.createDataFrame([(f,) for f in forms], "form string"), "k")
    got = dictionary.leftmost_longest(found, ["k"])
    pattern = re.compile("|".join(sorted(forms, key=lambda f: -len(f))))
    assert {(r.k, r.start, r.end) for r in got.collect()} == {(k, *m.span()) for k, t in texts for m in pattern.finditer(t)}


def test_many_names_do_not_grow_the_plan(spark):
    names = spark.range(100_000).select(F.concat(F.lit("name"), F.lpad(F.conv("id", 10, 26), 5, "0"), F.lit(".")).alias("form"))
    texts = spark.createDataFrame([(1, "name00000. name00010. nameZZZZZ. name0"), (2, "xname5LO9.x")], "k int, text string")
    found = dictionary.occurrences(texts, names, "k")
    known = {r.form for r in names.collect()}
    assert {(r.k, r.form) for r in found.collect()} == {(k, w) for k, w in ((1, "name00000."), (1, "name00010."), (2, "name5LO9.")) if w in known}
    assert len(found._jdf.queryExecution().optimizedPlan().toString()) < 5_000


def test_digits_of_counts():
    rng = np.random.default_rng(2)
    maps = rng.random((9, bitmaps.PLACES)) < 0.4
    digits = []
    for m in maps:
        bitmaps.added(digits, bitmaps.bitmap(np.flatnonzero(m).tolist(), None) if m[0] else bitmaps.bitmap(None, np.packbits(m, bitorder="little").tobytes()))
    total = maps.sum(0)
    for n in range(1, 12):
        assert bitmaps.places_of(bitmaps.with_count(digits, n)).tolist() == np.flatnonzero(total == n).tolist()


def test_bitmap_ranking(spark, monkeypatch):
    """Several containers and blocks, long and short lists, ties, missing scores."""
    monkeypatch.setattr(bitmaps, "MEANT", 300)
    monkeypatch.setattr(bitmaps, "ASKED", 9)
    monkeypatch.setattr(bitmaps, "LISTED", 20)
    rng = random.Random(8)
    rows = [(d, f, str(rng.randint(0, n))) for d in range(1000) for f, n in (("date", 3), ("a", 1), ("b", 40), ("c", 400)) for _ in range(rng.randint(0, 2))]
    index = spark.createDataFrame(sorted(set(rows)), "doc int, field string, value string").repartition(4)
    asked = [(q, f, str(rng.randint(0, n))) for q in range(12) for f, n in (("date", 3), ("a", 1), ("b", 40), ("c", 400)) for _ in range(2)] + [(q, "year_ref", "2") for q in range(0, 12, 3)]
    asked = spark.createDataFrame(asked + [(99, "zz", "none")], "query int, field string, value string")
    scores = spark.createDataFrame([(d, None if d % 7 == 0 else float(d % 5)) for d in range(900)], "doc int, score double")
    counts = conditions.match_counts(index, asked)
    want = conditions.ranked(counts.where("matches >= 2").join(scores, "doc", "left"), 15)
    got = conditions.top(index, asked, scores, 15)
    columns = ("query", "doc", "matches", "score", "rank")
    key = lambda df: sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    assert key(got) == key(want) and len(key(got)) > 150
    table = lambda df: sorted(map(tuple, df.select("query", "matches", "docs").collect()))
    assert table(conditions.count_table(index, asked)) == table(counts.groupBy("query", "matches").agg(F.count("*").alias("docs")))
    assert conditions.top(index.where("false"), asked, scores, 15).count() == 0


def test_conditions_meet_only_asked_rows(spark, monkeypatch):
    """Rows that no query asks for are not dealt, rows of the index may repeat, and counts of `least` fields are those of all counts."""
    monkeypatch.setattr(bitmaps, "MEANT", 100)
    rng = random.Random(4)
    rows = [(d, f, str(rng.randint(0, n))) for d in range(500) for f, n in (("a", 2), ("b", 9), ("c", 400))]
    index = spark.createDataFrame(rows + rows[:300], "doc int, field string, value string")
    asked = spark.createDataFrame([(q, f, str(q % 3)) for q in range(6) for f in "ab"], "query int, field string, value string")
    kept = conditions.asked_rows(index, conditions.probes(asked))
    assert {r.probe for r in kept.select("probe").distinct().collect()} == {"a", "b"} and kept.count() == sum(f in "ab" and int(v) < 3 for _, f, v in rows + rows[:300])
    counts = conditions.match_counts(index, asked)
    key = lambda df: sorted(map(tuple, df.select("query", "doc", "matches").collect()))
    assert key(conditions.matches(index, asked, 2)) == key(counts.where("matches >= 2"))
    want = counts.groupBy("query", "matches").agg(F.count("*").alias("docs"))
    assert sorted(map(tuple, conditions.count_table(index, asked).collect())) == sorted(map(tuple, want.collect()))
