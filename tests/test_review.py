"""Hand-computed cases of reviews."""

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import review


def test_columns(spark):
    df = spark.createDataFrame([([1, 3, None, 1, 9], ["a", "b", "c"])], "n array<int>, ids array<string>")
    r = df.select(review.to_ids(F.col("n"), F.col("ids")).alias("x"), review.last_rows(F.col("n"), 5, 2).alias("y")).first()
    assert r.x == ["a", "c", None, "a", None] and r.y == [1, 3]
    echo = spark.createDataFrame([([("a", "yes"), ("b", "no")],)], "r array<struct<item: string, label: string>>")
    ask = lambda *items: F.array(*map(F.lit, items))
    r = echo.select(review.valid_echo(F.col("r"), ask("a", "b"), ["yes", "no"]).alias("x"), review.valid_echo(F.col("r"), ask("b", "a"), ["yes", "no"]).alias("y"), review.valid_echo(F.col("r"), ask("a", "b"), ["yes"]).alias("z")).first()
    assert (r.x, r.y, r.z) == (True, False, False)


def test_rotation_and_comparison(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "q int, answer string")
    assert [r.answer for r in review.off_topic(df, "q").orderBy("q").collect()] == ["b", "c", "a"]
    base = spark.createDataFrame([(1, 0.5), (2, 0.5)], "q int, score double")
    cases = spark.createDataFrame([(1, "k", 0.4), (2, "k", 0.5)], "q int, kind string, score double")
    r = review.compared(cases, base, "q").first()
    assert (r.worse, r.same, r.better) == (1, 1, 0)


def test_blind_sample():
    rows = [(f"q{i}", f"m{i % 10}", i % 3) for i in range(40)]
    got = review.blind_sample(rows, 6, 0.5, 3)
    assert len(got) == 6 == len(set(got)) and got == review.blind_sample(rows, 6, 0.5, 3)
    clusters = {r[0]: r[1] for r in rows}
    assert len({clusters[g] for g in got}) == 6
    with pytest.raises(ValueError):
        review.blind_sample(rows, 11, 0.5, 3)


def test_ordered_work():
    tried = {}

    def work(x):
        tried[x] = tried.get(x, 0) + 1
        if x == 3 and tried[x] < 2:
            raise ValueError("later")
        return x * 10

    assert review.run_in_order([1, 2, 3, 4], work) == [10, 20, 30, 40] and tried == {1: 1, 2: 1, 3: 2, 4: 1}
    with pytest.raises(RuntimeError, match="always"):
        review.run_in_order([1], lambda x: (_ for _ in ()).throw(ValueError("always")))


def test_holdout():
    h = review.Holdout({"a"})
    h.check({"b"})
    with pytest.raises(PermissionError):
        h.check({"a"})
    h = review.Holdout({"a"}, allowed=True)
    h.check({"a"})
    with pytest.raises(PermissionError):
        h.check({"a", "b"})
