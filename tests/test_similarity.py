"""Bit-parallel similarity against the quadratic table."""

import difflib
import difflib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.operators import answers, conversations, similarity


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            row[j], last = max(row[j], row[j - 1]) if x != y else last + 1, row[j]
    return row[-1]


def ratio(a, b):
    return 2 * common(a, b) / (len(a) + len(b)) if a or b else 1.0


@pytest.mark.parametrize(("alphabet", "longest"), [("ab", 40), ("abcdefgh \U0001f600é", 150), ("ab", 300), ("a", 129)])
def test_common_lengths(monkeypatch, alphabet, longest):
    rng = random.Random(longest)
    word = lambda: "".join(rng.choice(alphabet) for _ in range(rng.choice((0, 1, 5, 63, 64, 65, rng.randint(0, longest)))))
    a, b = [word() for _ in range(40)], [word() for _ in range(40)]
    want = [common(x, y) for x, y in zip(a, b)]
    assert similarity.common_lengths(a, b).tolist() == want
    monkeypatch.setattr(similarity, "HELD", 50)
    assert similarity.common_lengths(a, b).tolist() == want
    assert np.allclose(similarity.ratios(a, b), [ratio(x, y) for x, y in zip(a, b)])
    some = similarity.ratios(a, b, 0.6)
    assert all(s == r if r >= 0.6 else s in (0.0, r) for s, r in zip(some, similarity.ratios(a, b)))
    assert all(similarity.shared_bound(x, y) >= n for x, y, n in zip(a, b, want))


def best_window(a, b):
    a, b = sorted((a, b), key=len)
    if not a:
        return 0.0 if b else 100.0
    spans = [(max(i, 0), min(i + len(a), len(b))) for i in range(1 - len(a), len(b))]
    found = [ratio(a, b[i:j]) for i, j in spans]
    if len(a) == len(b):
        found += [ratio(b, a[i:j]) for i, j in spans]
    return 100 * max(found)


def test_partial_ratio():
    rng = random.Random(11)
    for alphabet, n in (("ab", 12), ("abcdefghij", 30), ("abc ", 70), ("abé漢", 20)):
        for _ in range(12):
            a, b = ("".join(rng.choice(alphabet) for _ in range(rng.randint(0, n * k))) for k in (1, 3))
            assert similarity.partial_ratio(a, b) == pytest.approx(best_window(a, b)), (a, b)
            assert similarity.partial_ratio(a, b) == similarity.partial_ratio(b, a)
    assert similarity.partial_ratio("abc", "xxabcxx") == 100.0


def test_quote_candidates_by_rule():
    rng = random.Random(2)
    parts = [" ".join(rng.choice(["rain", "fell", "late", "sun", "came", "up"]) for _ in range(6)) + "." for _ in range(12)]
    for quote in ("rain came up late", "sun sun fell", parts[4][:20]):
        windows = [" ".join(parts[i : i + 3]) for i in range(10)]
        want = sorted(range(10), key=lambda i: (-best_window(quote, windows[i]), i))[:3]
        assert answers.quote_candidates(quote, parts) == [windows[i] for i in want]


def test_repetition(spark):
    """The matched characters of the sequence matcher are common ones, so a pair that the bound leaves out is no repetition."""
    rng = random.Random(6)
    base = "the quick brown fox jumps over the lazy dog and runs far away"
    texts = [base, base + " again", base[:30], "entirely different words here", "", base[::-1], base, None, "x" * 300, "x" * 300 + base]
    rows = [(c, t, "assistant", texts[rng.randrange(len(texts))]) for c in range(12) for t in range(8)] + [(99, 1, "user", base)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(3)
    want = {}
    for c in range(12):
        said = [(t, x) for cc, t, r, x in rows if cc == c and x is not None]
        for (_, a), (t, b) in zip(said, said[1:]):
            want[c, t] = (round(difflib.SequenceMatcher(None, a, b, autojunk=False).ratio(), 6), round(ratio(a, b), 6))
    got = {(r.conv_id, r.turn): (r.ratio, r.alike) for r in conversations.repetition(df).collect()}
    assert got == want
    repeats = {(r.conv_id, r.turn): r.repeat for r in conversations.repeats(df, 0.6).collect()}
    assert repeats == {k: r >= 0.6 for k, (r, _) in want.items()}
    assert conversations.repetition(df.where("false")).count() == 0


def test_sequence_ratio_is_difflibs():
    rng = random.Random(7)
    for n in range(300):
        letters = "abcdefghijklmnopqrstuvwxyz "[: rng.choice((1, 2, 4, 27))]
        a, b = ("".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in "ab")
        if n % 2:
            b = b[:20] + a[5:40] + b[20:]
        assert conversations.ratio(a, b) == difflib.SequenceMatcher(None, a, b, autojunk=False).ratio(), (a, b)


def test_pairs_of_one_conversation_are_many_tasks(spark):
    rows = [(1, i, "assistant", "abc " * (i % 5)) for i in range(200)]
    pairs = conversations.repetition(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    assert pairs.select(F.spark_partition_id()).distinct().count() > 4
    assert pairs.count() == 199


def test_lanes_and_single_pairs_agree(monkeypatch):
    rng = random.Random(3)
    a, b = (["".join(rng.choice("abc") for _ in range(rng.randrange(200))) for _ in range(60)] for _ in "ab")
    alone = similarity.common_lengths(a, b)
    monkeypatch.setattr(similarity, "LANES", 0)
    assert similarity.common_lengths(a, b).tolist() == alone.tolist() == [common(x, y) for x, y in zip(a, b)]
