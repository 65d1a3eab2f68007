import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, h bigint, g string, c int, f0 string, block string, class int, found_at int, score string, lang_pred int, n int, at string, key string, q int, spans int, component_id string, _h string, _lang int, _score string, _spans int, _named int, _gone_id int, _row string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    out = []
    for i in range(n):
        out.append(rng.choice(WORDS) + str(rng.randint(0, 99)) + ("." if i % 9 == 8 else ""))
    return " ".join(out)


def documents(spark, texts, langs=None):
    """Rows with clashing extra columns; texts: (doc_id, text)."""
    rows = [(i, t, (langs or {}).get(i, "en"), "s", None if t is None else len(t), 1, "g", 2, "f", "b", 3, 4, "s", 5, 6, "at", "key", 7, 8, "x", "h", 9, "s", 10, 11, 12, "r") for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


EDGE = [
    (1, None), (2, ""), (3, "   \n "), (4, "word"), (5, prose(1, 300)), (6, prose(1, 300)), (6, prose(1, 300)), (None, prose(2, 80)),
    (8, prose(3, 9000)), (9, "é ß 漢字 😀 !!"), (10, "aaaa" * 400), (11, "the same " * 300), (12, prose(4, 120)), (13, "<|endoftext|> x's"), (None, None),
]


@pytest.fixture(scope="session")
def edge(spark):
    return documents(spark, EDGE)


@pytest.fixture(scope="session")
def nothing(edge):
    return edge.where("false")
