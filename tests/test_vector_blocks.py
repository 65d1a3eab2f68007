"""Vector search through blocks and in passes against the plain search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.operators import dense, vector_blocks
from ledgerline.sources.scratch import scratch

KIND = "chunk bigint, doc bigint, v array<double>"


def clustered(spark, n=1200, dim=6, seed=3, per_doc=4):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(15, dim)) * 5
    x = np.round(centers[rng.integers(0, 15, n)] + rng.normal(size=(n, dim)) * 0.3, 2)
    x[40:60] = x[40]  # ties
    return spark.createDataFrame([(i, i // per_doc, [float(y) for y in v]) for i, v in enumerate(x)], KIND).repartition(4)


def asked(chunks, step=37):
    return chunks.where(F.col("chunk") % step == 0).select(F.col("chunk").alias("query"), F.col("v").alias("qv"))


def rows(df):
    return sorted((r.query, r["rank"], r.doc, r.score) for r in df.collect())


@pytest.mark.parametrize(("block", "pool", "k", "pass_"), [(32, 2, 5, 1 << 13), (64, 1, 40, 20), (5000, 4, 5, 1 << 13)])
def test_blocks(spark, monkeypatch, block, pool, k, pass_):
    monkeypatch.setattr(vector_blocks, "PASS", pass_)
    chunks = clustered(spark)
    index = scratch(vector_blocks.build(chunks, block), "index")
    assert index.agg(F.sum("n")).first()[0] == 1200
    found, counts = vector_blocks.search(index, asked(chunks), k, pool)
    assert rows(found) == rows(dense.search(chunks, asked(chunks), k, (1.0,)))
    if block < 100:
        assert counts["scored"] < 0.6 * counts["pairs"]
    else:
        assert counts["scored"] <= counts["pairs"]


def test_fewer_documents_than_wanted(spark):
    chunks = clustered(spark, 60, per_doc=20)
    index = scratch(vector_blocks.build(chunks, 8), "index")
    found, _ = vector_blocks.search(index, asked(chunks, 20), 10, 1)
    assert rows(found) == rows(dense.search(chunks, asked(chunks, 20), 10, (1.0,))) and len(rows(found)) == 9
    assert vector_blocks.search(index, asked(chunks).where("false"), 3)[0].count() == 0


def test_refused(spark):
    for v in (None, [1.0]):
        with pytest.raises(ValueError):
            vector_blocks.build(spark.createDataFrame([(1, 1, [1.0, 2.0]), (2, 1, v)], KIND))
    empty = scratch(vector_blocks.build(spark.createDataFrame([], KIND)), "index")
    assert vector_blocks.search(empty, spark.createDataFrame([(1, [1.0])], "query bigint, qv array<double>"), 3)[0].count() == 0


@pytest.mark.parametrize("weights", [None, (1.0, 0.1)])
def test_passes_hold_one_broadcast(spark, monkeypatch, weights):
    chunks = clustered(spark, 300)
    queries = chunks.where("chunk % 2 = 0").select(F.col("chunk").alias("query"), F.col("v").alias("qv"))
    name = "chunk" if weights is None else "doc"
    key = lambda df: sorted((r.query, r["rank"], r[name], r.score) for r in df.collect())
    want = key(dense.search(chunks, queries, 5, weights))
    live, most, made = [], [], spark.sparkContext.broadcast

    class Counted:
        def __init__(self, sent):
            self.sent = sent
            live.append(self)
            most.append(len(live))

        @property
        def value(self):
            return self.sent.value

        def destroy(self):
            live.remove(self)
            self.sent.destroy()

    def counted(value):
        return Sent(made(value))

    class Sent(Counted):
        def __reduce__(self):
            return self.sent.__reduce__()

    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda _, value: counted(value))
    monkeypatch.setattr(dense, "PASS", 10)
    got = key(dense.search(chunks, queries, 5, weights))
    assert got == want and len(most) >= 25 and max(most) == 1 and not live
