"""Exact BM25 top k without a row for each query and document: block maxima over postings dealt by document.

Documents are dealt to parts of some PART tokens, queries to blocks of some ASKED terms, and a part meets a
block in one group. There, postings of a term lie in the order of documents, cut into runs of SPAN documents
with the largest impact of each. A query adds up the maxima of its terms: no document of a run can score
more. Runs are scored from the highest bound down, until the next bound is below the score of the k-th
document that is known; the rest is never looked at. Each group gives the k best of its part for each of
its queries, so at most k rows for each query and part go on to the last ranking.

A group's size is bounded by the two constants (a document is not cut, and a query neither). Postings go
to the groups of those blocks alone that ask for their term.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tokens of a part of the documents at most (a document is not cut), and at least; rows (query, term) of a block of queries; documents of a run.
PART, LEAST, ASKED, SPAN = 2_000_000, 100_000, 200_000, 64
#: Runs that are scored at first; each further step takes twice as many.
FIRST = 4
#: Tasks for each core at least, where there are as many groups.
WAVES = 4
#: Scores are rounded to so many digits before they rank; a bound this near to the k-th score is still looked at.
DIGITS, NEAR = 6, 1e-6


class Part:
    """The postings of one part: documents by number, terms with their runs."""

    def __init__(self, docs: pa.ChunkedArray, terms: pa.ChunkedArray, impacts: np.ndarray, span: int):
        self.span = span
        known = docs.combine_chunks().dictionary_encode()
        order = np.asarray(pc.sort_indices(known.dictionary))
        self.docs = known.dictionary.take(pa.array(order))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        local = place[np.asarray(known.indices)]
        named = terms.combine_chunks().dictionary_encode()
        self.terms = {t: i for i, t in enumerate(named.dictionary.to_pylist())}
        term = np.asarray(named.indices).astype(np.int64)
        order = np.lexsort((local, term))
        term, local, impacts = term[order], local[order], impacts[order]
        # a document that has a term in several rows
        heads = np.flatnonzero(np.r_[True, (np.diff(term) != 0) | (np.diff(local) != 0)]) if len(term) else np.zeros(0, np.int64)
        self.impacts = np.add.reduceat(impacts, heads) if len(heads) else impacts
        term, local = term[heads], local[heads]
        run = self.at = local // span
        self.within = local - run * span
        starts = np.flatnonzero(np.r_[True, (np.diff(term) != 0) | (np.diff(run) != 0)]) if len(term) else np.zeros(0, np.int64)
        self.starts = np.r_[starts, len(term)]
        self.run = run[starts]
        self.most = np.maximum.reduceat(self.impacts, starts) if len(starts) else np.zeros(0)
        self.bounds = np.searchsorted(term[starts], np.arange(len(self.terms) + 1))
        self.runs = -(-len(self.docs) // span)

    def best(self, asked: list[tuple[str, float]], k: int) -> tuple[np.ndarray, np.ndarray, int, int]:
        """Documents and scores of the k best by score and place, and of how many runs with any term how many were scored."""
        found = [(self.bounds[i], self.bounds[i + 1], w) for t, w in asked if (i := self.terms.get(t)) is not None]
        # the runs of all terms of the query, one term after another
        of = np.concatenate([np.arange(a, b) for a, b, _ in found]) if found else np.zeros(0, np.int64)
        weight = np.repeat([w for _, _, w in found], [b - a for a, b, _ in found]) if found else np.zeros(0)
        run, start, size = self.run[of], self.starts[of], self.starts[of + 1] - self.starts[of]
        bound = np.bincount(run, weight * self.most[of], self.runs)
        order = np.argsort(-bound, kind="stable")[: np.count_nonzero(bound > 0)]
        docs, scores = np.zeros(0, np.int64), np.zeros(0)
        at, step, slot = 0, FIRST, np.full(self.runs, -1)
        while at < len(order) and not (len(docs) == k and bound[order[at]] + NEAR < scores[-1]):
            runs = order[at : at + step]
            at, step = at + len(runs), 2 * step
            slot[runs] = np.arange(len(runs))
            hit = np.flatnonzero(slot[run] >= 0)
            sizes = size[hit]
            rows = np.repeat(start[hit] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            total = np.bincount(slot[self.at[rows]] * self.span + self.within[rows], np.repeat(weight[hit], sizes) * self.impacts[rows], len(runs) * self.span)
            slot[runs] = -1
            each = np.flatnonzero(total > 0)
            docs = np.r_[docs, runs[each // self.span] * self.span + each % self.span]
            scores = np.r_[scores, np.round(total[each], DIGITS)]
            kept = np.lexsort((docs, -scores))[:k]
            docs, scores = docs[kept], scores[kept]
        kept = scores > 0
        return docs[kept], scores[kept], len(order), at


def partial(postings: DataFrame, queries: DataFrame, parts: int, k: int, n_terms: int) -> DataFrame:
    """postings (doc, term, impact), queries (query, term, weight), n_terms of them -> (query, doc, score, part, runs, scored).

    At most k rows for each query and part; runs and scored tell how much of the part was looked at.
    """
    kind = {c: df.schema[c].dataType.simpleString() for df, c in ((postings, "doc"), (queries, "query"))}
    blocks, span = max(1, -(-n_terms // ASKED)), SPAN
    asked = queries.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)))
    every = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("part", F.col("part").cast("bigint"))
    wanted = asked.select("term", F.col("block").alias("of")).distinct()
    dealt = postings.join(F.broadcast(wanted) if blocks == 1 else wanted, "term").select("doc", "term", "impact", F.pmod(F.xxhash64("doc"), F.lit(parts)).alias("part"), F.col("of").alias("block"))
    # the traversal is the work: a given number of tasks is not made smaller for few bytes
    spark = queries.sparkSession
    dealt = dealt.repartition(min(parts * blocks, max(int(spark.conf.get("spark.sql.shuffle.partitions")), WAVES * spark.sparkContext.defaultParallelism)), "part", "block")

    def traverse(left: pa.Table, right: pa.Table) -> pa.Table:
        part = Part(left.column("doc"), left.column("term"), left.column("impact").to_numpy(), span)
        number = left.column("part")[0].as_py() if left.num_rows else None
        right = right.sort_by("query")
        names, terms, weights = right.column("query").combine_chunks(), right.column("term").to_pylist(), right.column("weight").to_pylist()
        codes = np.asarray(names.dictionary_encode().indices)
        edges = np.flatnonzero(np.r_[True, np.diff(codes) != 0, True]) if len(codes) else [0]
        rows, docs, scores, runs, scored = [], [], [], [], []
        for a, b in zip(edges, edges[1:]):
            d, s, n, seen = part.best(list(zip(terms[a:b], weights[a:b])), k)
            rows.append(np.full(len(d), a))
            docs.append(d)
            scores.append(s)
            runs.append(np.full(len(d), n))
            scored.append(np.full(len(d), seen))
        joined = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, t)
        rows = joined(rows, np.int64)
        return pa.table(
            {
                "query": names.take(pa.array(rows)), "doc": part.docs.take(pa.array(joined(docs, np.int64))), "score": joined(scores, np.float64),
                "part": pa.array([number] * len(rows), pa.int64()), "runs": joined(runs, np.int64), "scored": joined(scored, np.int64),
            }
        )

    key = ("part", "block")
    return dealt.groupBy(*key).cogroup(every.groupBy(*key)).applyInArrow(traverse, f"query {kind['query']}, doc {kind['doc']}, score double, part bigint, runs bigint, scored bigint")
