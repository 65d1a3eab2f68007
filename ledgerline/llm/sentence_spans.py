"""Substring dedup by sliding sentence spans.

A text is cut into sentences (after . ! ? and white space, and at line ends). A sentence of more than
WORDS words counts as several: it is cut where the words themselves say so, after the word of the smallest
hash among NEAR words on either side, so a passage has the same pieces wherever in a sentence it
begins; what is left longer than WORDS words is cut after the smallest hash within reach. Every run of SPAN consecutive sentences is hashed (128 bits over the sentences with case and
white space made equal), runs are counted over all documents, and sentences covered by an occurrence
of a repeated run that is not its first are removed. The first occurrence is the one with the smallest
(doc_id, text hash, position). A document with fewer sentences has no runs.

Counting is a partial aggregate before its shuffle; the occurrences of repeated runs follow by an
equi-join, which adaptive execution may split, so a run that a third of all documents share is no
single task's burden. Texts meet the positions to remove in one more join by document.

Null and empty texts have no sentences. Rows with the same doc_id and text are one document and have
one result each. Null doc_ids are allowed and come first. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Sentences of a run, and words after which a long sentence is cut.
SPAN, WORDS = 3, 16
#: Words on either side of a word that decide whether a long sentence is cut after it.
NEAR = 4
ENDS = re.compile(r"(?<=[.!?])\s+|\s*\n\s*")


def every(words: list[str]) -> list[int]:
    """Cuts after every WORDS words."""
    return list(range(WORDS, len(words), WORDS))


def one_word(h: list[int]) -> bool:
    """More than NEAR words, all the same."""
    return len(h) > NEAR and h.count(h[0]) == len(h)


def by_content(words: list[str]) -> list[int]:
    """Cuts after words whose hash is the smallest (the first of equal ones) among NEAR words on either side.

    Where these leave more than WORDS words (repeated words), cuts at the ends of runs of one word, and
    else after the smallest hash, the last of equal ones, that gives more than NEAR and at most WORDS words.
    """
    h = [xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words]
    cuts, at, last = [], NEAR, len(h) - NEAR
    while at < last:
        around = h[at - NEAR : at + NEAR + 1]
        least = at - NEAR + around.index(min(around))
        if least == at:
            cuts.append(at + 1)
        at = least if least > at else least + NEAR + 1
    out, start = [], 0
    for end in [*cuts, len(h)]:
        while end - start > WORDS:
            stop = min(start + WORDS, end - 1)
            reach = h[start + NEAR : stop]
            ends = (i for i in range(start + 1, stop + 1) if h[i - 1] != h[i] and (one_word(h[i : i + NEAR + 1]) or one_word(h[max(i - NEAR - 1, start) : i])))
            start = next(ends, stop - reach[::-1].index(min(reach)))
            out.append(start)
        if end < len(h):
            out.append(end)
        start = end
    return out


def sentences(text: str | None, cuts: Callable[[list[str]], list[int]] = every) -> list[str]:
    """The sentences of a text, long ones in pieces; all of its words in order."""
    out = []
    for s in ENDS.split(text or ""):
        if not s:
            continue
        if len(s) < 2 * WORDS:  # too short for more words
            if s := s.strip():
                out.append(s)
            continue
        words = s.split()
        if len(words) <= WORDS:
            out.append(" ".join(words))
        else:
            at = [0, *cuts(s.lower().split()), len(words)]
            out += [" ".join(words[i:j]) for i, j in zip(at, at[1:])]
    return out


def pieces(text: str | None) -> list[str]:
    """The sentences of a text, long ones cut by their content."""
    return sentences(text, by_content)


def run_hashes(found: list[str], span: int) -> np.ndarray:
    """[runs, 2]: 128 bits for each run."""
    n = len(found) - span + 1
    if n < 1:
        return np.zeros((0, 2), np.uint64)
    digest = xxhash.xxh3_128_digest
    each = np.frombuffer(b"".join(digest(" ".join(s.lower().split()).encode("utf-8", "surrogatepass")) for s in found), np.uint64).reshape(-1, 2)
    h = np.zeros((n, 2), np.uint64)
    for i in range(span):
        h = common.mix64(h * np.uint64(0x9E3779B97F4A7C15) + each[i : i + n])
    return h


def removals(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """(doc_id, h, at): starts of runs to remove, an array for each document that has any."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.in_bounds(batches):
            found = [run_hashes(pieces(t), span) for t in b.column("text").to_pylist()]
            counts = np.array([len(f) for f in found])
            rows = pa.array(np.repeat(np.arange(len(found)), counts))
            runs = np.concatenate(found).view(np.int64)
            at = np.concatenate([np.arange(c, dtype=np.int32) for c in counts])
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(rows), b.column("h").take(rows), pa.array(at), pa.array(runs[:, 0].copy()), pa.array(runs[:, 1].copy())], names=["doc_id", "h", "at", "a", "b"])

    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    runs = keyed.mapInArrow(hashed, "doc_id bigint, h bigint, at int, a bigint, b bigint")
    occurrence = F.struct("doc_id", "h", "at")
    repeated = runs.groupBy("a", "b").agg(F.min(occurrence).alias("first"), F.max(occurrence).alias("last")).where("first <> last")
    # read back, the join below is plain and its large partitions can be split
    repeated = common.scratch(repeated.select("a", "b", "first"), "runs")
    others = runs.join(repeated, ["a", "b"]).where(~F.col("first").eqNullSafe(occurrence))
    return others.groupBy("doc_id", "h").agg(F.collect_set("at").alias("at"))


def _with_removals(docs: DataFrame, span: int, how: str) -> DataFrame:
    found = removals(docs, span).withColumnsRenamed({"doc_id": "found_id", "h": "found_h", "at": "found_at"})
    keyed = docs.withColumn("h", F.xxhash64("text"))
    return keyed.join(found, keyed.h.eqNullSafe(found.found_h) & keyed.doc_id.eqNullSafe(found.found_id), how)


def kept(found: list[str], starts, span: int) -> tuple[list[str], int, int]:
    """Sentences that stay, how many go, and the number of maximal removed runs."""
    gone = np.zeros(len(found) + 1, bool)
    for s in starts:
        gone[s : s + span] = True
    n_spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0]) if len(found) else 0
    return [x for x, g in zip(found, gone) if not g], int(gone.sum()), n_spans


def remove_repeated(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """doc_id and the text of every document, without sentences of repeated runs; other texts are unchanged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.in_bounds(batches):
            texts = [t if s is None else "\n".join(kept(pieces(t), s, span)[0]) for t, s in zip(b.column("text").to_pylist(), b.column("found_at").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return _with_removals(docs.select("doc_id", "text"), span, "left").select("doc_id", "text", "found_at").mapInArrow(run, "doc_id bigint, text string")


def op8_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that lose sentences: how many they have and lose, in how many runs, and a digest of what stays."""
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.in_bounds(batches):
            rows = []
            for t, s in zip(b.column("text").to_pylist(), b.column("found_at").to_pylist()):
                found = pieces(t)
                stays, gone, n_spans = kept(found, s, SPAN)
                rows.append((len(found), gone, n_spans, hashlib.sha256("\n".join(stays).encode("utf-8", "surrogatepass")).hexdigest()))
            n, gone, n_spans, digest = zip(*rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digest)], names=["doc_id", "n_sentences", "n_removed", "n_spans", "kept_sha256"])

    return _with_removals(docs, SPAN, "inner").select("doc_id", "text", "found_at").mapInArrow(run, "doc_id bigint, n_sentences bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


QUERIES = {"op8_sentence_spans": op8_sentence_spans}
ORACLES: dict[str, str] = {}
