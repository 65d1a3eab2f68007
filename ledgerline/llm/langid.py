"""Language identification of mixed-language text.

Words are runs of letters. The script of a word's first letter narrows its candidates to the
languages that were seen in that script. Each candidate gets a per-word score, the summed logarithms
of its letter trigrams' smoothed frequencies (with word ends, hashed to a table). A Viterbi pass over
the words of a whole text, in which going on in the same language is free and switching costs a
penalty, labels spans of one language each. A text's language is the label of most of its letters,
and its score is their share.

The model is fitted on a bounded sample of labelled rows, SAMPLE rows with the smallest hashes of
their ids (a documented parameter), whole texts each; the label table holds LANGUAGES labels at most,
the most frequent ones. Everything is computed in numpy over all texts of a bounded slice of a record
batch at once: one pass over letters for the words' scores, one step per word position for Viterbi.

A text that is null or has no letter gets `und`, score 0. With no labelled row, every text is `und`.
Ties go to the first label in order. Repeated rows, long texts and other columns need no care.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

UNKNOWN = "und"
#: Rows of the sample, labels at most, bits of the trigram table, cost of switching (natural logarithm).
SAMPLE, LANGUAGES, BITS, PENALTY = 20_000, 64, 18, 12.0
#: Bytes of text at a time: all of their letters' scores are held.
SLICE = 1 << 20
#: Added to each count; share of a language's letters in a script from which it is a candidate there.
SMOOTH, SCRIPT_SHARE = 0.05, 0.005
#: First and last code point of scripts' ranges, and the script (fixed values of the Unicode standard).
SCRIPTS = (
    ("latin", 0x0041, 0x024F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x0370, 0x03FF), ("greek", 0x1F00, 0x1FFF),
    ("cyrillic", 0x0400, 0x052F), ("armenian", 0x0530, 0x058F), ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x06FF),
    ("arabic", 0x0750, 0x077F), ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF), ("tamil", 0x0B80, 0x0BFF),
    ("thai", 0x0E00, 0x0E7F), ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF), ("kana", 0x3040, 0x30FF),
    ("han", 0x3400, 0x4DBF), ("han", 0x4E00, 0x9FFF), ("hangul", 0xAC00, 0xD7AF), ("han", 0x20000, 0x2FA1F),
)
NAMES = ("other", *dict.fromkeys(s for s, _, _ in SCRIPTS))


@functools.lru_cache(maxsize=1)
def letters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: is it a letter, and the number of its script."""
    is_letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    script = np.zeros(0x110000, np.uint8)
    for name, first, last in SCRIPTS:
        script[first : last + 1] = NAMES.index(name)
    return is_letter, script


class Words:
    """The words of several texts: for each, its text, its script, its letters; and trigram codes of the letters."""

    def __init__(self, texts: list[str | None]):
        is_letter, script = letters()
        lowered = [(t or "").lower() for t in texts]
        data = ("\n" + "\n".join(lowered) + "\n").encode("utf-32-le", "surrogatepass")
        c = np.frombuffer(data, np.uint32)
        letter = is_letter[c]
        at = np.flatnonzero(letter)
        first = at[~letter[at - 1]]
        #: Position among letters where each word starts.
        self.starts = np.searchsorted(at, first)
        self.sizes = np.diff(np.append(self.starts, len(at)))
        self.script = script[c[first]]
        ends = np.cumsum([len(t) + 1 for t in lowered])
        self.text = np.searchsorted(ends, first - 1, side="right")
        zero = np.uint32(0)
        left, right = np.where(letter[at - 1], c[at - 1], zero), np.where(letter[at + 1], c[at + 1], zero)
        x = (left * np.uint32(0x9E3779B1)) ^ (c[at] * np.uint32(0x85EBCA77)) ^ (right * np.uint32(0xC2B2AE3D))
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        x ^= x >> np.uint32(13)
        self.codes = x >> np.uint32(32 - BITS)


def viterbi(scores: np.ndarray, text: np.ndarray, n_texts: int, penalty: float) -> np.ndarray:
    """Labels of the words (rows of scores, in order of their texts), all texts a step at a time."""
    count = np.bincount(text, minlength=n_texts)
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    order = np.argsort(-count, kind="stable")
    count, first = count[order], first[order]
    n_labels = scores.shape[1]
    switched = np.zeros(scores.shape, bool)
    best_before = np.zeros(len(scores), np.uint8)
    state = np.zeros((n_texts, n_labels))
    for t in range(int(count[0]) if len(count) else 0):
        n = int(np.searchsorted(-count, -t, side="left"))
        rows = first[:n] + t  # texts with more than t words come first
        if t == 0:
            state[:n] = scores[rows]
            continue
        best = state[:n].argmax(1)
        leap = state[np.arange(n), best] - penalty
        jump = leap[:, None] > state[:n]
        switched[rows] = jump
        best_before[rows] = best
        state[:n] = np.where(jump, leap[:, None], state[:n]) + scores[rows]
    labels = np.zeros(len(scores), np.int64)
    now = state.argmax(1)
    for t in range(int(count[0]) - 1 if len(count) else -1, -1, -1):
        n = int(np.searchsorted(-count, -t, side="left"))
        rows = first[:n] + t
        labels[rows] = now[:n]
        if t:
            now[:n] = np.where(switched[rows, now[:n]], best_before[rows], now[:n])
    return labels


class Model:
    """Trigram scores and scripts of the learned languages."""

    def __init__(self, languages: list[str], counts: np.ndarray, scripts: np.ndarray):
        self.languages = languages
        total = counts.sum(0, keepdims=True)
        self.table = np.log((counts + SMOOTH) / (total + SMOOTH * len(counts))).astype(np.float32)
        share = scripts / np.maximum(scripts.sum(0, keepdims=True), 1)
        allowed = share >= SCRIPT_SHARE
        #: A script of no learned language leaves all as candidates.
        self.allowed = allowed | ~allowed.any(1, keepdims=True)

    def spans(self, texts: list[str | None], penalty: float = PENALTY) -> tuple[Words, np.ndarray]:
        """The words of the texts and the label of each."""
        w = Words(texts)
        if not len(w.starts) or not self.languages:
            return w, np.zeros(len(w.starts), np.int64)
        scores = np.add.reduceat(self.table[w.codes], w.starts, axis=0).astype(np.float64)
        scores = np.where(self.allowed[w.script], scores, -1e9)
        return w, viterbi(scores, w.text, len(texts), penalty)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        w, labels = self.spans(texts)
        n = len(self.languages)
        if not n:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        mass = np.bincount(w.text * n + labels, weights=w.sizes, minlength=len(texts) * n).reshape(len(texts), n)
        total = mass.sum(1)
        best = mass.argmax(1)
        score = np.where(total > 0, mass[np.arange(len(texts)), best] / np.maximum(total, 1), 0.0)
        return [self.languages[b] if t > 0 else UNKNOWN for b, t in zip(best, total)], score


def fit(docs: DataFrame, training, rows: int = SAMPLE) -> Model:
    """Learns from text and non-null lang of at most `rows` of the rows where `training` holds."""
    spark = docs.sparkSession
    labelled = docs.where(training & F.col("lang").isNotNull() & F.col("text").isNotNull()).withColumn("h", F.xxhash64("doc_id"))
    edge = labelled.select("h").orderBy("h").limit(rows).agg(F.max("h")).first()[0]
    if edge is None:
        return Model([], np.zeros((1 << BITS, 0)), np.zeros((len(NAMES), 0)))
    sample = labelled.where(F.col("h") <= edge).select("text", "lang")
    top = sample.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    languages = sorted(r.lang for r in top)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((len(languages), 1 << BITS), np.int64)
        scripts = np.zeros((len(languages), len(NAMES)), np.int64)
        for b in common.in_bounds(batches, most=SLICE):
            texts, langs = b.column("text").to_pylist(), b.column("lang").to_pylist()
            for k, language in enumerate(languages):
                w = Words([t for t, x in zip(texts, langs) if x == language])
                found[k] += np.bincount(w.codes, minlength=1 << BITS)
                scripts[k] += np.bincount(w.script, weights=w.sizes, minlength=len(NAMES)).astype(np.int64)
        table = np.concatenate([found, scripts], axis=1)
        k, slot = np.nonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(slot.astype(np.int32)), pa.array(table[k, slot])], names=["k", "slot", "n"])

    # at most LANGUAGES tables of a fixed size
    sums = sample.mapInArrow(count, "k int, slot int, n bigint").groupBy("k", "slot").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros((len(languages), (1 << BITS) + len(NAMES)))
    table[sums.column("k").to_numpy(), sums.column("slot").to_numpy()] = sums.column("n").to_numpy()
    return Model(languages, table[:, : 1 << BITS].T, table[:, 1 << BITS :].T)


def identify(docs: DataFrame, model: Model, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with the language and its score in place of columns of these names; only text is looked at, and only text is sent to Python."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang: string, score: double>")
    def named(text: pa.Array) -> pa.Array:
        langs, scores = [], []
        for b in common.in_bounds([pa.record_batch([text], names=["text"])], most=SLICE):
            found, score = sent.value.predict(b.column("text").to_pylist())
            langs += found
            scores.append(score)
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(np.concatenate(scores) if scores else np.zeros(0))], names=["lang", "score"])

    keep = [c for c in docs.columns if c not in names]
    # asked once a row: without the flag a filter below would ask again
    (both,) = common.fresh(docs, "named")
    out = docs.select(*keep, named.asNondeterministic()("text").alias(both))
    return out.select(*keep, F.col(f"{both}.lang").alias(names[0]), F.col(f"{both}.score").alias(names[1]))


def held_out():
    """True where crc32 of the id as text, modulo 4, is 2; false for a null id."""
    return F.coalesce(common.crc_of_id() % 4 == 2, F.lit(False))


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs, ~held_out())
    out = identify(docs.select("doc_id", "text", held_out().alias("held_out")), model)
    return out.select("doc_id", "held_out", "lang_pred", "score")


QUERIES = {"op2_langid": op2_langid}
ORACLES: dict[str, str] = {}
