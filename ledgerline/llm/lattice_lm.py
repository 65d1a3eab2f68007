"""Language-model scores: the marginal likelihood of texts over all segmentations into subwords.

The units are the pieces of an existing subword vocabulary, read from its model file. The file has a
score for each piece; in byte-pair models that is the negative rank of its merge and no probability,
so ranks only shape the prior: a piece's prior share falls as 1 / (rank + RANK), and the corpus adds
what it counts. A text is its words (ASCII letters lower-cased, ASCII white space between) and an end.
A word starts with the vocabulary's word mark; bytes stand for characters that no piece holds. The
probability of a word is the sum over all ways to cut it into pieces, by a forward recursion in
logarithms over the positions of all words of a length at once. The lattice has one more way: a word
of the training part is a unit of its own, with its relative frequency there. That way has the share
1 - n1 / N, where n1 words of N occur once (the Good-Turing estimate of what is not new); the cuts into
pieces have the rest. Frequencies are those of one of CLASSES classes of texts, for words mixed with those of all texts; the classes are the most frequent labels of the training part's `lang`, and the others. A
text's probability is the sum over classes, weighted by their share of training texts, of the product
over its words and its end. The label of a scored text is never looked at.

Counts cover the whole training part. Words are counted in each block of documents, summed by partial
aggregates, written, and come back to the blocks where they occur by a join that can be split, so no
task holds the vocabulary of the corpus and no frequent word is one task's burden. Piece counts follow from the expected cuts of all distinct words under the prior (one step of
expectation and maximisation); each word counts once, as pieces stand for words that are new. There
are as many as the vocabulary has pieces.

Null and empty texts are the end alone. A null doc_id counts as training. Blocks follow a hash of id
and text, so repeated rows are scored alike. An empty table gives no rows.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

VOCABULARY = "piece_bpe_32k.model"
#: Added to counts of the base; prior weight in pieces, and shift of ranks; bytes of a block of documents.
SMOOTH, PRIOR, RANK, BLOCK = 0.1, 1000.0, 50.0, 12 << 20
#: Classes of texts at most, share of the frequencies of all texts in a class, steps of learning pieces.
CLASSES, COMMON, STEPS = 5, 0.05, 1
#: The end of a text in count tables: no word has white space.
END = b" "
#: Words of one length at a time in the recursion; longer words go one at a time.
LANES, LONG = 1 << 12, 64
LOG10 = float(np.log(10))


class Pieces:
    """The vocabulary as byte strings, their prior, and a hash index of them."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        found: dict[bytes, int] = {}
        for i in range(model.get_piece_size()):
            if model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                continue
            piece = bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode()
            found.setdefault(piece, len(found))
        self.pieces = list(found)
        scores = {}
        for i in range(model.get_piece_size()):
            if not model.is_byte(i):
                scores.setdefault(model.id_to_piece(i).replace("▁", " ").encode(), model.get_score(i))
        rank = np.array([-min(0.0, scores.get(p, -float(len(found)))) for p in self.pieces])
        prior = 1 / (rank + RANK)
        self.prior = prior / prior.sum()
        self.longest = max(map(len, self.pieces))
        keys = np.array([self.key(p) for p in self.pieces], dtype=np.uint64)
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two pieces have one hash")
        #: By the top bits of a hash: 2 if a piece may have it, 1 if only a piece's beginning may.
        self.maybe = np.zeros(1 << 22, np.uint8)
        begun = np.array([self.key(p[:i]) for p in self.pieces for i in range(1, len(p))], dtype=np.uint64)
        self.maybe[(begun >> np.uint64(42)).astype(np.int64)] = 1
        whole = (keys >> np.uint64(42)).astype(np.int64)
        self.maybe[whole] = 2 + np.isin(whole, (begun >> np.uint64(42)).astype(np.int64))

    MUL = 0x9E3779B97F4A7C15

    @classmethod
    def key(cls, piece: bytes) -> int:
        h = 0
        for b in piece:
            h = ((h ^ (b + 1)) * cls.MUL) & 0xFFFFFFFFFFFFFFFF
            h ^= h >> 29
        return h

    def edges(self, grid: np.ndarray):
        """(start, end, words, pieces) of all pieces in words of one length ([n, length] bytes)."""
        n, length = grid.shape
        columns = [np.ascontiguousarray(grid[:, i]).astype(np.uint64) + np.uint64(1) for i in range(length)]
        for start in range(length):
            rows, h = np.arange(n), np.zeros(n, np.uint64)
            for end in range(start + 1, min(length, start + self.longest) + 1):
                h = (h ^ (columns[end - 1] if len(rows) == n else columns[end - 1][rows])) * np.uint64(self.MUL)
                h ^= h >> np.uint64(29)
                kind = self.maybe[(h >> np.uint64(42)).astype(np.int64)]
                near = np.flatnonzero(kind >= 2)
                if len(near):
                    at = np.minimum(np.searchsorted(self.keys, h[near]), len(self.keys) - 1)
                    hit = self.keys[at] == h[near]
                    yield start, end, rows[near[hit]], self.order[at[hit]]
                go = np.flatnonzero(kind & 1)
                if not len(go):
                    break
                rows, h = rows[go], h[go]

    def forward(self, grid: np.ndarray, logs: np.ndarray, counts: np.ndarray | None = None, weight: np.ndarray | None = None) -> np.ndarray:
        """Log probability of each word ([n, classes]) by the classes' piece logs ([pieces, classes]).

        Adds expected piece counts, times weight, to counts (both by class; logs may have one class for all).
        """
        n, length = grid.shape
        alpha = np.full((length + 1, n, logs.shape[1]), -np.inf)
        alpha[0] = 0
        edges = list(self.edges(grid)) if counts is not None else self.edges(grid)
        for start, end, rows, found in edges:  # starts ascend: alpha[start] is complete
            if start == 0:
                alpha[end, rows] = logs[found]
            else:
                old, new = alpha[end, rows], alpha[start, rows] + logs[found]
                top = np.maximum(old, new)
                alpha[end, rows] = top + np.log1p(np.exp(np.minimum(old, new) - top))
        if counts is not None:
            beta = np.full(alpha.shape, -np.inf)
            beta[length] = 0
            met, shares = [np.zeros(0, np.int64)], [np.zeros((0, weight.shape[1]))]
            for start, end, rows, found in reversed(edges):
                through = logs[found] + beta[end, rows]
                met.append(found)
                shares.append(np.exp(alpha[start, rows] + through - alpha[length, rows]) * weight[rows])
                beta[start, rows] = np.logaddexp(beta[start, rows], through)
            at, share = np.concatenate(met), np.concatenate(shares)
            for k in range(weight.shape[1]):
                counts[:, k] += np.bincount(at, weights=share[:, k], minlength=len(counts))
        return alpha[length]

    def words(self, words: list[bytes], logs: np.ndarray, counts: np.ndarray | None = None, weight: np.ndarray | None = None) -> np.ndarray:
        """Log probabilities of words by class (the word mark is put before each)."""
        out = np.zeros((len(words), logs.shape[1]))
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            lanes = LANES if size <= LONG else max(1, LANES * LONG // int(size) // 16)
            for i in range(0, len(at), lanes):
                rows = at[i : i + lanes]
                grid = np.frombuffer(b"".join(b" " + words[r] for r in rows), np.uint8).reshape(len(rows), size)
                out[rows] = self.forward(grid, logs, counts, None if weight is None else weight[rows])
        return out


@functools.lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def words_of(text: str | None) -> list[bytes]:
    return common.text_bytes(text).lower().split()


def _block_counts(docs: DataFrame, classes: int) -> DataFrame:
    """(block, word, n0, n1, ...): every word of each block and its counts in training documents of each class."""
    names = [f"n{k}" for k in range(classes)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, known, other = None, [], {}

        def emit():
            if block is not None:
                words = list(other | dict.fromkeys(w for c in known for w in c))
                counts = [pa.array(np.fromiter((c[w] for w in words), np.int64, len(words))) for c in known]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(words), block, np.int32)), pa.array(words, pa.binary()), *counts], names=["block", "word", *names])

        for b in common.in_bounds(batches):
            blocks, of = b.column("block").to_numpy(), b.column("class").to_pylist()
            for i, t in enumerate(b.column("text").to_pylist()):
                if blocks[i] != block:
                    yield from emit()
                    block, known, other = int(blocks[i]), [Counter() for _ in range(classes)], {END: 0}
                if of[i] is None:
                    other.update(dict.fromkeys(words_of(t), 0))
                else:
                    known[of[i]].update(words_of(t))
                    known[of[i]][END] += 1
        yield from emit()

    return docs.mapInArrow(run, "block int, word binary, " + ", ".join(f"{n} bigint" for n in names))


def _log(x: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.log(x)


def score(docs: DataFrame, held_out, path: str | None = None) -> DataFrame:
    """Scores of all documents by a model of those where held_out is false."""
    spark = docs.sparkSession
    path = path or vocabulary_path()
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(common.partitions(spark), -(-size // BLOCK))
    labels = docs.where(~held_out & F.col("lang").isNotNull()).groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(CLASSES - 1)
    labels = [r.lang for r in labels.collect()]
    n_classes = len(labels) + 1
    of = F.lit(len(labels))
    for k, label in enumerate(labels):
        of = F.when(F.col("lang") == label, k).otherwise(of)
    keyed = docs.select("doc_id", "text", held_out.alias("held_out"), F.when(~held_out, of).cast("int").alias("class"))
    keyed = keyed.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))
    # a block is a partition: dealt by its number, not by a hash of it, so that all are equally full
    dealt = keyed.repartitionById(blocks, F.col("block")).sortWithinPartitions("block")
    names, columns = [f"n{k}" for k in range(n_classes)], [f"c{k}" for k in range(n_classes)]
    in_blocks = common.scratch(_block_counts(dealt, n_classes), "counts")
    # partial sums come before the shuffle, so a word of every block is no single task's burden
    totals = in_blocks.groupBy("word").agg(*(F.sum(n).alias(c) for n, c in zip(names, columns)))
    totals = common.scratch(totals.where(sum((F.col(c) for c in columns[1:]), F.col(columns[0])) > 0), "totals")
    known = totals.withColumn("c", sum((F.col(x) for x in columns[1:]), F.col("c0")))
    is_word = F.col("word") != F.lit(END)
    sums = known.agg(
        F.count("*").alias("distinct"),
        *(F.coalesce(F.sum(F.when(is_word, F.col(x))), F.lit(0)).alias(f"w_{x}") for x in columns),
        *(F.coalesce(F.sum(F.when(~is_word, F.col(x))), F.lit(0)).alias(f"e_{x}") for x in columns),
        *(F.count_if(is_word & (F.col("c") == 1) & (F.col(x) == 1)).alias(f"o_{x}") for x in columns),
    ).first()
    in_words, in_ends, once = (np.array([sums[f"{kind}_{x}"] for x in columns], dtype=np.float64) for kind in "weo")
    n_all = int(in_words.sum() + in_ends.sum())

    v = pieces(path)
    # one step of expectation and maximisation at a time, each a row for each piece of the vocabulary and class
    logs = np.log(v.prior[:, None])
    for _ in range(STEPS):
        sent = spark.sparkContext.broadcast(logs)

        def expect(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            v = pieces(path)
            counts = np.zeros((len(v.pieces), n_classes))
            for b in batches:
                weight = np.stack([b.column(x).to_numpy() for x in columns], axis=1) > 0
                v.words(b.column("word").to_pylist(), sent.value, counts, weight.astype(np.float64))
            at, k = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(k.astype(np.int32)), pa.array(counts[at, k])], names=["piece", "class", "n"])

        gathered = known.where(is_word).select("word", *columns).mapInArrow(expect, "piece bigint, class int, n double").groupBy("piece", "class").agg(F.sum("n").alias("n")).toArrow()
        counts = np.repeat(v.prior[:, None] * PRIOR, n_classes, axis=1)
        counts[gathered.column("piece").to_numpy(), gathered.column("class").to_numpy()] += gathered.column("n").to_numpy()
        logs = np.log(counts / counts.sum(0))
    # pieces with the word mark start words, others follow in them; a word ends where the next mark or the end comes
    sent = spark.sparkContext.broadcast(logs)
    n_words, n_ends = in_words.sum(), in_ends.sum()
    end_log, go_log = np.log((n_ends + 1) / (n_words + n_ends + 2)), np.log((n_words + 1) / (n_words + n_ends + 2))
    novel = (once + 1) / (in_words + 2)
    weight = np.log((in_ends + 1) / (n_ends + n_classes))
    base_total = n_all + SMOOTH * (sums["distinct"] + 1)

    def table(words: list[bytes], c: np.ndarray):
        """Place of each word of a block, its log probability by class, its base score, and whether it is known."""
        v = pieces(path)
        total = c.sum(1)
        at = np.flatnonzero(np.fromiter((w != END for w in words), bool, len(words)))
        lm = np.full(c.shape, end_log)
        cut = v.words([words[i] for i in at], sent.value)
        whole = (1 - COMMON) * c[at] / np.maximum(in_words, 1) + COMMON * total[at, None] / max(n_words, 1)
        lm[at] = np.logaddexp(_log(whole) + np.log1p(-novel), cut + np.log(novel)) + go_log
        return dict(zip(words, range(len(words)))), lm, np.log10((total + SMOOTH) / base_total), total > 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a block: its words first, then its documents."""
        block, words, found, model = None, [], [], None
        for b in common.in_bounds(batches):
            blocks, is_text = b.column("block").to_numpy(), b.column("is_text").to_numpy(zero_copy_only=False)
            for begin in np.flatnonzero(np.append(True, (blocks[1:] != blocks[:-1]) | (is_text[1:] != is_text[:-1]))):
                same = (blocks[begin:] == blocks[begin]) & (is_text[begin:] == is_text[begin])
                part = b.slice(begin, len(same) if same.all() else int(np.argmin(same)))
                if blocks[begin] != block:
                    block, words, found, model = blocks[begin], [], [], None
                if not is_text[begin]:
                    words += part.column("word").to_pylist()
                    found.append(np.stack([part.column(x).to_numpy() for x in columns], axis=1).astype(np.float64))
                    continue
                if model is None:
                    model = table(words, np.concatenate(found))
                    words, found = [], []
                place, lm, base, seen = model
                out = []
                for t in part.column("text").to_pylist():
                    tokens = words_of(t)
                    tokens.append(END)
                    i = np.fromiter(map(place.__getitem__, tokens), np.int64, len(tokens))
                    out.append((len(i), int(seen[i].sum()), float(base[i].sum()), float(np.logaddexp.reduce(lm[i].sum(0) + weight) / LOG10)))
                n_tokens, n_known, base_score, score_of = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array([n_all] * len(out), pa.int64()), pa.array(base_score, pa.float64()), pa.array(score_of, pa.float64())],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    # a plain join: the partitions of frequent words, which have a row for each block, can be split
    back = in_blocks.select("block", "word").join(totals, "word", "left")
    back = back.select("block", F.lit(False).alias("is_text"), F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast("boolean").alias("held_out"), F.lit(None).cast("string").alias("text"), "word", *(F.coalesce(x, F.lit(0)).alias(x) for x in columns))
    texts = keyed.select("block", F.lit(True).alias("is_text"), "doc_id", "held_out", "text", F.lit(None).cast("binary").alias("word"), *(F.lit(0).cast("bigint").alias(x) for x in columns))
    met = back.unionByName(texts).repartitionById(blocks, F.col("block")).sortWithinPartitions("block", "is_text")
    return met.mapInArrow(run, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def held_out():
    """True where crc32 of the id as text, modulo 10, is 0; false for a null id."""
    return F.coalesce(common.crc_of_id() % 10 == 0, F.lit(False))


def op4_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(common.read(spark, sf_dir, "documents"), held_out())


QUERIES = {"op4_lattice_lm": op4_lattice_lm}
ORACLES: dict[str, str] = {}
