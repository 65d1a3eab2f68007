"""Benchmark decontamination by q-gram lemma filtering.

Texts are compared as bytes with ASCII letters in lower case and runs of ASCII punctuation and white
space as one space. A benchmark item of m such bytes is found in a document where some part of the
document is within e = m * RATE edits of it. The item's q-grams are taken at every STEP-th place; an
edit touches at most Q / STEP of them, so by the q-gram lemma such a part shares at least
n - e * Q / STEP of an item's n q-grams, on diagonals (place in the document less place in the item)
that lie within e of each other. Shared q-grams are counted in bands of e + 1 diagonals; two
neighbouring bands together are an overlapping band that holds every such set of diagonals. Bands that
meet the bound are verified by banded alignment, all of a slice at once, a row of the item at a time.

For an item too short for the bound to say anything under e edits, the item itself is cut into e + 1
pieces: e edits leave one of them whole, so each place of a piece names a band to verify. An item of
fewer than ten bytes is found where it occurs as it is.

Documents are only scanned: nothing of them is shuffled. The benchmark is sent to workers in blocks of
at most ITEMS bytes, one scan for each block.

Null and empty texts hold nothing, null items are none. A null doc_id keeps its rows. Repeated rows are
found each. Texts of any length are scanned whole, in bounded slices of a record batch. The best match
of an item in a document is reported (fewest edits, then the first place).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Bytes of a q-gram (one 64-bit word), places between an item's q-grams, edits for each byte of an item.
Q, STEP, RATE = 8, 4, 0.1
#: Bytes of a block of items, of documents scanned at a time; alignments at a time.
ITEMS, SLICE, LANES = 8 << 20, 1 << 18, 256
#: Other ASCII than letters and digits is white space.
PLAIN = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
SHIFT, BAND = 1 << 20, 22


def normal(text: str | None) -> bytes:
    return b" ".join(common.text_bytes(text).translate(PLAIN).split())


class Index:
    """The q-grams of a block of items."""

    MUL = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, items: list[tuple[int, str]]):
        known = [(i, normal(t)) for i, t in items]
        known = [(i, t) for i, t in known if t]
        self.ids = [i for i, _ in known]
        self.texts = [np.frombuffer(t, np.uint8) for _, t in known]
        m = np.array([len(t) for t in self.texts], dtype=np.int64)
        grams = (m - Q) // STEP + 1
        self.budget = (m * RATE).astype(np.int64)
        self.least = grams - self.budget * (Q // STEP)
        self.width = self.budget + 1
        short = (m < Q) | (self.least < 1)
        words = [common.unaligned_u64(t)[::STEP] if not s else np.zeros(0, np.uint64) for t, s in zip(self.texts, short)]
        #: Pieces of short items by their bytes (Q at most): words, items, places in the item.
        self.pieces: dict[int, list] = {}
        for j in np.flatnonzero(short):
            edges = np.linspace(0, m[j], self.budget[j] + 2).astype(int)
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                piece = self.texts[j][a : min(b, a + Q)].tobytes()
                self.pieces.setdefault(len(piece), []).append((int.from_bytes(piece, "little"), j, a))
        item = np.repeat(np.arange(len(words)), [len(w) for w in words])
        place = np.concatenate([np.arange(len(w)) * STEP for w in words]) if words else np.zeros(0, np.int64)
        flat = np.concatenate(words) if words else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.grams, first = np.unique(flat[order], return_index=True)
        self.counts = np.diff(np.append(first, len(flat)))
        self.first, self.item, self.place = first, item[order], place[order]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.slot(self.grams)] = True

    def slot(self, words: np.ndarray) -> np.ndarray:
        return ((words * self.MUL) >> np.uint64(44)).astype(np.int64)

    def short_bands(self, words: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, item, first diagonal) of the bands around places of short items' pieces."""
        found = [np.zeros((0, 3), np.int64)]
        for size, entries in self.pieces.items():
            cut = words & np.uint64((1 << (8 * size)) - 1)
            for word in {e[0] for e in entries}:
                at = np.flatnonzero(cut == np.uint64(word))
                text = np.searchsorted(starts, at, side="right") - 1
                for _, j, place in (e for e in entries if e[0] == word):
                    low = (at - starts[text] - place) // self.width[j] * self.width[j]
                    found.append(np.unique(np.stack([text, np.full(len(at), j), low], axis=1), axis=0))
        return tuple(np.unique(np.concatenate(found), axis=0).T)

    def scan(self, texts: list[bytes]) -> list[tuple[int, int, int, int]]:
        """(text, item, edits, place) of the best match of every item found in each text."""
        if not texts or not (len(self.grams) or self.pieces):
            return []
        gap = bytes(Q)
        data = np.frombuffer(gap.join(texts) + gap, np.uint8)
        starts = np.cumsum([0, *(len(t) + Q for t in texts[:-1])])
        words = common.unaligned_u64(data)
        out = self.scan_long_items(texts, starts, words) if len(self.grams) else []
        if self.pieces:
            out = sorted(out + self.verify(texts, *self.short_bands(words, starts)))
        return out

    def scan_long_items(self, texts: list[bytes], starts: np.ndarray, words: np.ndarray) -> list[tuple[int, int, int, int]]:
        at = np.flatnonzero(self.maybe[self.slot(words)])
        gram = np.minimum(np.searchsorted(self.grams, words[at]), len(self.grams) - 1)
        hit = self.grams[gram] == words[at]
        at, gram = at[hit], gram[hit]
        if not len(at):
            return []
        n = self.counts[gram]
        total = int(n.sum())
        which = np.repeat(np.arange(len(at)), n)
        entry = self.first[gram][which] + np.arange(total) - np.repeat(np.cumsum(n) - n, n)
        item = self.item[entry]
        text = (np.searchsorted(starts, at, side="right") - 1)[which]
        diagonal = at[which] - starts[text] - self.place[entry]
        band = (diagonal + SHIFT) // self.width[item] if diagonal.max(initial=0) < (1 << BAND) - SHIFT else None
        if band is None:  # a text of several megabytes: wider keys
            return [x for k, t in enumerate(texts) for x in self._scan_long(k, t)] if len(texts) > 1 else self._scan_long(0, texts[0])
        keys, count = np.unique(((text * len(self.ids) + item) << BAND) + band, return_counts=True)
        after = np.zeros(len(keys), np.int64)
        if len(keys) > 1:
            after[:-1] = np.where(keys[1:] == keys[:-1] + 1, count[1:], 0)
        owner = (keys >> BAND) % len(self.ids)
        good = np.flatnonzero(count + after >= self.least[owner])
        return self.verify(texts, (keys[good] >> BAND) // len(self.ids), owner[good], (keys[good] & ((1 << BAND) - 1)) * self.width[owner[good]] - SHIFT)

    def _scan_long(self, k: int, text: bytes) -> list[tuple[int, int, int, int]]:
        """Scans a very long text in pieces that overlap by the longest item and its budget."""
        reach = max(len(t) for t in self.texts) * 2 + Q
        size = (1 << BAND) - SHIFT - reach
        best: dict[int, tuple[int, int, int, int]] = {}
        for begin in range(0, max(1, len(text) - reach), size):
            part = text[begin : begin + size + reach]
            for _, item, edits, place in self.scan_long_items([part], np.zeros(1, np.int64), common.unaligned_u64(np.frombuffer(part + bytes(Q), np.uint8))):
                new = (k, item, edits, place + begin)
                if item not in best or new[2:] < best[item][2:]:
                    best[item] = new
        return list(best.values())

    def verify(self, texts: list[bytes], text: np.ndarray, item: np.ndarray, low: np.ndarray) -> list[tuple[int, int, int, int]]:
        """Aligns items to the diagonals [low - e, low + 2 * width + e) of texts."""
        best: dict[tuple[int, int], tuple[int, int]] = {}
        order = np.argsort([len(self.texts[j]) for j in item], kind="stable")
        for begin in range(0, len(order), LANES):
            lanes = order[begin : begin + LANES]
            m = np.array([len(self.texts[item[x]]) for x in lanes])
            e, wide = self.budget[item[lanes]], self.width[item[lanes]]
            k = int((2 * wide + 2 * e).max())
            rows = int(m.max())
            pattern = np.zeros((len(lanes), rows), np.uint8)
            part = np.zeros((len(lanes), rows + k + 1), np.uint8)
            first = low[lanes] - e
            for r, x in enumerate(lanes):
                pattern[r, : m[r]] = self.texts[item[x]]
                t = texts[text[x]]
                a, b = max(0, int(first[r])), min(len(t), int(first[r]) + rows + k + 1)
                if a < b:
                    part[r, a - first[r] : b - first[r]] = np.frombuffer(t, np.uint8, b - a, a)
            shift = np.arange(k, dtype=np.int32)
            cost = np.zeros((len(lanes), k), np.int32)
            last = np.zeros((len(lanes), k), np.int32)
            for i in range(rows):
                new = cost + (part[:, i : i + k] != pattern[:, i : i + 1])
                new[:, :-1] = np.minimum(new[:, :-1], cost[:, 1:] + 1)
                cost = np.minimum.accumulate(new - shift, axis=1) + shift
                done = np.flatnonzero(m == i + 1)
                last[done] = cost[done]
            place = last.argmin(1)
            for r, x in enumerate(lanes):
                edits = int(last[r, place[r]])
                if edits <= e[r]:
                    key, new = (int(text[x]), int(item[x])), (edits, max(0, int(first[r] + place[r])))
                    if key not in best or new < best[key]:
                        best[key] = new
        return [(*k, *v) for k, v in sorted(best.items())]


_INDEXES: dict = {}


def _index(sent) -> Index:
    """One index for each block in a worker; only the last is kept."""
    if sent.value["name"] not in _INDEXES:
        _INDEXES.clear()
        _INDEXES[sent.value["name"]] = Index(sent.value["items"])
    return _INDEXES[sent.value["name"]]


def _blocks(benchmark: DataFrame) -> Iterator:
    """Blocks of items, sent to workers."""
    import uuid

    spark = benchmark.sparkSession
    items = benchmark.where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select(F.col("item_id").cast("bigint").alias("item_id"), "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size * 2 // ITEMS) if size > ITEMS else 1
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()
        yield spark.sparkContext.broadcast({"name": uuid.uuid4().hex, "items": [(r.item_id, r.text) for r in rows]})


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, edits, place): every benchmark item in every document that holds it."""
    out = None
    for sent in _blocks(benchmark):

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = _index(sent)
            for b in common.in_bounds(batches, most=SLICE):
                found = index.scan([normal(t) for t in b.column("text").to_pylist()])
                if found:
                    text, item, edits, place = zip(*found)
                    ids = [index.ids[i] for i in item]
                    yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(text)), pa.array(ids, pa.int64()), pa.array(edits, pa.int32()), pa.array(place, pa.int32())], names=["doc_id", "item_id", "edits", "place"])

        part = docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, item_id bigint, edits int, place int")
        out = part if out is None else out.unionByName(part)
    return out


def _free(sent):
    """A column function: no item of a block is found in a text."""

    @F.arrow_udf("boolean")
    def free(text: pa.Array) -> pa.Array:
        index, out = _index(sent), []
        for b in common.in_bounds([pa.record_batch([text], names=["text"])], most=SLICE):
            found = {f[0] for f in index.scan([normal(t) for t in b.column("text").to_pylist()])}
            out += [k not in found for k in range(b.num_rows)]
        return pa.array(out, pa.bool_())

    return free


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs in whose texts no benchmark item is found; a scan that shuffles nothing and sends only texts to Python."""
    for sent in _blocks(benchmark):
        docs = docs.where(_free(sent)(F.col("text")))
    return docs


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark"))


QUERIES = {"op9_decontaminate": op9_decontaminate}
ORACLES: dict[str, str] = {}
