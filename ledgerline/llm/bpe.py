"""Byte-level BPE by forced-boundary splitting.

A byte pair that occurs inside no vocabulary token can never be merged over, so the place between
its two bytes is a certain cut. A certain cut is used where the pre-tokenizer pattern gives the same
pieces on both sides, too (it has no look-behind, and looks ahead only from white space):

* after a letter or digit, before any other ASCII byte than a letter or digit of its own kind,
* between two ASCII letters,
* after ASCII punctuation, before an ASCII letter or digit,
* before ASCII white space that follows a visible character.

Fragments between cuts are encoded independently, each distinct one once in a worker (a bounded
memo), and concatenated. Texts are split at added tokens first, as the library does.

Nulls count as empty texts: no ids, digests of the empty string. A document of any length is cut
into fragments, so memory follows one document and the memo. Repeated rows give repeated results,
an empty table gives none, and other columns of the input are not looked at.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from . import common

VOCABULARY = "byte_bpe_50k.json"
#: Most fragments in a worker's memo; it is emptied when full. Longer fragments are never kept.
MEMO, MEMO_BYTES = 100_000, 48
#: Bytes of text that are encoded at a time.
SLICE = 1 << 20
#: The pre-tokenizer of byte-level vocabularies with use_regex (a fixed pattern of the file format).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPACE, LETTERS, DIGITS = [9, 10, 11, 12, 13, 32], [*range(65, 91), *range(97, 123)], [*range(48, 58)]
PUNCTUATION = [b for b in range(33, 127) if b not in LETTERS + DIGITS]


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each byte, inverted."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = sorted({*range(256)} - {*plain})
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Encodes and decodes whole texts with a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str | None = None):
        from tokenizers import Tokenizer

        path = path or vocabulary_path()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocabulary = {token: i for token, i in spec["model"]["vocab"].items() if token not in added}
        self.token_bytes = {i: bytes(letters[c] for c in token) for token, i in vocabulary.items()}
        self.library = Tokenizer.from_file(path)
        self.fast = self._ranked(spec, vocabulary)
        self.cut_flat = self.certain_cuts(self.token_bytes.values()).ravel()
        self.added = {t.encode(): i for t, i in added.items()}
        self.token_bytes |= {i: t for t, i in self.added.items()}
        self.dtype = "<u2" if max(self.token_bytes) < 1 << 16 else "<u4"
        self.split_added = regex.compile(b"(" + b"|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + b")") if added else None

    def _ranked(self, spec: dict, vocabulary: dict):
        """The same merges as ranks, where ids follow the order of merges; else None."""
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        pre = spec.get("pre_tokenizer") or {}
        plain = not spec.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
        if not plain or spec["model"].get("ignore_merges") or any(vocabulary.get(a + b) != 256 + i for i, (a, b) in enumerate(pairs)):
            return None
        import tiktoken

        return tiktoken.Encoding("ranked", pat_str=PATTERN, mergeable_ranks={t: i for i, t in self.token_bytes.items()}, special_tokens={})

    @staticmethod
    def certain_cuts(tokens) -> np.ndarray:
        """[a, b] is true if a cut between bytes a and b is certain."""
        inside = np.zeros((256, 256), dtype=bool)
        for token in tokens:
            inside[list(token[:-1]), list(token[1:])] = True
        safe = np.zeros((256, 256), dtype=bool)
        safe[np.ix_(LETTERS, LETTERS + DIGITS + PUNCTUATION)] = True
        safe[np.ix_(DIGITS, LETTERS + PUNCTUATION)] = True
        safe[np.ix_(PUNCTUATION, LETTERS + DIGITS)] = True
        safe[np.ix_([*range(33, 127), *range(128, 192)], SPACE)] = True
        return safe & ~inside

    def cut_places(self, a: np.ndarray, text_ends: np.ndarray | None = None) -> np.ndarray:
        """Ends of the fragments of a text, or of several that end at text_ends."""
        cut = self.cut_flat[(a[:-1].astype(np.uint16) << np.uint16(8)) | a[1:]]
        at = np.flatnonzero(cut)
        if len(wide := np.flatnonzero(a[at] > 127)):  # no cut after white space beyond ASCII
            i = at[wide]
            x, y, z = a[i], a[np.maximum(i - 1, 0)], a[np.maximum(i - 2, 0)]
            general = (z == 0xE2) & (((y == 0x80) & ((x <= 0x8A) | (x == 0xA8) | (x == 0xA9) | (x == 0xAF))) | ((y == 0x81) & (x == 0x9F)))
            blank = ((y == 0xC2) & ((x == 0xA0) | (x == 0x85))) | general | ((y == 0x80) & (x == 0x80) & (z == 0xE3)) | ((y == 0x9A) & (x == 0x80) & (z == 0xE1))
            at = np.delete(at, wide[blank])
        if text_ends is None:
            return np.append(at + 1, len(a))
        last = np.zeros(len(a), bool)
        last[at] = last[text_ends[text_ends > 0] - 1] = True
        return np.flatnonzero(last) + 1

    def fragments(self, data: bytes) -> list[bytes]:
        """The pieces of a text's bytes between certain cuts."""
        if len(data) < 2:
            return [data] if data else []
        ends = self.cut_places(np.frombuffer(data, dtype=np.uint8)).tolist()
        return [data[i:j] for i, j in zip([0, *ends], ends)]

    def ids(self, fragment: bytes) -> list[int]:
        """The ids of one fragment."""
        text = fragment.decode("utf-8", "replace")
        if self.fast is None:
            return self.library.encode(text, add_special_tokens=False).ids
        word = text[1:] if text[:1] == " " else text
        if word.isalpha() and max(word) < "ɐ":  # one piece of the pattern
            return self.fast._core_bpe.encode_single_piece(fragment)
        return self.fast.encode_ordinary(text)

    def parts(self, data: bytes) -> list[bytes]:
        """Fragments, and added tokens as parts of their own."""
        if self.split_added is None or not any(t in data for t in self.added):
            return self.fragments(data)
        return [f for part in self.split_added.split(data) for f in ([part] if part in self.added else self.fragments(part))]

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of a whole text."""
        packed = packer(self)
        return np.frombuffer(b"".join(map(packed.__getitem__, self.parts(common.text_bytes(text)))), dtype=self.dtype)

    def decode(self, ids) -> str:
        """The text of ids, special tokens kept; broken sequences become replacement characters."""
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "replace")


class Table:
    """Fragments of at most 16 bytes and their ids in arrays, for whole slices of text at a time.

    A fragment is its length, its first and its last 8 bytes, which name it exactly. Slots follow a hash
    of these, with PROBES tries; what finds no slot, and longer fragments, are encoded anew in a slice.
    """

    SLOTS, PROBES = 20, 4

    def __init__(self, c: Codec):
        self.codec = c
        self.keep = np.array([(1 << 8 * n) - 1 if n < 8 else 0xFFFFFFFFFFFFFFFF for n in range(17)], dtype=np.uint64)
        self.reset()

    def reset(self) -> None:
        n = 1 << self.SLOTS
        self.first, self.last, self.size = np.zeros(n, np.uint64), np.zeros(n, np.uint64), np.zeros(n, np.uint8)
        self.offset, self.count = np.zeros(n, np.int64), np.zeros(n, np.uint8)
        self.pool, self.used, self.held = np.zeros(1 << 20, self.codec.dtype), 0, 0

    def add(self, ids: list[int]) -> int:
        """Puts ids into the pool: where."""
        new = np.array(ids, self.codec.dtype)
        while self.used + len(new) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool), self.codec.dtype)])
        at = self.used
        self.pool[at : at + len(new)] = new
        self.used += len(new)
        return at

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each)."""
        c = self.codec
        if c.split_added is not None and any(t in x for x in texts for t in c.added):
            each = [b"".join(map(packer(c).__getitem__, c.parts(x))) for x in texts]
            counts = np.array([len(e) for e in each], dtype=np.int64) // np.dtype(c.dtype).itemsize
            return np.frombuffer(b"".join(each), c.dtype), counts
        if self.held > 0.6 * (1 << self.SLOTS) or self.used > 1 << 24:
            self.reset()
        data = b"".join(texts)
        n = len(data)
        text_ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        if not n:
            return np.zeros(0, c.dtype), np.zeros(len(texts), np.int64)
        ends = c.cut_places(np.frombuffer(data, np.uint8), text_ends)
        starts = np.concatenate([[0], ends[:-1]])
        length = ends - starts
        words = common.unaligned_u64(np.frombuffer(data + bytes(16), np.uint8))
        short = np.minimum(length, 16)
        first = words[starts] & self.keep[short]
        last = np.where(length > 8, words[np.maximum(ends - 8, 0)], np.uint64(0))
        size = length.astype(np.uint8)
        h = common.mix64((first * np.uint64(0x9E3779B97F4A7C15)) ^ (last + length.astype(np.uint64)))
        slot = (h >> np.uint64(64 - self.SLOTS)).astype(np.int64)
        offset, count = np.zeros(len(ends), np.int64), np.zeros(len(ends), np.int64)
        left = np.flatnonzero(length <= 16)
        at = slot[left]
        for _ in range(self.PROBES):
            hit = (self.first[at] == first[left]) & (self.last[at] == last[left]) & (self.size[at] == size[left])
            good, where = left[hit], at[hit]
            offset[good], count[good] = self.offset[where], self.count[where]
            left, at = left[~hit], (at[~hit] + 1) & ((1 << self.SLOTS) - 1)
            if not len(left):
                break
        self.insert(data, np.concatenate([left, np.flatnonzero(length > 16)]), starts, ends, first, last, slot, offset, count)
        total = int(count.sum())
        begin = np.cumsum(count) - count
        flat = self.pool[np.repeat(offset - begin, count) + np.arange(total)]
        cumulated = np.concatenate([[0], np.cumsum(count)])
        per_text = cumulated[np.searchsorted(ends, text_ends, side="right")]
        return flat, np.diff(np.concatenate([[0], per_text]))

    def insert(self, data, missed, starts, ends, first, last, slot, offset, count) -> None:
        """Encodes fragments that the table lacks, and gives them free slots."""
        if not len(missed):
            return
        c = self.codec
        known: dict[bytes, int] = {}
        named = [known.setdefault(data[i:j], len(known)) for i, j in zip(starts[missed].tolist(), ends[missed].tolist())]
        flat: list[int] = []
        sizes = []
        for fragment in known:
            ids = _ids(c, fragment)
            flat += ids
            sizes.append(len(ids))
        n = np.array(sizes, dtype=np.int64)
        at = self.add(flat) + np.cumsum(n) - n
        offset[missed], count[missed] = at[named], n[named]
        # one place of each new fragment
        rows = np.zeros(len(known), np.int64)
        rows[named] = missed
        rows = rows[(ends[rows] - starts[rows] <= 16) & (n < 256)]
        for step in range(self.PROBES):
            x = (slot[rows] + step) & ((1 << self.SLOTS) - 1)
            x, once = np.unique(x, return_index=True)
            free = self.size[x] == 0
            x, put = x[free], rows[once[free]]
            self.first[x], self.last[x], self.size[x] = first[put], last[put], (ends[put] - starts[put]).astype(np.uint8)
            self.offset[x], self.count[x] = offset[put], count[put].astype(np.uint8)
            self.held += len(x)
            rows = rows[~np.isin(rows, put)]
            if not len(rows):
                break


def table(c: Codec) -> Table:
    if not hasattr(c, "table"):
        c.table = Table(c)
    return c.table


class Memo(dict):
    """Fragment -> what `make` gives for it; bounded."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key: bytes):
        value = self.make(key)
        if len(key) <= MEMO_BYTES:
            if len(self) >= MEMO:
                self.clear()
            self[key] = value
        return value


@functools.lru_cache(maxsize=2)
def codec(path: str | None = None) -> Codec:
    """One codec for a worker."""
    return Codec(path)


def _ids(c: Codec, fragment: bytes) -> list[int]:
    return [c.added[fragment]] if fragment in c.added else c.ids(fragment)


def packer(c: Codec) -> Memo:
    """Fragment -> its ids as packed integers."""
    if not hasattr(c, "packed"):
        c.packed = Memo(lambda f: np.array(_ids(c, f), dtype=c.dtype).tobytes())
    return c.packed


def names_of(c: Codec) -> tuple[list, list]:
    """For each id: its decimal text, and the bytes it stands for."""
    if not hasattr(c, "names"):
        top = max(c.token_bytes) + 1
        c.names = [b"%d" % i for i in range(top)], [c.token_bytes.get(i) for i in range(top)]
    return c.names


def encode_texts(df: DataFrame, text: str = "text", out: str = "ids", path: str | None = None) -> DataFrame:
    """df with an array<int> column of ids in place of its text column."""
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema if f.name not in (text, out)) + f"`{out}` array<int>"
    keep = [f.name for f in df.schema if f.name not in (text, out)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in common.in_bounds(batches, text):
            ids = [c.encode(t) for t in b.column(text).to_pylist()]
            ends = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
            values = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.ListArray.from_arrays(ends, values)], names=[*keep, out])

    return df.mapInArrow(run, schema)


def decode_ids(df: DataFrame, ids: str = "ids", out: str = "text", path: str | None = None) -> DataFrame:
    """df with a text column in place of its array<int> column of ids; null ids give an empty text."""
    keep = [f.name for f in df.schema if f.name not in (ids, out)]
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema if f.name in keep) + f"`{out}` string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            texts = [c.decode(i or ()) for i in b.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(texts, pa.string())], names=[*keep, out])

    return df.mapInArrow(run, schema)


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encodes and decodes every text: doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        decimal, pieces = names_of(c)
        for b in common.in_bounds(batches, most=SLICE):
            flat, counts = table(c).encode([common.text_bytes(t) for t in b.column("text").to_pylist()])
            ids, texts, at = [], [], 0
            for n in counts.tolist():
                own = flat[at : at + n].tolist()
                at += n
                ids.append(hashlib.sha256(b",".join([decimal[i] for i in own])).hexdigest())
                text = b"".join([pieces[i] for i in own]).decode("utf-8", "replace")
                texts.append(hashlib.sha256(text.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids), pa.array(texts)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(common.read(spark, sf_dir, "documents"))


QUERIES = {"op10_bpe": op10_bpe}
ORACLES: dict[str, str] = {}
