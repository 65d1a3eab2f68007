"""Substring dedup: removes every byte that a repeated string of LENGTH bytes (or another length asked for) covers.

Texts are UTF-8 bytes, matches stay inside documents, and all occurrences go, the first one too.

Which places can match is settled by anchors, without loss: of the GRAM-byte grams in each window of
LENGTH bytes, the one with the smallest hash is the window's anchor, so equal windows have equal
anchors at equal offsets, and every window has one. An anchor's context is what its windows cover.
Contexts are named by hashes, counted with partial aggregates, and settled in bulk where possible: an anchor that
occurs once repeats nothing, and windows in a context that occurs twice are all repeated. What is left
is contexts that differ but share an anchor; those that share neither half around it with another
repeat nothing, either.

The rest, one copy of each context, is dealt to shards by anchor. A shard builds one suffix array of
its contexts by Larsson-Sadakane refinement (prefix doubling over groups that are not yet single, in
numpy) and common prefixes of neighbours by Kasai's rule (all contexts of the shard a step at a time);
windows whose neighbour shares LENGTH bytes are repeated. An anchor of more contexts than a shard
takes is dealt to several shards. These are merged: each sorts the digests of its windows that are
still open and of those it found, ranges of digests meet, and binary search in the sorted lists finds
windows of other shards. No pairs of contexts or of windows are made, and no group is in one task.

The same way finds repeated passages of so many words (PASSAGE, or as asked for), which are often
shorter than LENGTH bytes: a word is then one symbol, a 64-bit hash of its bytes, white space does not
count, and windows, grams, contexts and suffix arrays are in words. Both go through the same steps;
the lowest bit of a gram's hash tells which of the two it is.

Nulls count as empty texts, and texts under LENGTH bytes lose nothing. Rows with the same doc_id and
text each count as a document (a text that is there twice goes) and have equal results. Null doc_ids
are allowed. An empty table gives no rows. Texts of any length are scanned whole, one at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Bytes of a repeated string, unless another length is asked for, and of an anchor's gram.
LENGTH, GRAM = 400, 16
#: Words of a repeated passage, and of an anchor's gram among words.
PASSAGE, WORD_GRAM = 50, 4
#: Numbers of the two kinds of symbols, as in the lowest bit of a gram's hash.
BYTES, WORDS = 0, 1
#: Contexts of one anchor in a shard, bytes of a suffix array.
CONTEXTS, SHARD = 512, 1 << 19
SLICE = 1 << 19
#: Words of 8 bytes, or symbols, that a step of comparing goes on by once the first agree.
LOOK = 16

SPACE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
BYTE_VALUES = common.mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def gram_of(kind: int) -> int:
    return WORD_GRAM if kind else GRAM


def half_of(length: int, kind: int = BYTES) -> int:
    """Half of what windows of a length reach before an anchor: what the halves of a context check."""
    return (length - gram_of(kind)) // 2


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First bytes of the words (between ASCII white space), and the bytes after them."""
    edge = np.flatnonzero(np.diff(~SPACE[data], prepend=False, append=False))
    return edge[::2], edge[1::2]


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64."""
    base = 0xD1342543DE82EF95
    return tuple(np.cumprod(np.append(np.ones(1, np.uint64), np.full(n, x, np.uint64))) for x in (base, pow(base, -1, 1 << 64)))


def laid_out(texts: list[bytes], kind: int = BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts (bytes, or a 64-bit hash for each word), and how many each text has."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    if kind == BYTES:
        return np.frombuffer(b"".join(texts), np.uint8), sizes
    data = np.frombuffer(b"\n".join(texts), np.uint8)
    first, after = word_bounds(data)
    up, down = _powers(1 << max(20, len(data).bit_length()))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE_VALUES[data] * up[: len(data)])])
    symbols = common.mix64((sums[after] - sums[first]) * down[first])
    ends = np.cumsum(sizes + 1)
    return symbols, np.diff(np.searchsorted(first, ends), prepend=0)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the gram at each place; of the last places, where no window's gram begins, anything."""
    n = len(data)
    if data.dtype == np.uint64:
        padded, h = np.concatenate([data, np.zeros(WORD_GRAM, np.uint64)]), data
        for k in range(1, WORD_GRAM):
            h = common.mix64(h * np.uint64(0x9E3779B97F4A7C15) ^ padded[k : n + k])
        return h
    words = common.unaligned_u64(np.concatenate([data, np.zeros(GRAM, np.uint8)]))
    return common.mix64(words[:n] * np.uint64(0x9E3779B97F4A7C15) ^ common.mix64(words[8 : n + 8] if len(words) >= n + 8 else np.append(words[8:], 0)))


def anchors(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, length: int = LENGTH, kind: int = BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(places, gram hashes, first windows, last windows) of the anchors of concatenated texts of `length` symbols at least."""
    n = len(data)
    h = gram_hashes(data)
    width = length - gram_of(kind) + 1
    low = np.uint64((1 << 32) - 1)
    key = (h & ~low) | np.arange(n, dtype=np.uint64)
    pad = -n % width
    blocks = np.concatenate([key, np.full(pad, ~np.uint64(0))]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    # windows that lie inside a text
    first = np.repeat(starts, sizes - length + 1)
    counts = sizes - length + 1
    inside = first + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    least = np.minimum(behind[inside], ahead[inside + width - 1]) & low
    turn = np.concatenate([[True], least[1:] != least[:-1]])
    place = least[turn].astype(np.int64)
    return place, h[place], inside[turn], inside[np.append(turn[1:], True)]


def describe(batches: Iterator[pa.RecordBatch], lengths: tuple[int, ...] = (LENGTH,)) -> Iterator[pa.RecordBatch]:
    """Anchors of documents: gram hash g, context hash c, halves l and r (null where no window has them), document, place, size and symbols before the anchor of the context.

    lengths: of windows in bytes and, if asked for, in words.
    """
    for b in common.in_bounds(batches, most=SLICE):
        texts = [common.text_bytes(t) for t in b.column("text").to_pylist()]
        for kind, length in enumerate(lengths):
            data, sizes = laid_out(texts, kind)
            rows = np.flatnonzero(sizes >= length)
            if not len(rows):
                continue
            if len(rows) < len(sizes):
                data, sizes = data[np.repeat(sizes >= length, sizes)], sizes[rows]
            yield _described(b, rows, data, sizes, length, kind)


def _described(b: pa.RecordBatch, rows: np.ndarray, data: np.ndarray, sizes: np.ndarray, length: int, kind: int) -> pa.RecordBatch:
    gram_size, half, width = gram_of(kind), half_of(length, kind), data.itemsize
    starts = np.cumsum(sizes) - sizes
    place, gram, first, last = anchors(data, starts, sizes, length, kind)
    owner = np.searchsorted(starts, place, side="right") - 1
    left, right = place - first, last + length - place
    flat, digest = data.tobytes(), xxhash.xxh3_64_intdigest
    before, after = left >= half, right >= gram_size + half
    p, x, y, k = (place * width).tolist(), (first * width).tolist(), ((place + right) * width).tolist(), left.tolist()
    ahead, behind = half * width, (gram_size + half) * width
    c = np.fromiter((digest(flat[i:j], n) for i, j, n in zip(x, y, k)), np.uint64, len(p))
    l = np.fromiter((digest(flat[i - ahead : i + gram_size * width]) if has else 0 for i, has in zip(p, before.tolist())), np.uint64, len(p))
    r = np.fromiter((digest(flat[i : i + behind]) if has else 0 for i, has in zip(p, after.tolist())), np.uint64, len(p))
    source = pa.array(rows[owner])
    as_long = lambda a, keep=None: pa.array(a.view(np.int64), mask=None if keep is None else ~keep)
    return pa.RecordBatch.from_arrays(
        [as_long(gram & ~np.uint64(1) | np.uint64(kind)), as_long(c), as_long(l, before), as_long(r, after), b.column("doc_id").take(source), b.column("h").take(source), pa.array((first - starts[owner]).astype(np.int32)), pa.array(left.astype(np.int32)), pa.array((left + right).astype(np.int32))],
        names=["g", "c", "l", "r", "doc_id", "h", "at", "left", "size"],
    )


ANCHOR = "g bigint, c bigint, l bigint, r bigint, doc_id bigint, h bigint, at int, left int, size int"


def suffix_order(data: np.ndarray, left: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Places with `length` symbols left in their text, sorted by these symbols.

    left: symbols left in its text from each place. Larsson-Sadakane: ranks by the first 8 bytes (or the
    first word), then by twice as many each round, over places whose group is not yet single.
    """
    n = len(data)
    words = data if data.dtype == np.uint64 else common.unaligned_u64(np.concatenate([data, np.zeros(8, np.uint8)]))[:n].byteswap()
    narrow = np.int32 if n < 1 << 31 else np.int64
    order = np.argsort(words).astype(narrow)
    ordered = words[order]
    del words
    fresh = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    del ordered
    rank = np.empty(n, narrow)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n, dtype=narrow), narrow(0)))
    single = np.empty(n, bool)
    single[order] = fresh & np.append(fresh[1:], True)
    del order, fresh
    active = np.flatnonzero(~single).astype(narrow)
    have = 8 // data.itemsize
    while have < length:
        step = min(have, length - have)
        active = active[left[active] >= have + step]
        if len(active):
            # the first `have` symbols here, then those from `step` on
            old = rank[active]
            key = old * np.int64(n) + rank[active + narrow(step)]
            by = np.argsort(key)
            key, active, old = key[by], active[by], old[by]
            del by
            start = np.concatenate([[True], old[1:] != old[:-1]])
            fresh = np.concatenate([[True], key[1:] != key[:-1]])
            del key
            at = np.arange(len(old), dtype=narrow)
            rank_new = old + at - np.maximum.accumulate(np.where(start, at, narrow(0)))
            rank_new = rank_new[np.maximum.accumulate(np.where(fresh, at, narrow(0)))]
            lone = fresh & np.append(fresh[1:], True)
            rank[active] = rank_new
            active = active[~lone]
        have += step
    whole = np.flatnonzero(left >= length).astype(narrow)
    return whole[np.argsort(rank[whole], kind="stable")]


def common_prefixes(data: np.ndarray, order: np.ndarray, starts: np.ndarray, left: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Symbols, `length` at most, that each place in order shares with the one before it.

    Kasai's rule: where the sorted predecessor moves on by one place as the text does, the shared prefix
    shrinks by one at most. (The order stops at `length` symbols, so a predecessor may also jump; then
    counting starts anew.) All texts (from starts) go a place at a time.
    """
    n = len(data)
    by_word = data.dtype == np.uint64
    padded = np.concatenate([data, np.zeros(length + 8 * LOOK + 16, data.dtype)])
    words, most = (padded, 1) if by_word else (common.unaligned_u64(padded), 8)
    before = np.full(n, -1, order.dtype)
    before[order[1:]] = order[:-1]
    wanted = np.zeros(n, bool)
    wanted[order] = True
    prefix = np.zeros(n, np.int32)
    place = starts[wanted[starts]]
    shared, last = np.zeros(len(place), np.int64), np.full(len(place), -2, np.int64)
    while len(place):
        other = before[place]
        shared = np.where(other == last + 1, np.maximum(shared - 1, 0), 0)
        go = np.flatnonzero((other >= 0) & (shared < length))
        look = 1
        while len(go):
            at = shared[go][:, None] + np.arange(look) * most
            x = words[place[go][:, None] + at] ^ words[other[go][:, None] + at]
            k = (x != 0).argmax(axis=1)
            x = x[np.arange(len(go)), k]
            lowest = x & (~x + np.uint64(1))
            same = np.where(x == 0, look * most, k * most + (0 if by_word else np.bitwise_count(lowest - np.uint64(1)) >> 3))
            shared[go] = np.minimum(shared[go] + same, length)
            go = go[(x == 0) & (shared[go] < length)]
            look = LOOK
        prefix[place] = shared
        keep = left[place] > length
        place, shared, last = place[keep] + 1, shared[keep], other[keep]
    return prefix[order]


def repeated_places(texts: list[bytes], length: int = LENGTH, kind: int = BYTES) -> list[np.ndarray]:
    """For each text, which of its windows of `length` symbols are somewhere else in the texts, too."""
    data, sizes = laid_out(texts, kind)
    starts = np.cumsum(sizes) - sizes
    narrow = np.int32 if len(data) < 1 << 31 else np.int64
    left = np.repeat((starts + sizes).astype(narrow), sizes) - np.arange(len(data), dtype=narrow)
    order = suffix_order(data, left, length)
    shared = common_prefixes(data, order, starts, left, length) >= length
    hit = np.zeros(len(data), bool)
    hit[order[shared]] = True
    hit[order[np.flatnonzero(shared) - 1]] = True
    return [hit[s : s + max(0, z - length + 1)] for s, z in zip(starts, sizes)]


def intervals(hit: np.ndarray) -> np.ndarray:
    """First and last place of each run of true places, flat."""
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    return np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1], axis=1).astype(np.int32).ravel()


SHARD_OUT = "kind int, g bigint, c bigint, range int, salt int, digests binary, owners binary, found array<int>"


def _shard_rows(contexts: list[dict], lengths: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    """Results of one suffix array for each kind; contexts: (g, c, n, salts, salt, left, l2, r2, bytes)."""
    for kind, length in enumerate(lengths):
        group = [x for x in contexts if x["g"] & 1 == kind]
        if group:
            yield from _array_rows(group, length, kind)


def _array_rows(group: list[dict], length: int, kind: int) -> Iterator[pa.RecordBatch]:
    hits = repeated_places([x["bytes"] for x in group], length, kind)
    rows, many, before, half = [], {}, length - gram_of(kind), half_of(length, kind)
    for x, hit in zip(group, hits):
        if x["n"] > 1:
            hit = np.ones(len(hit), bool)
        elif hit.any():
            rows.append((0, x["g"], x["c"], None, None, None, None, intervals(hit).tolist()))
        if x["salts"] > 1:
            many.setdefault((x["g"], x["salt"]), []).append((x, hit))
    for (g, salt), found in many.items():
        digests, owners = [], []
        for x, hit in found:
            offset = np.arange(len(hit)) + before - x["left"]
            likely = np.where(offset <= half, x["l2"], True) & np.where(offset >= half, x["r2"], True)
            data, _ = laid_out([x["bytes"]], kind)
            at = np.flatnonzero(likely)
            digests.append(np.fromiter((xxhash.xxh3_64_intdigest(data[o : o + length].tobytes()) for o in at), np.uint64, len(at)))
            owners.append(np.stack([np.full(len(at), x["c"], np.int64), np.where(hit[at], -1, at)], axis=1))
        d, own = np.concatenate(digests), np.concatenate(owners)
        # of windows that are settled, one of each is enough
        settled = own[:, 1] < 0
        first = np.zeros(len(d), bool)
        first[np.flatnonzero(settled)[np.unique(d[settled], return_index=True)[1]]] = True
        d, own = d[~settled | first], own[~settled | first]
        by = np.argsort(d, kind="stable")
        d, own = d[by], own[by]
        ranges = (d % np.uint64(found[0][0]["salts"])).astype(np.int64)
        for k in np.unique(ranges):
            at = ranges == k
            rows.append((1, g, None, int(k), salt, d[at].tobytes(), own[at].tobytes(), None))
    if rows:
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int32())]
        yield pa.RecordBatch.from_arrays([pa.array(list(v), k) for v, k in zip(zip(*rows), kinds)], names=[f.split()[0] for f in SHARD_OUT.split(", ")])


def shards(batches: Iterator[pa.RecordBatch], lengths: tuple[int, ...] = (LENGTH,)) -> Iterator[pa.RecordBatch]:
    """Suffix arrays over contexts sorted by (g, salt, c); whole groups, about SHARD bytes each."""
    held, size, last = [], 0, None
    for b in common.in_bounds(batches, "bytes", SHARD):
        for x in b.to_pylist():
            name = (x["g"], x["salt"])
            if name != last and size >= SHARD:
                yield from _shard_rows(held, lengths)
                held, size = [], 0
            if name == last and held[-1]["c"] == x["c"]:
                continue  # the same context from a repeated row
            held.append(x)
            size += len(x["bytes"])
            last = name
    if held:
        yield from _shard_rows(held, lengths)


def merge(table: pa.Table) -> pa.Table:
    """Windows of one range of digests that several shards of an anchor have."""
    lists = [(np.frombuffer(d, np.uint64), np.frombuffer(o, np.int64).reshape(-1, 2)) for d, o in zip(table.column("digests").to_pylist(), table.column("owners").to_pylist())]
    out = []
    every = np.sort(np.concatenate([d for d, _ in lists]))
    for d, own in lists:
        # found in all lists more often than in its own: another shard has it
        inside = np.searchsorted(d, d, side="right") - np.searchsorted(d, d, side="left")
        outside = np.searchsorted(every, d, side="right") - np.searchsorted(every, d, side="left")
        out.append(own[(outside > inside) & (own[:, 1] >= 0)])
    found = np.concatenate(out)
    return pa.table({"g": pa.array(np.full(len(found), table.column("g")[0].as_py(), np.int64)), "c": pa.array(found[:, 0]), "o": pa.array(found[:, 1].astype(np.int32))})


def _contexts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes of contexts, one copy of each: wanted has (doc_id, h, list of contexts)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.in_bounds(batches, most=SLICE):
            out = []
            for t, items in zip(b.column("text").to_pylist(), b.column("items").to_pylist()):
                data = common.text_bytes(t)
                if any(x["g"] & 1 for x in items):
                    first, after = word_bounds(np.frombuffer(data, np.uint8))
                for x in items:
                    i, j = x["at"], x["at"] + x["size"]
                    if x["g"] & 1:
                        i, j = first[i], after[j - 1]
                    out.append((x["g"], x["c"], x["n"], x["salts"], x["salt"], x["left"], x["l2"], x["r2"], data[i:j]))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(list(v), k) for v, k in zip(zip(*out), kinds)], names=["g", "c", "n", "salts", "salt", "left", "l2", "r2", "bytes"])

    keyed = docs.select(F.col("doc_id").alias("id"), F.col("h").alias("th"), "text")
    met = wanted.join(keyed, F.col("h").eqNullSafe(F.col("th")) & F.col("doc_id").eqNullSafe(F.col("id")))
    return met.select("text", "items").mapInArrow(cut, "g bigint, c bigint, n bigint, salts int, salt int, left int, l2 boolean, r2 boolean, bytes binary")


def repeats(docs: DataFrame, length: int = LENGTH, passage: int = 0) -> DataFrame:
    """docs (doc_id, h, text) -> (doc_id, h, spans, passages): for each document with repeated windows, pairs of first byte and byte after, and of first word and word after.

    passage: words of a repeated passage; 0: no passages are looked for.
    """
    lengths = (length, passage) if passage else (length,)
    # aggregates are read back before they join, so that the joins are plain and their large partitions can be split
    found = common.scratch(docs.mapInArrow(partial(describe, lengths=lengths), ANCHOR), "anchors")
    twice = common.scratch(found.groupBy("g").agg(F.count("*").alias("total")).where("total > 1").select("g"), "grams")
    shared = common.scratch(found.join(twice, "g", "left_semi"), "shared")
    common.drop(found, twice)
    context = shared.groupBy("g", "c").agg(F.count("*").alias("n"), F.first("l").alias("l"), F.first("r").alias("r"), F.min(F.struct("doc_id", "h", "at", "left", "size")).alias("where"))
    context = common.scratch(context, "contexts")
    several = common.scratch(context.groupBy("g").agg(F.count("*").alias("d")).where("d > 1").select("g"), "several")
    halves = [common.scratch(context.where(f"{x} is not null").groupBy("g", x).agg(F.count("*").alias("k")).where("k > 1").select("g", x, F.lit(True).alias(f"{x}2")), "halves") for x in "lr"]
    mixed = context.join(several, "g").join(halves[0], ["g", "l"], "left").join(halves[1], ["g", "r"], "left").where("l2 or r2")
    mixed = common.scratch(mixed, "mixed")
    # shards of an anchor by the contexts that are left
    left = common.scratch(mixed.groupBy("g").agg(F.ceil(F.count("*") / CONTEXTS).cast("int").alias("salts")), "salts")
    common.drop(several, *halves)
    dealt = mixed.join(left, "g").withColumn("salt", F.pmod("c", "salts").cast("int"))
    item = F.struct("where.at", "where.left", "where.size", "g", "c", "n", "salts", "salt", F.coalesce("l2", F.lit(False)).alias("l2"), F.coalesce("r2", F.lit(False)).alias("r2"))
    wanted = dealt.groupBy("where.doc_id", "where.h").agg(F.collect_list(item).alias("items"))
    texts = _contexts(docs, wanted).repartition(common.partitions(docs.sparkSession), "g", "salt").sortWithinPartitions("g", "salt", "c")
    done = common.scratch(texts.mapInArrow(partial(shards, lengths=lengths), SHARD_OUT), "shards")
    common.drop(mixed, left)
    own = done.where("kind = 0").select("g", "c", "found")
    across = done.where("kind = 1").groupBy("g", "range").applyInArrow(merge, "g bigint, c bigint, o int")
    across = across.groupBy("g", "c").agg(F.flatten(F.sort_array(F.collect_set(F.array("o", "o")))).alias("found"))
    whole = context.where("n > 1").select("g", "c", F.lit(None).cast("array<int>").alias("found"))
    result = whole.unionByName(own).unionByName(across)
    hits = shared.select("g", "c", "doc_id", "h", "at", "size").join(result, ["g", "c"])
    by_word = F.col("g").bitwiseAND(1) == WORDS
    length = F.when(by_word, passage).otherwise(length)
    pairs = F.when(F.col("found").isNull(), F.array("at", F.col("at") + F.col("size"))).otherwise(F.transform("found", lambda v, i: v + F.col("at") + F.when(i % 2 == 1, length).otherwise(0)))
    out = common.scratch(hits.select("doc_id", "h", F.when(~by_word, pairs).alias("spans"), F.when(by_word, pairs).alias("passages")).groupBy("doc_id", "h").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("spans", "passages")]), "spans")
    common.drop(shared, context, done)
    return out


def covered(size: int, spans) -> np.ndarray:
    """True for each byte that a span covers."""
    if not spans or not size:
        return np.zeros(size, bool)
    s = np.minimum(np.asarray(spans, dtype=np.int64).reshape(-1, 2), size)
    steps = np.bincount(s[:, 0], minlength=size + 1) - np.bincount(s[:, 1], minlength=size + 1)
    return np.cumsum(steps[:size]) > 0


def without_short(gone: np.ndarray, data: bytes, words: int) -> np.ndarray:
    """gone without its runs that hold fewer than `words` whole words (ASCII white space between them)."""
    if not words or not gone.any():
        return gone
    edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
    begins, ends = word_bounds(np.frombuffer(data, np.uint8))
    kept = gone.copy()
    for i, j in edge.reshape(-1, 2).tolist():
        if np.searchsorted(ends, j, side="right") - np.searchsorted(begins, i) < words:
            kept[i:j] = False
    return kept


def with_spans(docs: DataFrame, length: int = LENGTH, passage: int = 0) -> tuple[DataFrame, str, str]:
    """docs with arrays of spans in bytes and of passages in words (null or empty: none), and the names of their columns."""
    h, found_id, found_hash, spans, passages = common.fresh(docs, "h", "found_id", "found_hash", "spans", "passages")
    keyed = docs.withColumn(h, F.xxhash64("text"))
    found = repeats(keyed.select("doc_id", F.col(h).alias("h"), "text"), length, passage).select(F.col("doc_id").alias(found_id), F.col("h").alias(found_hash), F.col("spans").alias(spans), F.col("passages").alias(passages))
    met = keyed.join(found, F.col(h).eqNullSafe(F.col(found_hash)) & F.col("doc_id").eqNullSafe(F.col(found_id)), "left")
    return met.drop(h, found_id, found_hash), spans, passages


def remove_repeats(docs: DataFrame, length: int = LENGTH, words: int = 0) -> DataFrame:
    """docs with bytes of repeated strings cut from their texts; n_chars, if there, follows.

    words: runs of covered bytes that hold fewer whole words stay.
    """
    names = docs.columns
    out = [f for f in docs.schema if f.name != "text"]
    spanned, spans, _ = with_spans(docs, length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.in_bounds(batches):
            texts = []
            for t, s in zip(b.column("text").to_pylist(), b.column(spans).to_pylist()):
                if s:
                    whole = common.text_bytes(t)
                    gone = without_short(covered(len(whole), s), whole, words)
                    if gone.any():
                        t = np.frombuffer(whole, np.uint8)[~gone].tobytes().decode("utf-8", "ignore")  # parts of a character go, too
                texts.append(t)
            columns = {f.name: b.column(f.name) for f in out} | {"text": pa.array(texts, pa.string())}
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([None if t is None else len(t) for t in texts], columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)

    return spanned.mapInArrow(run, docs.schema)


def runs(gone: np.ndarray) -> tuple[int, int]:
    """How many places are true, and in how many runs."""
    return int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[0]) if len(gone) else 0


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns; then n_passages and passage_words: runs of words that passages of PASSAGE words elsewhere cover, and their words. Nothing is removed for these."""
    docs, spans, passages = with_spans(common.read(spark, sf_dir, "documents").select("doc_id", "text"), LENGTH, PASSAGE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.in_bounds(batches):
            rows = []
            for t, s, p in zip(b.column("text").to_pylist(), b.column(spans).to_pylist(), b.column(passages).to_pylist()):
                data = common.text_bytes(t)
                gone = covered(len(data), s)
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes() if s else data
                n_words, n_passages = runs(covered(max(p), p)) if p else (0, 0)
                rows.append((len(data), *runs(gone), hashlib.sha256(kept).hexdigest(), n_passages, n_words))
            size, removed, n_spans, digest, n_passages, n_words = zip(*rows)
            longs = [pa.array(x, pa.int64()) for x in (size, removed, n_spans, n_passages, n_words)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *longs[:3], pa.array(digest), *longs[3:]], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", "passage_words"])

    return docs.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, n_passages bigint, passage_words bigint")


QUERIES = {"op3_suffix_dedup": op3_suffix_dedup}
ORACLES: dict[str, str] = {}
