"""SimHash near-duplicates by tiled exact comparison.

Fingerprints of word shingles are compared as numbers: every pair of tiles is met by exclusive-or
and bit counts, and tile pairs are skipped when their population counts differ beyond the radius.
A tile holds distinct fingerprints of one class only; the class is the population counts of equal
parts of the fingerprint, whose summed differences are a lower bound of the distance. Tiles meet in
an equi-join on the class (each class looks for those within the radius around it), so no task
holds more than two tiles and fingerprints never reach the driver.

The pipeline's stage compares sets of shingles. There a tile holds texts that have one sketch hash, or a
component of the links that failed, in common, and sets of about one size (levels), so its work follows
the sizes of such groups and not the square of the table.

A tile pair yields links that span its groups, not all pairs, so a large group of near copies costs
rows in proportion to its size. Copies share a fingerprint and are one node. Components follow from
the links (components.py).

Null and empty texts have no words and the fingerprint zero, which links like any other. A null
doc_id keeps its row; components are named by the smallest id that is not null (null if there is
none). Repeated rows are rows like any other. Other columns of the input are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .components import components

#: Fingerprints in a tile at most, about, for a small and a wide radius; bits of a fingerprint word.
TILE, WIDE_TILE, WORD = 2048, 8192, 64
#: The similarity of near duplicates in the pipeline: numerator and denominator.
SIMILAR = (4, 5)
#: Shingle hashes of a text by which a wide comparison is narrowed.
SKETCH = 12
#: Distinct fingerprints from which classes are made of four population counts in place of two.
MANY = 1 << 21
#: Rows of the first tile that are compared at a time, and shingle sets that are met with another one at a time.
STRIP, SETS = 128, 64
#: Bytes of shingle sets in a tile, about.
TILE_BYTES = 8 << 20
#: Texts with one sketch hash in common that are compared beside other such groups; larger groups go to tiles. Rows that are held for it at a time, about.
GROUP, ROWS = 256, 1 << 16


def shingles(data: bytes, words: int) -> list[bytes]:
    """All shingles of the lower-cased words (ASCII white space between them), repeats included."""
    tokens = data.lower().split()
    if len(tokens) <= words:
        return [b" ".join(tokens)] if tokens else []
    flat = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return [flat[i:j] for i, j in zip(starts[: len(tokens) - words + 1].tolist(), ends[words - 1 :].tolist())]


def shingle_set(data: bytes, words: int, seed: int = 42) -> np.ndarray:
    """The sorted distinct shingle hashes."""
    return np.unique(np.array([xxhash.xxh64_intdigest(s, seed) for s in set(shingles(data, words))], np.uint64))


def set_name(hashes: np.ndarray) -> int:
    """One signed word that names a sorted set of hashes."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes())).view(np.int64))


def fingerprint(data: bytes, words: int, seeds: tuple[int, ...] = (42,), distinct: bool = False) -> tuple[list[int], np.ndarray]:
    """One signed 64-bit word for each seed; distinct: repeated shingles count once, and their sorted hashes of the first seed."""
    found = shingles(data, words)
    if distinct:
        found = list(set(found))
    if not found:
        return [0] * len(seeds), np.zeros(0, np.uint64)
    out, hashes = [], np.zeros(0, np.uint64)
    for seed in seeds:
        digest = xxhash.xxh64_intdigest
        h = np.fromiter((digest(s, seed) for s in found), np.uint64, len(found))
        if distinct and seed == seeds[0]:
            hashes = np.unique(h)
        ones = np.zeros(WORD, np.int64)
        for i in range(0, len(h), 1 << 15):
            ones += np.unpackbits(h[i : i + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out.append(int(np.packbits(ones * 2 > len(found), bitorder="little").view(np.int64)[0]))
    return out, hashes


def fingerprints(docs: DataFrame, words: int = 3, seeds: tuple[int, ...] = (42,)) -> DataFrame:
    """(doc_id, f0, f1, ...): a fingerprint word for each seed."""
    names = [f"f{i}" for i in range(len(seeds))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.in_bounds(batches):
            rows = [fingerprint(common.text_bytes(t), words, seeds)[0] for t in b.column("text").to_pylist()]
            columns = np.array(rows, dtype=np.int64).reshape(-1, len(seeds)).T
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c) for c in columns)], names=["doc_id", *names])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, " + ", ".join(f"{n} bigint" for n in names))


def set_fingerprints(docs: DataFrame, words: int, seeds: tuple[int, ...], sketch: int) -> DataFrame:
    """(doc_id, h, node, f0, f1, ..., size, sketch): fingerprints of the distinct shingles, and the `sketch` smallest of their hashes.

    node names the set of shingles, size is how many it has, h is the hash of the text.
    """
    names = [f"f{i}" for i in range(len(seeds))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.in_bounds(batches):
            rows, sets = zip(*(fingerprint(common.text_bytes(t), words, seeds, True) for t in b.column("text").to_pylist()))
            columns = np.array(rows, dtype=np.int64).reshape(-1, len(seeds)).T
            nodes, least = pa.array(list(map(set_name, sets)), pa.int64()), pa.array([x[:sketch].view(np.int64) for x in sets], pa.list_(pa.int64()))
            size = pa.array(list(map(len, sets)), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("h"), nodes, *(pa.array(c) for c in columns), size, least], names=["doc_id", "h", "node", *names, "size", "sketch"])

    schema = "doc_id bigint, h bigint, node bigint, " + ", ".join(f"{n} bigint" for n in names) + ", size bigint, sketch array<bigint>"
    return docs.select("doc_id", "text", F.xxhash64("text").alias("h")).mapInArrow(run, schema)


def shingle_sets(docs: DataFrame, wanted: DataFrame, words: int, seed: int) -> DataFrame:
    """(node, hashes): the distinct shingle hashes of the texts whose hash is in wanted (h), one row for each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.in_bounds(batches):
            found = [fingerprint(common.text_bytes(t), words, (seed,), True)[1] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([set_name(f) for f in found], pa.int64()), pa.array([f.view(np.int64) for f in found], pa.list_(pa.int64()))], names=["node", "hashes"])

    texts = docs.select("text", F.xxhash64("text").alias("h")).join(wanted, "h", "left_semi")
    return texts.select("text").mapInArrow(run, "node bigint, hashes array<bigint>").dropDuplicates(["node"])


def class_step(radius: int) -> int:
    """Population counts in a class: one for a small radius; a wide one skips little, and its tiles may be fuller."""
    return max(1, radius // 4)


def near_classes(parts: int, bits: int, radius: int) -> list[tuple[int, ...]]:
    """All differences of class vectors that the radius allows; one of each opposite pair."""
    step = class_step(radius)
    radius = min(radius, bits) // step + (step > 1) * parts
    reach = range(-radius, radius + 1)
    if parts == 1:
        return [(d,) for d in reach if d >= 0]
    return [d for d in product(reach, repeat=parts) if sum(map(abs, d)) <= radius and d >= (0,) * parts]


def near_strips(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> Iterator[tuple[int, np.ndarray]]:
    """(start, near): which rows of b lie within the radius of the STRIP rows of a from start, where any does."""
    for start in range(0, len(a), STRIP):
        strip = a[start : start + STRIP]
        d = np.bitwise_count(strip[:, None, 0] ^ b[None, :, 0])
        half = a.shape[1] // 2 if a.shape[1] > 2 else a.shape[1]
        for w in range(1, half):
            d += np.bitwise_count(strip[:, None, w] ^ b[None, :, w])
        near = d <= radius
        if half < a.shape[1]:  # the other words only where the first leave room
            x, y = np.nonzero(near)
            rest = np.bitwise_count(strip[x, half:] ^ b[y, half:]).sum(1) + d[x, y]
            near[x, y] = rest <= radius
        if same:
            near &= np.arange(start, start + len(strip))[:, None] < np.arange(len(b))[None, :]
        if near.any():
            yield start, near


def linked(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that span the groups of two tiles ([n, words] each) within the radius."""
    parent = np.arange(len(a) + (0 if same else len(b)))
    shift = 0 if same else len(a)
    out = []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for start, near in near_strips(a, b, radius, same):
        for i in np.flatnonzero(near.any(1)):
            js = np.flatnonzero(near[i])
            # one step per already known group
            roots, first = np.unique(parent[js + shift], return_index=True)
            for j in js[first]:
                x, y = root(start + i), root(j + shift)
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    out.append((start + i, j))
            parent[js + shift] = root(start + i)
    pairs = np.array(out, dtype=np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def near_in_groups(group: np.ndarray, size: np.ndarray, prints: np.ndarray, radius: int) -> np.ndarray:
    """Index pairs within the radius of rows of one group ([n, 2]) whose set sizes allow SIMILAR; rows are sorted by group and size."""
    at, step, out = np.arange(len(group)), 1, [np.zeros((0, 2), np.int64)]
    while len(at):
        at = at[at + step < len(group)]
        other = at + step
        at = at[(group[other] == group[at]) & (size[at] * SIMILAR[1] >= size[other] * SIMILAR[0])]
        near = at[np.bitwise_count(prints[at] ^ prints[at + step]).sum(1) <= radius]
        out.append(np.stack([near, near + step], axis=1))
        step += 1
    pairs = np.concatenate(out)
    return pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]  # links to a group's first row, where it is near, come first


def spanning(pairs: np.ndarray) -> np.ndarray:
    """Those of the pairs ([n, 2]) that join groups, taken in their order."""
    parent: dict[int, int] = {}

    def root(i: int) -> int:
        while (up := parent.setdefault(i, i)) != i:
            parent[i] = i = parent[up]
        return i

    joins = np.zeros(len(pairs), bool)
    for k, (i, j) in enumerate(pairs.tolist()):
        x, y = root(i), root(j)
        if x != y:
            parent[max(x, y)] = min(x, y)
            joins[k] = True
    return pairs[joins]


def similar(a: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """Which sorted sets have a similarity of SIMILAR at least with the sorted set a; none of them is empty."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    flat = np.concatenate(sets)
    inside = a[np.minimum(np.searchsorted(a, flat), len(a) - 1)] == flat
    both = np.add.reduceat(inside, np.cumsum(sizes) - sizes, dtype=np.int64)
    return both * SIMILAR[1] >= (len(a) + sizes - both) * SIMILAR[0]


def joined(a: np.ndarray, b: np.ndarray, radius: int, same: bool, sets: list[np.ndarray], known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that span the groups of similar sets of two tiles; only pairs within the radius are met.

    sets, known: of the rows of a, then of those of b (of a alone for a tile with itself). Rows of one
    known group are joined from the start, and a pair whose groups are joined is not met again.
    """
    group = np.unique(known, return_inverse=True)[1]
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    shift = 0 if same else len(a)
    out = []
    for start, near in near_strips(a, b, radius, same):
        for i in np.flatnonzero(near.any(1)):
            own = sets[start + i]
            js = np.flatnonzero(near[i])
            z = sizes[js + shift]
            js = js[(np.minimum(z, len(own)) * SIMILAR[1] >= np.maximum(z, len(own)) * SIMILAR[0]) & (z > 0)]
            while len(js := js[group[js + shift] != group[start + i]]):
                now, js = js[:SETS], js[SETS:]
                for j in now[similar(own, [sets[j + shift] for j in now])]:
                    if group[j + shift] != group[start + i]:
                        out.append((start + i, j))
                        group[group == group[j + shift]] = group[start + i]
    pairs = np.array(out, dtype=np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def tiles(prints: DataFrame, words: int, parts: int, radius: int, size: int, more: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Distinct fingerprints in tiles (class, tile, prints), and the number of tiles of each class; more: columns beside the words.

    A tile has about `size` fingerprints at most, and, with a column of sets, about TILE_BYTES of these.
    """
    width = WORD * words // parts
    if parts == 1:
        counts = [sum((F.bit_count(f"f{w}") for w in range(1, words)), F.bit_count("f0"))]
    elif parts <= words:
        counts = [F.bit_count(f"f{w}") for w in range(words)]
    else:
        each = parts // words
        mask = (1 << width) - 1
        counts = [F.bit_count(F.shiftrightunsigned(f"f{w}", width * i).bitwiseAND(F.lit(mask))) for w in range(words) for i in range(each)]
    key = F.lit(0).cast("bigint")
    for c in counts:
        key = key * 1000 + F.floor(c / class_step(radius))
    own = prints.withColumn("class", key)
    needed = F.count("*") / size
    if "hashes" in more:
        needed = F.greatest(needed, F.sum(F.size("hashes").cast("bigint") * 8) / TILE_BYTES)
    sizes = own.groupBy("class").agg(F.ceil(needed).cast("int").alias("n_tiles"))
    # at most (width + 1) ** parts classes: a bounded table
    placed = own.join(F.broadcast(sizes) if (width + 1) ** parts <= 100_000 else sizes, "class")
    placed = placed.withColumn("tile", F.pmod(F.xxhash64(*(f"f{w}" for w in range(words)), *(m for m in more if m != "hashes"), F.lit(7)), F.col("n_tiles")).cast("int"))
    packed = placed.groupBy("class", "tile").agg(F.collect_list(F.struct(*(f"f{w}" for w in range(words)), *more)).alias("prints"))
    return packed, sizes


def level(size):
    """The class of a set's size: sets of a similarity of SIMILAR have the same or the next one."""
    return F.floor(F.log(F.greatest(size, F.lit(1))) / F.log(F.lit(SIMILAR[1] / SIMILAR[0] * (1 + 1e-9)))).cast("bigint")


def keyed_tiles(rows: DataFrame, words: int, size: int, more: tuple[str, ...] = ()) -> DataFrame:
    """rows (key, f0, ..., size) -> tiles (key, class, tile, prints) of one key each: all of a key where they fit, else of one level.

    Of a tile's fullness holds what tiles() says.
    """
    needed = F.count("*") / size
    if "hashes" in more:
        needed = F.greatest(needed, F.sum(F.col("size") * 8) / TILE_BYTES)
    own = rows.withColumn("level", level(F.col("size")))
    # a row for each level of a key; written, as the join with its rows is then plain
    sizes = own.groupBy("key", "level").agg(needed.alias("needed"))
    whole = F.sum("needed").over(Window.partitionBy("key")) <= 1
    sizes = sizes.select("key", "level", F.when(whole, 0).otherwise(F.col("level")).alias("class"), F.when(whole, 1).otherwise(F.ceil("needed")).cast("int").alias("n_tiles"))
    sizes = common.scratch(sizes, "levels")
    placed = own.join(sizes, ["key", "level"]).withColumn("tile", F.pmod(F.xxhash64("node", F.lit(7)), F.col("n_tiles")).cast("int"))
    # in order, so groups that share most of their rows have most of their links in common
    packed = placed.groupBy("key", "class", "tile").agg(F.sort_array(F.collect_list(F.struct(*(f"f{w}" for w in range(words)), *more))).alias("prints"))
    packed = common.scratch(packed, "tiles")
    common.drop(sizes)
    return packed


def near_links(prints: DataFrame, radius: int = 3, words: int = 1, parts: int = 2, size: int | None = None, named: bool = False, verified: bool = False) -> DataFrame:
    """Links (a, b) between distinct fingerprints (structs of words) that span all groups within the radius.

    named: a and b are the values of a column node in place of the words. verified: links are of sets
    (column hashes) of a similarity of SIMILAR at least, and span these groups with those of a column known.
    """
    more = ("node",) * named + ("known", "hashes") * verified
    packed, sizes = tiles(prints, words, parts, radius, size or TILE, more)
    packed = common.scratch(packed, "tiles")
    steps = near_classes(parts, WORD * words // parts, radius)
    offsets = [sum(x * 1000 ** (parts - 1 - i) for i, x in enumerate(d)) for d in steps]
    return meet(packed, [], offsets, radius, words, named, verified)


def keyed_links(rows: DataFrame, radius: int, words: int, verified: bool = False) -> DataFrame:
    """near_links of named rows (key, node, f0, ..., size) that have a key in common, between sets whose sizes allow SIMILAR (tiles may add others)."""
    packed = keyed_tiles(rows, words, WIDE_TILE, ("node",) + ("known", "hashes") * verified)
    return meet(packed, ["key"], [0, 1], radius, words, True, verified)


def meet(packed: DataFrame, keys: list[str], offsets: list[int], radius: int, words: int, named: bool, verified: bool) -> DataFrame:
    """Links between tiles (keys, class, tile, prints) of the same keys whose classes differ by an offset."""
    spark = packed.sparkSession
    a = packed.select(*keys, F.col("class").alias("class_a"), F.col("tile").alias("tile_a"), F.col("prints").alias("prints_a"))
    names = a.select(*keys, "class_a", "tile_a", F.explode(F.array(*map(F.lit, offsets))).alias("step")).select(*keys, "class_a", "tile_a", (F.col("class_a") + F.col("step")).alias("class"))
    met = packed.select(*keys, "class", "tile")
    pairs = names.join(met, [*keys, "class"]).where("class > class_a or tile >= tile_a")
    # names of tile pairs first; the tiles themselves join by (class, tile)
    full = pairs.join(a, [*keys, "class_a", "tile_a"]).join(packed, [*keys, "class", "tile"]).repartition(max(common.partitions(spark), 1), *keys, "class", "tile", "class_a", "tile_a")
    n = words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([(f"f{i}", pa.int64()) for i in range(n)])
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                sides = [row.column(c).flatten() for c in ("prints_a", "prints")]
                x, y = ([f.to_numpy(zero_copy_only=False) for f in s.flatten()[: n + named + verified]] for s in sides)
                xw, yw = (np.stack(z[:n], axis=1).view(np.uint64) for z in (x, y))
                same = row.column("class")[0].as_py() == row.column("class_a")[0].as_py() and row.column("tile")[0].as_py() == row.column("tile_a")[0].as_py()
                if verified:
                    lists = [s.flatten()[-1] for s in sides[: 1 if same else 2]]
                    sets = [v.values.to_numpy(zero_copy_only=False).view(np.uint64) for side in lists for v in side]
                    i, j = joined(xw, yw, radius, same, sets, x[-1] if same else np.concatenate([x[-1], y[-1]]))
                else:
                    i, j = linked(xw, yw, radius, same)
                if not len(i):
                    continue
                if named:
                    ends = [pa.array(z[n][at]) for z, at in ((x, i), (y, j))]
                else:
                    ends = [pa.StructArray.from_arrays([pa.array(z[w][at]) for w in range(n)], fields=list(kind)) for z, at in ((x, i), (y, j))]
                yield pa.RecordBatch.from_arrays(ends, names=["a", "b"])

    word = "bigint" if named else "struct<" + ", ".join(f"f{i}: bigint" for i in range(n)) + ">"
    out = full.select("class", "tile", "class_a", "tile_a", "prints_a", "prints").mapInArrow(run, f"a {word}, b {word}")
    out._tiles = packed
    return out


def component_ids(prints: DataFrame, radius: int = 3, words: int = 1, parts: int | None = None, size: int | None = None) -> DataFrame:
    """prints (doc_id, f0, ...) -> the same with component_id, the smallest doc_id that links reach.

    parts: of a fingerprint for its class; by default 2, and 4 where 2 would fill too many tiles.
    """
    names = [f"f{i}" for i in range(words)]
    distinct = prints.groupBy(*names).agg(F.min("doc_id").alias("least"))
    distinct = common.scratch(distinct, "prints")
    if parts is None:
        parts = 2 if distinct.count() <= MANY else 4
    links = near_links(distinct.select(*names), radius, words, parts, size)
    # a node is named by a fingerprint; one word is its own name
    named = lambda side: F.col(f"{side}.f0") if words == 1 else F.concat_ws("/", *(F.col(f"{side}.{n}").cast("string") for n in names))
    found = common.scratch(links.select(named("a").alias("u"), named("b").alias("v")), "near")
    common.drop(links._tiles)
    roots = components(found)
    node = F.col("f0") if words == 1 else F.concat_ws("/", *(F.col(n).cast("string") for n in names))
    known = common.scratch(distinct.withColumn("node", node).join(roots, "node", "left"), "known")
    linked = known.where("root is not null")
    lowest = common.scratch(linked.groupBy("root").agg(F.min("least").alias("component_id")), "lowest")
    alone = known.where("root is null").select(*names, F.col("least").alias("component_id"))
    named_all = common.scratch(linked.join(lowest, "root").select(*names, "component_id").unionByName(alone), "named")
    common.drop(distinct, found, known, lowest)
    return prints.join(named_all, names)


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document."""
    prints = common.scratch(fingerprints(docs, words), "fingerprints")
    out = component_ids(prints, radius)
    return out.select("doc_id", F.lpad(F.lower(F.hex("f0")), 16, "0").alias("fingerprint"), "component_id")


def sets_of(docs: DataFrame, nodes: DataFrame, ends: DataFrame, words: int, seed: int) -> DataFrame:
    """Scratch table (node, hashes) of the shingle sets of the nodes in ends (node)."""
    wanted = nodes.select("node", "h").join(ends, "node", "left_semi").select("h")
    return common.scratch(shingle_sets(docs, wanted, words, seed), "sets")


def alike(links: DataFrame, sets: DataFrame) -> DataFrame:
    """links (a, b) between nodes with `near`: whether their shingle sets (node, hashes) have a similarity of SIMILAR."""
    side = lambda name: sets.select(F.col("node").alias(name), F.col("hashes").alias(f"hashes_{name}"))
    met = links.join(side("a"), "a").join(side("b"), "b")
    both = F.size(F.array_intersect("hashes_a", "hashes_b")).cast("bigint")
    union = F.size("hashes_a").cast("bigint") + F.size("hashes_b") - both
    return common.scratch(met.select("a", "b", (both * SIMILAR[1] >= union * SIMILAR[0]).alias("near")), "alike")


def shared_links(keyed: DataFrame, radius: int, words: int) -> DataFrame:
    """Scratch table (a, b) of links between nodes that span, for each key, the groups of nodes with that key within the radius.

    keyed: (key, n, node, f0, ..., size), n rows with the key. Only pairs whose sizes allow SIMILAR need be met.
    """
    names = [f"f{i}" for i in range(words)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(rows: np.ndarray) -> pa.RecordBatch:
            pairs = near_in_groups(rows[:, 0], rows[:, 2], np.ascontiguousarray(rows[:, 3:]).view(np.uint64), radius)
            ends = np.sort(rows[:, 1][pairs], axis=1)
            ends = spanning(ends[np.sort(np.unique(ends, axis=0, return_index=True)[1])])
            return pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["a", "b"])

        held = np.zeros((0, 3 + words), np.int64)
        for b in batches:
            held = np.concatenate([held, np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], axis=1)])
            if len(held) >= ROWS:
                cut = int(np.searchsorted(held[:, 0], held[-1, 0]))  # the last group may go on
                yield links(held[:cut])
                held = held[cut:]
        yield links(held)

    few = keyed.where(F.col("n") <= GROUP).select("key", "node", "size", *names)
    few = few.repartition(max(common.partitions(keyed.sparkSession), 1), "key").sortWithinPartitions("key", "size", "node")
    many = keyed_links(keyed.where(F.col("n") > GROUP).drop("n"), radius, words)
    ordered = many.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    out = common.scratch(few.mapInArrow(run, "a bigint, b bigint").unionByName(ordered).distinct(), "near")
    common.drop(many._tiles)
    return out


def similar_links(docs: DataFrame, nodes: DataFrame, radius: int, words: int, seed: int, n_seeds: int, keyed: DataFrame | None = None) -> DataFrame:
    """Scratch table (u, v) of similar nodes that spans each group of nodes linked by similar pairs within the radius.

    nodes: (node, h, f0, ...). keyed: as of shared_links, if only nodes with a key in common are to be
    compared. Spanning links within the radius are checked first. Where one fails, a pair that it stands
    for may still be similar: the nodes of a component with a failed link go to tiles of that component,
    with their sets; pairs within the radius whose ends are not yet in one group are checked there, and
    only links that join groups come out, so a large family costs rows in proportion to its size.
    """
    names = [f"f{i}" for i in range(n_seeds)]
    if keyed is None:
        links = near_links(nodes.select(*names, "node"), radius, n_seeds, 1, WIDE_TILE, named=True)
        linked = common.scratch(links, "near")
        common.drop(links._tiles)
    else:
        linked = shared_links(keyed, radius, n_seeds)
    sets = sets_of(docs, nodes, linked.select(F.explode(F.array("a", "b")).alias("node")).distinct(), words, seed)
    checked = alike(linked, sets)
    common.drop(linked)
    sure = checked.where("near").select(F.col("a").alias("u"), F.col("b").alias("v"))
    if checked.where("not near").isEmpty():
        out = common.scratch(sure, "similar")
        common.drop(checked, sets)
        return out
    roots = common.scratch(components(checked.select(F.col("a").alias("u"), F.col("b").alias("v"))), "roots")
    failed = checked.where("not near").select(F.col("a").alias("node")).join(roots, "node").select("root").distinct()
    groups = components(sure).withColumnRenamed("root", "known")
    left = roots.join(failed, "root", "left_semi").withColumnRenamed("root", "key").join(nodes.select("node", *names), "node").join(sets, "node")
    left = left.join(groups, "node", "left").withColumn("known", F.coalesce("known", "node"))
    left = common.scratch(left.select("key", *names, F.size("hashes").cast("bigint").alias("size"), "node", "known", "hashes"), "open")
    common.drop(roots, sets)
    links = keyed_links(left, radius, n_seeds, verified=True)
    out = common.scratch(sure.unionByName(links.select(F.col("a").alias("u"), F.col("b").alias("v"))), "similar")
    common.drop(checked, links._tiles, left)
    return out


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one row of those that have the same id (not null) and text."""
    doc_id, h, row = common.fresh(docs, "doc_id", "h", "row")
    keyed = docs.withColumns({doc_id: F.col("doc_id"), h: F.xxhash64("text")})
    again = docs.where("doc_id is not null").groupBy(F.col("doc_id").alias(f"{doc_id}2"), F.xxhash64("text").alias(f"{h}2")).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    if again.isEmpty():
        return docs
    again = common.scratch(again, "again")
    same = (F.col(doc_id) == F.col(f"{doc_id}2")) & (F.col(h) == F.col(f"{h}2"))
    # partial aggregates: a row that is there many times is no single task's burden
    first = keyed.join(again, same, "left_semi").groupBy(doc_id, h).agg(F.first(F.struct(*docs.columns)).alias(row)).select(f"{row}.*")
    return keyed.join(again, same, "left_anti").select(*docs.columns).unionByName(first)


def keep_one(docs: DataFrame, words: int = 5, seeds: tuple[int, ...] = (42, 43, 44, 45), radius: int = 54) -> DataFrame:
    """The rows of docs without all but one document of each group of near duplicates.

    Near duplicates are texts whose sets of shingles have a similarity (Jaccard) of SIMILAR at least;
    each link is checked on the sets, and fingerprints of the sets only find the pairs to check.
    A similarity s of shingle sets is a cosine of 2s / (1 + s), and a fingerprint bit differs with the
    angle's share of a half turn: for 0.8, 38.6 of 256 bits on average, with a deviation of 5.7. The
    radius has room for nearly all such pairs, and unrelated texts (128 bits) are nine deviations off.
    Only fingerprints are compared whose texts have one of their SKETCH smallest shingle hashes in common:
    at 0.8, one in 200 million pairs has none.
    A document is an id with a text: of rows that share both, one stays, and rows that share an id only
    are documents of their own. The document with the smallest id stays (with the smallest text hash, if
    it is there with several texts of the group). Rows without an id stay.
    """
    prints = common.scratch(set_fingerprints(docs, words, seeds, SKETCH), "fingerprints")
    names = [f"f{i}" for i in range(len(seeds))]
    document = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "h"))
    nodes = prints.groupBy("node").agg(F.min(document).alias("least"), F.min("h").alias("h"), F.first("size").alias("size"), *(F.first(n).alias(n) for n in names))
    nodes = common.scratch(nodes, "nodes")
    # read back, the join is plain and its large partitions can be split
    each = prints.select("node", F.explode("sketch").alias("key")).distinct()
    shared = common.scratch(each.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "sketches")
    keyed = common.scratch(each.join(shared, "key").join(nodes.select("node", *names, "size"), "node").select("key", "n", "node", *names, "size"), "keyed")
    common.drop(shared)
    found = similar_links(docs, nodes, radius, words, seeds[0], len(seeds), keyed)
    known = common.scratch(nodes.join(components(found), "node", "left").withColumn("root", F.coalesce("root", "node")).select("node", "root", "least"), "known")
    lowest = common.scratch(known.groupBy("root").agg(F.min("least").alias("stays")), "lowest")
    named = common.scratch(known.join(lowest, "root").select("node", "stays"), "named")
    common.drop(nodes, keyed, found, known, lowest)
    gone_id, gone_h, h = common.fresh(docs, "gone_id", "gone_h", "h")
    gone = prints.join(named, "node").where(document != F.col("stays")).select(F.col("doc_id").alias(gone_id), F.col("h").alias(gone_h)).distinct()
    kept = docs.withColumn(h, F.xxhash64("text")).join(gone, (F.col("doc_id") == F.col(gone_id)) & (F.col(h) == F.col(gone_h)), "left_anti")
    return one_of_each(kept.select(*docs.columns))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.read(spark, sf_dir, "documents"))


QUERIES = {"op7_simhash": op7_simhash}
ORACLES: dict[str, str] = {}
