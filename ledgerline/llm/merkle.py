"""Merkle manifest of a dataset: leaves by tree and key, proofs, and their check.

Leaves of a tree ascend by key (nulls first, then by digest; equal rows are alike). While a tree has
several nodes, every ARITY consecutive ones become the SHA-256 of their hexadecimal digests; what remains
is the tree's root. The roots of all trees, by tree (null first, bytewise), make the manifest's root in
the same way.

Nodes are made by an event-driven combine by key. A leaf is an event for its parent; a parent gathers its
children's digests by place, and knows from the size of its tree how many it has to wait for. When the
last one is there it becomes an event for the parent above, and so on up, within one task. Leaves are
ordered by range, so nearly all parents end where they began. Parents that a task could not end, the
frontier at the edges of its rows, go to a shuffle by place and are merged there, until none is open.

Proofs go down the reverse links, level by level: each node has the siblings on the way from it to the
root, and gives them on to its children with the siblings that they are to each other. A group is never
more than ARITY children; no tree, hot key or group of equal rows meets in one task.

Null fields have a digest of their own; empty and long texts are hashed whole; equal rows are a leaf each.
An empty table has no nodes and no root (None). Other columns of a table are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Children of a node.
ARITY = 8
#: Open parents that a task holds before it passes them on.
HELD = 100_000
#: Number of the tree of all trees' roots, and level of the row that holds the root.
TOP, ROOT = -1, -1
PARTIAL = "tree bigint, n bigint, level int, parent bigint, children array<int>, digests array<binary>, done boolean"


@dataclass(frozen=True)
class Manifest:
    """leaves (tree, t, n, i, key, leaf, ...), trees (tree, t, n), nodes (tree: number, level, parent, digests), root."""

    leaves: DataFrame
    trees: DataFrame
    nodes: DataFrame
    root: bytes | None


def digest(fields: Iterable[Column]) -> Column:
    """SHA-256 of the fields, each with its length in bytes before it; `-` for a null."""
    each = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields]
    return F.unhex(F.sha2(F.concat(*each), 256))


def numbered(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """df with its rows' places from 0 in the order of `by`, as column name. Written in ranges; counts of the parts give where each begins."""
    at, part, count = common.fresh(df.withColumn(name, F.lit(0)), "at", "part", "count")
    ordered = common.scratch(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn(at, F.monotonically_increasing_id()), name)
    ordered = ordered.withColumns({part: F.shiftright(at, 33), at: F.col(at).bitwiseAND((1 << 33) - 1)})
    # one row a part
    before = F.sum("count").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    starts = ordered.groupBy(part).count().select(part, F.coalesce(before, F.lit(0)).alias(count))
    return ordered.join(starts, part).withColumn(name, F.col(count) + F.col(at)).drop(part, at, count)


def height(n: Column) -> Column:
    """Levels above the leaves of a tree of n leaves."""
    return sum(((n > F.lit(ARITY**k)).cast("int") for k in range(21)), F.lit(0))


class Combiner:
    """Partial parents of one task: create, merge, and emit what is whole; see the module."""

    def __init__(self, n_trees: int):
        self.n_trees = n_trees
        self.open: dict[tuple[int, int, int, int], dict[int, bytes]] = {}
        self.out: list[tuple] = []

    def event(self, tree: int, n: int, level: int, i: int, h: bytes) -> None:
        """Node i of a level (leaves: 0) is known."""
        while True:
            size = -(-n // ARITY**level)
            if size == 1 and tree == TOP:
                self.out.append((TOP, n, ROOT, 0, [0], [h], True))
                return
            if size == 1:
                tree, n, level, i = TOP, self.n_trees, 0, tree
                continue
            parent, child = divmod(i, ARITY)
            key = (tree, n, level + 1, parent)
            known = self.open.setdefault(key, {})
            known[child] = h
            if len(known) < min(ARITY, size - ARITY * parent):
                return
            del self.open[key]
            digests = [known[c] for c in sorted(known)]
            self.out.append((*key, sorted(known), digests, True))
            level, i, h = level + 1, parent, hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()

    def merge(self, tree: int, n: int, level: int, parent: int, children: list[int], digests: list[bytes]) -> None:
        for c, h in zip(children, digests):
            self.event(tree, n, level - 1, parent * ARITY + c, h)

    def pass_on(self, but: tuple | None = None) -> None:
        """Open parents become rows, all but one; the rows of one parent follow each other, so each round merges them all."""
        stays = self.open.pop(but, None)
        for key, known in self.open.items():
            self.out.append((*key, sorted(known), [known[c] for c in sorted(known)], False))
        self.open.clear()
        if stays is not None:
            self.open[but] = stays

    def rows(self) -> Iterator[pa.RecordBatch]:
        out, self.out = self.out, []
        if out:
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.bool_())
            names = ("tree", "n", "level", "parent", "children", "digests", "done")
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)


def _combined(rows: DataFrame, n_trees: int, leaves: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Combiner(n_trees)
        for b in batches:
            columns = [c.to_pylist() for c in b.columns]
            for row in zip(*columns):
                if leaves:
                    found.event(row[0], row[1], 0, row[2], row[3])
                else:
                    found.merge(*row)
                if len(found.open) > HELD:
                    found.pass_on((row[0], row[1], 1, row[2] // ARITY) if leaves else row[:4])
            yield from found.rows()
        found.pass_on()
        yield from found.rows()

    return rows.mapInArrow(run, PARTIAL)


def build(leaves: DataFrame) -> Manifest:
    """leaves (tree string, key, leaf binary, ...) -> the manifest; further columns stay with their leaves."""
    row, at, of = common.fresh(leaves, "row", "at", "of")
    kept = common.scratch(leaves.withColumn(row, F.monotonically_increasing_id()), "leaves")
    placed = numbered(kept, ["tree", "key", "leaf", row], at)  # row: equal leaves are dealt out, too
    trees = placed.groupBy("tree").agg(F.min(at).alias("first"), F.count("*").alias("n"))
    trees = common.scratch(numbered(trees, ["first"], "t"), "trees")
    known = trees.select(F.col("tree").alias(of), "first", "n", "t")
    placed = placed.join(known, F.col("tree").eqNullSafe(F.col(of))).withColumn("i", F.col(at) - F.col("first")).drop(row, at, of, "first")
    n_trees = trees.count()
    tables = [common.scratch(_combined(placed.select("t", "n", "i", "leaf"), n_trees, True), "nodes")]
    while not (still := tables[-1].where("not done")).isEmpty():
        # a parent and the parents above it that begin at the same place meet in one task
        start = F.col("parent") * F.pow(F.lit(ARITY), F.col("level")).cast("bigint")
        met = still.withColumn("start", start).repartitionByRange("tree", "start").sortWithinPartitions("tree", "start", "level").drop("start", "done")
        tables.append(common.scratch(_combined(met, n_trees, False), "nodes"))
    nodes = tables[0]
    for t in tables[1:]:
        nodes = nodes.unionByName(t)
    nodes = nodes.where("done")
    root = nodes.where(F.col("level") == ROOT).select("digests").first()
    return Manifest(placed, trees.drop("first"), nodes.where(F.col("level") != ROOT).select("tree", "level", "parent", "digests"), root and bytes(root.digests[0]))


def _joined(digests: Column) -> Column:
    return F.aggregate(digests, F.lit(b""), lambda a, d: F.concat(a, d))


def _step(place: Column) -> Column:
    """A node's siblings left and right of it, by its place from 0."""
    digests = F.col("digests")
    return F.struct(_joined(F.slice(digests, 1, place)).alias("before"), _joined(F.slice(digests, place + 2, ARITY)).alias("after"))


def _down(at: DataFrame, nodes: DataFrame, level: int) -> DataFrame:
    """Ways (tree, i, way, subroot) of nodes of a level -> of their children; digest: the child's own."""
    made = nodes.where(F.col("level") == level).select("tree", F.col("parent").alias("i"), "digests")
    each = at.join(made, ["tree", "i"]).select("tree", "i", "way", "subroot", "digests", F.posexplode("digests").alias("place", "digest"))
    return each.select("tree", (F.col("i") * ARITY + F.col("place")).alias("i"), F.concat(F.array(_step(F.col("place"))), F.col("way")).alias("way"), "subroot", "digest")


def proofs(made: Manifest) -> DataFrame:
    """The leaves with subroot and way: siblings (before, after) of each level from the leaf up to the root."""
    spark = made.leaves.sparkSession
    trees = made.trees.withColumn("height", height(F.col("n")))
    size = trees.agg(F.count("*").alias("trees"), F.max("height").alias("height")).first()
    if not size.trees:
        return made.leaves.withColumns({"subroot": F.lit(None).cast("binary"), "way": F.lit(None).cast("array<struct<before:binary,after:binary>>")})
    at = spark.range(1).select(F.lit(TOP).cast("bigint").alias("tree"), F.lit(0).cast("bigint").alias("i"), F.expr("cast(array() as array<struct<before:binary,after:binary>>)").alias("way"), F.lit(None).cast("binary").alias("subroot"), F.lit(bytearray(made.root)).alias("digest"))
    level = 0
    while ARITY**level < size.trees:
        level += 1
    for k in range(level, 0, -1):
        at = common.scratch(_down(at, made.nodes, k), "ways")
    starts = at.select(F.col("i").alias("t"), "way", F.col("digest").alias("subroot")).join(trees.select("t", "height"), "t")
    starts = common.scratch(starts.select(F.col("t").alias("tree"), F.lit(0).cast("bigint").alias("i"), "way", "subroot", "height"), "starts")
    of = lambda k: starts.where(F.col("height") == k).drop("height")
    at = of(size.height)
    for k in range(size.height, 1, -1):
        at = common.scratch(_down(at, made.nodes, k).drop("digest"), "ways").unionByName(of(k - 1))
    last = made.nodes.where("level = 1").select("tree", F.col("parent").alias("i"), "digests")
    if size.height:
        tips = at.join(last, ["tree", "i"])
        tips = tips.unionByName(of(0).withColumn("digests", F.lit(None).cast("array<binary>")))
    else:
        tips = at.withColumn("digests", F.lit(None).cast("array<binary>"))
    tree, up = common.fresh(made.leaves, "tree", "up")
    tips = tips.select(F.col("tree").alias(tree), F.col("i").alias(up), "digests", "way", "subroot")
    met = made.leaves.join(tips, (F.col("t") == F.col(tree)) & (F.floor(F.col("i") / ARITY) == F.col(up))).drop(tree, up)
    own = F.when(F.col("digests").isNull(), F.col("way")).otherwise(F.concat(F.array(_step((F.col("i") % ARITY).cast("int"))), F.col("way")))
    return met.withColumn("way", own).drop("digests")


def hexed(c: Column) -> Column:
    return F.lower(F.hex(c))


def folded(leaf: Column, way: Column) -> Column:
    """The root that a leaf gives with the siblings of its way."""
    return F.aggregate(way, leaf, lambda h, s: F.unhex(F.sha2(hexed(F.concat(s["before"], h, s["after"])), 256)))


def proof_digest(way: Column) -> Column:
    """SHA-256 over all siblings of a way, level by level, from left to right."""
    return F.sha2(F.aggregate(way, F.lit(""), lambda a, s: F.concat(a, hexed(F.concat(s["before"], s["after"])))), 256)


def fields(text: Column) -> list[Column]:
    return [F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text]


def tampered(text: Column) -> Column:
    capitals = "".join(map(chr, range(65, 91)))
    return F.translate(text, capitals, capitals.lower())


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    changed = F.when(common.crc_of_id() % 3 == 0, digest(fields(tampered(F.col("text")))))
    leaves = docs.select(F.col("lang").alias("tree"), F.col("doc_id").alias("key"), digest(fields(F.col("text"))).alias("leaf"), changed.alias("changed"))
    made = build(leaves)
    out = proofs(made).withColumn("folded", folded(F.coalesce("changed", "leaf"), F.col("way")))
    root = F.lit(None if made.root is None else bytearray(made.root)).cast("binary")
    return out.select(
        F.col("key").alias("doc_id"), hexed(F.col("leaf")).alias("leaf"), hexed(F.col("subroot")).alias("subroot"), hexed(root).alias("root"),
        proof_digest(F.col("way")).alias("proof_sha256"), hexed(F.col("folded")).alias("folded_root"), (F.col("folded") == root).alias("verified"),
    )


def _levels(name: str, source: str, key: str, depth: int) -> str:
    """SQL of the levels of trees: {name}{k} has h of node i, the level's n nodes, and the siblings l and r."""
    out, below = [], source
    for k in range(depth):
        run = f"{key}, i // {ARITY}"
        out.append(f"""{name}{k} as (
  select {key}, i, h, count(*) over (partition by {key}) as n,
    coalesce(string_agg(h, '') over (partition by {run} order by i rows between unbounded preceding and 1 preceding), '') as l,
    coalesce(string_agg(h, '') over (partition by {run} order by i rows between 1 following and unbounded following), '') as r
  from {below})""")
        below = f"(select {key}, i // {ARITY} as i, case when max(n) > 1 then sha256(string_agg(h, '' order by i)) else max(h) end as h from {name}{k} group by all)"
    return ",\n".join([*out, f"{name}_root as (select {key}, h from {below} where i = 0)"])


def op11_sql(depth: int = 7, top: int = 2) -> str:
    """Trees of up to ARITY ** depth leaves, ARITY ** top trees."""
    field = lambda c: f"coalesce(strlen({c}) || ':' || {c}, '-')"
    leaf = lambda text: "sha256(" + " || ".join(map(field, ("cast(doc_id as varchar)", "source", "lang", "cast(n_chars as varchar)", text))) + ")"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    # crc32 bit by bit, eight steps a digit
    bits = "flatten(list_transform(string_split(cast(doc_id as varchar), ''), lambda c: [ascii(c), 0, 0, 0, 0, 0, 0, 0]))"
    crc = f"xor(4294967295, list_reduce(list_prepend(4294967295, {bits}), lambda s, b: xor(xor(s, b) >> 1, 3988292384 * (xor(s, b) & 1))))"
    nodes = "\n  ".join(f"join s{k} on s{k}.lang is not distinct from d.lang and s{k}.i = d.i // {ARITY ** k}" for k in range(depth))
    above = "\n  ".join(f"join t{k} on t{k}.i = u.i // {ARITY ** k}" for k in range(top))
    steps = [f"s{k}" for k in range(depth)] + [f"t{k}" for k in range(top)]
    return f"""
with d as (
  select doc_id, lang, {leaf('text')} as h, case when doc_id is not null and {crc} % 3 = 0 then {leaf(lower)} end as changed from documents
), o as (select *, row_number() over (partition by lang order by doc_id nulls first, h) - 1 as i from d),
{_levels('s', 'o', 'lang', depth)},
u as (select lang, h, 0 as one, row_number() over (order by lang nulls first) - 1 as i from s_root),
{_levels('t', 'u', 'one', top)},
p as (
  select d.doc_id, d.h as leaf, u.h as subroot, t_root.h as root, sha256({" || ".join(f"{s}.l || {s}.r" for s in steps)}) as proof_sha256,
    {', '.join(f'{s}.n as n_{s}, {s}.l as l_{s}, {s}.r as r_{s}' for s in steps)}, coalesce(d.changed, d.h) as f_0
  from o d
  {nodes}
  join u on u.lang is not distinct from d.lang
  {above}
  cross join t_root
),
{", ".join(f"f{k + 1} as (select *, case when n_{s} > 1 then sha256(l_{s} || f_{k} || r_{s}) else f_{k} end as f_{k + 1} from {'p' if not k else f'f{k}'})" for k, s in enumerate(steps))}
select doc_id, leaf, subroot, root, proof_sha256, f_{len(steps)} as folded_root, f_{len(steps)} = root as verified from f{len(steps)}"""


QUERIES = {"op11_merkle": op11_merkle}
ORACLES = {"op11_merkle": op11_sql()}
