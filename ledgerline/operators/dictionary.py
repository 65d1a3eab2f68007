"""Many patterns in one pass: an Aho-Corasick automaton in arrays, over texts as arrays of code points.

Forms are a table (form, ...); its size is no part of a plan. Forms are dealt to blocks of some FORMS code
points, a block's automaton is built of sorted arrays (steps by state and code point, the longest proper
suffix of each state, the nearest suffix that is a form) and sent to the tasks, and one pass over the texts
finds what it has. The result of a pass is written and its broadcast destroyed before the next one begins, so one block
is held at a time however many forms there are.

In a task, texts of a batch are one array that is cut into lanes, which take their steps together. A lane
begins as far before its own part as the longest form reaches back, and reports ends in its own part only.

`occurrences` gives all places of all forms, overlapping ones too, with the characters next to them; some
characters may be left out, as if the texts had none. `leftmost_longest` keeps, from the left, the longest
one at each place and none that overlaps the one before.

Null and empty texts have no places; empty and null forms are left out; repeated forms count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.scratch import scratch
from ..sources.tables import spread, table

#: Code points of a block of forms; characters of a batch of texts; the least characters of a lane.
FORMS, BATCH, LANE = 4_000_000, 2_000_000, 512
#: Bits of a code point in a step's key, and what stands between texts.
BITS, GAP = 21, (1 << 21) - 1

PLACE = "form string, start int, end int, before string, after string"


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


class Automaton:
    """forms: distinct, not empty. steps: keys state << BITS | code point, sorted, and where they lead."""

    def __init__(self, forms: list[str]):
        sizes = np.array([len(f) for f in forms], np.int64)
        self.sizes, self.longest = sizes, int(sizes.max(initial=0))
        points = code_points("".join(forms))
        first = np.cumsum(sizes) - sizes
        at = np.zeros(len(forms), np.int64)  # the state of each form so far; 0 is the root
        keys, states, n = [], [], 1
        for depth in range(self.longest):
            on = np.flatnonzero(sizes > depth)
            made, of = np.unique((at[on] << BITS) | points[first[on] + depth], return_inverse=True)
            at[on] = n + of
            keys.append(made)
            states.append(n + np.arange(len(made)))
            n += len(made)
        every, to = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, states))
        order = np.argsort(every)
        self.keys, self.to = every[order], to[order]
        self.form = np.full(n, -1, np.int64)
        self.form[at] = np.arange(len(forms))
        self.suffix = np.zeros(n, np.int64)
        self.ending = np.zeros(n, np.int64)
        for made, s in zip(keys, states):  # by depth, so suffixes are shorter and known
            parent, point = made >> BITS, made & ((1 << BITS) - 1)
            if parent.any():
                self.suffix[s] = self.walk(self.suffix[parent], point)
            self.ending[s] = np.where(self.form[self.suffix[s]] >= 0, self.suffix[s], self.ending[self.suffix[s]])

    def walk(self, state: np.ndarray, point: np.ndarray) -> np.ndarray:
        """One step of many states: along a suffix until the code point leads on, or the root."""
        out = np.zeros(len(state), np.int64)
        if not len(self.keys):
            return out
        left = np.arange(len(state))
        while len(left):
            key = (state[left] << BITS) | point[left]
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            met = self.keys[place] == key
            out[left[met]] = self.to[place[met]]
            left = left[~met & (state[left] > 0)]
            state = state.copy()
            state[left] = self.suffix[state[left]]
        return out

    def find(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (end, form) in an array of code points, by end, longer forms first."""
        back = max(self.longest - 1, 0)
        size = max(LANE, 4 * back)
        starts = np.arange(0, len(points), size)
        padded = np.r_[np.full(back, GAP, np.int64), points, np.full(size, GAP, np.int64)]
        state = np.zeros(len(starts), np.int64)
        ends, forms = [], []
        for step in range(back + size if len(starts) else 0):
            state = self.walk(state, padded[starts + step])
            if step < back:
                continue
            lane = np.flatnonzero((self.form[state] >= 0) | (self.ending[state] > 0))
            at = np.where(self.form[state[lane]] >= 0, state[lane], self.ending[state[lane]])
            while len(lane):
                ends.append(starts[lane] + step - back + 1)
                forms.append(self.form[at])
                at = self.ending[at]
                lane, at = lane[at > 0], at[at > 0]
        end, form = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (ends, forms))
        order = np.lexsort((-self.sizes[form], end))
        return end[order], form[order]


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str], np.ndarray]]:
    """Batches in slices of BATCH characters (one row at least), their texts, and the rows' first places when gaps are put between them."""
    for b in batches:
        texts = [t or "" for t in b.column("text").to_pylist()]
        ends = np.cumsum([len(t) + 1 for t in texts])
        start = 0
        while start < len(texts):
            base = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + BATCH, side="right")))
            yield b.slice(start, stop - start), texts[start:stop], np.r_[0, ends[start:stop] - base]
            start = stop


def occurrences(texts: DataFrame, forms: DataFrame, key: str, left_out: str = "") -> DataFrame:
    """texts (key, text), forms (form) -> (key, form, start, end, before, after): every place of every form, in code points; written.

    before, after: the next characters, null at an end of the text. left_out: characters of texts that may stand anywhere in a form.
    """
    spark = texts.sparkSession
    kind = texts.schema[key].dataType.simpleString()
    known = scratch(forms.where("form is not null and form <> ''").select("form").distinct(), "forms")
    share = known.withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id())
    # running sizes within parts, and of parts: one row a part
    inside = share.withColumn("upto", F.sum(F.length("form")).over(Window.partitionBy("part").orderBy("row")))
    parts = inside.groupBy("part").agg(F.max("upto").alias("all")).withColumn("before", F.sum("all").over(Window.orderBy("part")) - F.col("all"))
    dealt = scratch(inside.join(parts, "part").select("form", F.floor((F.col("before") + F.col("upto")) / FORMS).alias("block")), "forms")
    out = spark.createDataFrame([], f"{key} {kind}, {PLACE}")
    for r in dealt.select("block").distinct().orderBy("block").collect():  # one row for FORMS code points
        block = [x.form for x in dealt.where(F.col("block") == r.block).collect()]
        sent = spark.sparkContext.broadcast((block, Automaton(block)))
        out = out.unionByName(scratch(_scan(texts.select(key, "text"), sent, key, kind, left_out), "places"))
        sent.destroy()
    return out


def _scan(texts: DataFrame, sent, key: str, kind: str, left_out: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, found = sent.value
        names = pa.array(names, pa.string())
        for b, each, first in _batches(batches):
            gap = chr(0x10FFFF)  # no character; what a form has of it is cut at texts' ends below
            points = code_points(gap.join(each))
            kept = np.flatnonzero(~np.isin(points, code_points(left_out)))
            end, form = found.find(points[kept])
            start = kept[end - found.sizes[form]]
            end = kept[end - 1] + 1
            row = np.searchsorted(first, start, side="right") - 1
            inside = end < first[row + 1]
            row, start, end, form = (x[inside] for x in (row, start, end, form))
            at_start, at_end = start == first[row], end == first[row + 1] - 1
            around = lambda at, none: pa.array([None if x else chr(c) for c, x in zip(points[np.clip(at, 0, len(points) - 1)].tolist(), none.tolist())], pa.string())
            yield pa.RecordBatch.from_arrays(
                [b.column(key).take(pa.array(row)), names.take(pa.array(form)), pa.array((start - first[row]).astype(np.int32)), pa.array((end - first[row]).astype(np.int32)), around(start - 1, at_start), around(end, at_end)],
                names=[key, "form", "start", "end", "before", "after"],
            )

    return texts.mapInArrow(run, f"{key} {kind}, {PLACE}")


def leftmost_longest(found: DataFrame, by: list[str]) -> DataFrame:
    """Of places (by..., start, end, ...), those that a scan from the left takes: the longest at each place, without overlaps.

    The places of one text and field stream through a task in order; what is kept is where the last one ended.
    """
    columns = found.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, last = None, 0
        for b in batches:
            taken = []
            for i, (k, start, end) in enumerate(zip(zip(*(b.column(c).to_pylist() for c in by)), b.column("start").to_pylist(), b.column("end").to_pylist())):
                if k != of:
                    of, last = k, 0
                if start >= last:
                    last = end
                    taken.append(i)
            yield b.take(pa.array(taken, pa.int64()))

    dealt = found.repartition(*by).sortWithinPartitions(*by, "start", F.desc("end"))
    return dealt.mapInArrow(run, found.schema).select(*columns)


def word_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(form): every two words of a benchmark item that stand together, with what is between them."""
    words = F.split("text", " ")
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - 1, F.lit(1))), lambda i: F.concat_ws(" ", F.slice(words, i, 2)))
    return table(spark, sf_dir, "benchmark").select(F.explode(pairs).alias("form")).where("form <> ''").distinct()


def dictionary_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All places of all pairs of words of benchmark items in documents."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return occurrences(docs, word_pairs(spark, sf_dir), "doc_id").select("doc_id", "form", "start", "end")




def places_sql(parts: str, key: str, part: str) -> str:
    """SQL of `places` (doc_id, key, part, p): where a part is in documents, one place after another, from 1. parts: a table of key and part."""
    return f"""
places as (select doc_id, {key}, {part}, strpos(text, {part}) as p from documents d join {parts} b on contains(d.text, b.{part}) where {part} <> ''
  union all select doc_id, {key}, {part}, p + strpos(substr(text, p + 1), {part}) from places join documents using (doc_id) where contains(substr(text, p + 1), {part}))"""


QUERIES = {"dictionary_places": dictionary_places}
ORACLES = {
    "dictionary_places": f"""with recursive pairs as (select distinct array_to_string(w[i:i + 1], ' ') as form, 0 as k from (
  select w, unnest(range(1, greatest(len(w), 2))) as i from (select string_split(text, ' ') as w from benchmark))),
{places_sql('pairs', 'k', 'form')} select doc_id, form, cast(p - 1 as int) as start, cast(p - 1 + length(form) as int) as "end" from places"""
}
