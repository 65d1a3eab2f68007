"""Character spans in texts: occurrences, overlap with chunks, union length, markup."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import table
from .dictionary import places_sql
from .metrics import item_places

LEAST_REPEAT = 21


def occurrences(text: str, part: str, least: int = LEAST_REPEAT) -> list[tuple[int, int]]:
    """All places of a part, overlapping ones too; none for an empty part, or a short one that occurs again."""
    if not part or (len(part) < least and text.count(part) > 1):
        return []
    out, at = [], text.find(part)
    while at >= 0:
        out.append((at, at + len(part)))
        at = text.find(part, at + 1)
    return out


def find_spans(parts: DataFrame, key: str, least: int = LEAST_REPEAT) -> DataFrame:
    """parts (key, text, part, role) -> (key, role, start, end), distinct."""
    kind = parts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, s, e) for i, (t, p) in enumerate(zip(b.column("text").to_pylist(), b.column("part").to_pylist())) for s, e in occurrences(t or "", p or "", least)]
            at, start, end = zip(*rows) if rows else ((), (), ())
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(key).take(at), b.column("role").take(at), pa.array(start, pa.int32()), pa.array(end, pa.int32())], names=[key, "role", "start", "end"])

    return parts.select(key, "text", "part", "role").mapInArrow(run, f"{key} {kind}, role string, start int, end int").distinct()


def overlaps(spans: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """Spans (start, end) that meet chunks (c_start, c_end) of their document, clipped and counted from the chunk's start."""
    met = spans.join(chunks, key).where((F.col("start") < F.col("c_end")) & (F.col("end") > F.col("c_start")))
    return met.withColumns({"s": F.greatest("start", "c_start") - F.col("c_start"), "e": F.least("end", "c_end") - F.col("c_start")})


def covered(spans: DataFrame, key: str) -> DataFrame:
    """(key, covered): characters in the union of a document's spans."""
    w = Window.partitionBy(key).orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.col("end") - F.greatest(F.col("start"), F.coalesce(before, F.col("start"))), F.lit(0))
    return spans.withColumn("new", new).groupBy(key).agg(F.sum("new").cast("bigint").alias("covered"))


def marked_up(text: str, spans: list[dict]) -> str:
    """A text with an opening and a closing mark for each span (role, start, end); at one place closing marks come first."""
    events = [(s["start"], 1, f"<{s['role']}>") for s in spans] + [(s["end"], 0, f"</{s['role']}>") for s in spans]
    out, last = [], 0
    for at, _, mark in sorted(events, key=lambda e: e[:2]):
        out += [text[last:at], mark]
        last = at
    return "".join(out) + text[last:]


def item_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All places of benchmark items in documents."""
    return item_places(spark, sf_dir).select(F.col("doc").alias("doc_id"), F.col("query").alias("item_id"), "start", "end")


def windows(spark: SparkSession, sf_dir: str, size: int = 500) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n")).where("n > 0")
    return docs.select("doc_id", "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / size).cast("int"))).alias("k")).select("doc_id", (F.col("k") * size).alias("c_start"), F.least(F.col("k") * size + size, F.col("n")).alias("c_end"))


def span_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(item_spans(spark, sf_dir), windows(spark, sf_dir), "doc_id").select("doc_id", "item_id", "c_start", "s", "e")


def span_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n"))
    return covered(item_spans(spark, sf_dir), "doc_id").join(docs, "doc_id").select("doc_id", "covered", F.round(F.col("covered") / F.col("n"), 6).alias("share"))


SPANS_SQL = f"""
items as (select item_id, text as piece from benchmark),{places_sql('items', 'item_id', 'piece')},
s as (select doc_id, item_id, cast(p - 1 as int) as start, cast(p - 1 + length(piece) as int) as "end", length(text) as n from places join documents using (doc_id))"""
QUERIES = {"span_overlap": span_overlap, "span_coverage": span_coverage}
ORACLES = {
    "span_overlap": f"""with recursive {SPANS_SQL},
w as (select doc_id, unnest(range(0, length(text), 500)) as c_start, length(text) as n from documents where length(text) > 0)
select s.doc_id, s.item_id, cast(c_start as int) as c_start, cast(greatest(start, c_start) - c_start as int) as s, cast(least("end", c_start + 500, w.n) - c_start as int) as e
from s join w on w.doc_id = s.doc_id and start < least(c_start + 500, w.n) and "end" > c_start""",
    "span_coverage": f"""with recursive {SPANS_SQL},
c as (select doc_id, n, unnest(range(start, "end")) as c from s)
select doc_id, count(distinct c) as covered, round(count(distinct c) / max(n), 6) as share from c group by doc_id""",
}
