"""A BM25 index that grows: immutable segments, deletion marks, merged statistics and snapshots.

A folder has segments (documents, postings, and the terms' document frequencies of each), deletions (which
documents of which segment are gone, and what they counted in its statistics) and snapshots: small files
that name the segments and deletions of one state, numbered. A change writes new tables first and then the
next snapshot, which makes it visible at once; who comes second with the same number fails and takes its
change again. Readers keep the snapshot that they opened, and what it names is never changed.

Statistics of a snapshot are sums over segments less sums over deletions, so scores are those of an index
that was built of the living documents alone. Compaction writes these as one segment; what older snapshots
name stays until `removable` files are deleted by who knows that no reader is left.

A document is a key; adding one that is there replaces it. Documents without words count. Null keys are
refused. An empty change makes no snapshot.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files
from ..sources.scratch import shared_dir
from ..sources.tables import spread, table
from . import lexical


class Conflict(RuntimeError):
    """Another change took the next number."""


@dataclass(frozen=True)
class Snapshot:
    spark: SparkSession
    folder: str
    number: int
    settings: dict
    segments: list[str] = field(default_factory=list)
    deletions: list[str] = field(default_factory=list)

    def _table(self, name: str, parts: list[str] | None = None) -> DataFrame | None:
        """A table of all segments (or the given parts), with where each row is from; None without any."""
        found = [self.spark.read.parquet(f"{self.folder}/{p}/{name}").withColumn("part", F.lit(p)) for p in (self.segments if parts is None else parts)]
        return reduce(DataFrame.unionByName, found) if found else None

    def living(self, name: str, used: DataFrame | None = None) -> DataFrame | None:
        """Rows (part, doc, ...) of a table of all segments, of documents that are not deleted; used (term): the terms that are wanted."""
        every = self._table(name)
        if every is not None and used is not None:  # before the rows of deleted documents are looked for
            every = every.join(used, "term", "left_semi")
        gone = self._table("gone", self.deletions)
        if every is None or gone is None:
            return every
        return every.join(gone.select(F.col("segment").alias("part"), "doc"), ["part", "doc"], "left_anti")

    def index(self, used: DataFrame | None = None) -> lexical.Index:
        """The living documents as a BM25 index; used (term): postings of these terms only."""
        if not self.segments:
            raise ValueError("an index without segments")
        signed = lambda name: reduce(DataFrame.unionByName, [x.withColumn("sign", F.lit(s)) for x, s in ((self._table(name), 1), (self._table(name, self.deletions), -1)) if x is not None])
        terms = signed("terms").groupBy("term").agg(F.sum(F.col("df") * F.col("sign")).alias("df")).where("df > 0")
        counts = signed("counts").agg(F.sum(F.col("n") * F.col("sign")).alias("n"), F.sum(F.col("tokens") * F.col("sign")).alias("tokens"))
        return lexical.Index(self.living("postings", used).drop("part"), terms, counts.select("n", F.when(F.col("n") > 0, F.col("tokens") / F.col("n")).alias("avgdl")))

    def _next(self, segments: list[str], deletions: list[str]) -> Snapshot:
        """Makes the next snapshot visible."""
        made = Snapshot(self.spark, self.folder, self.number + 1, self.settings, segments, deletions)
        text = json.dumps({"settings": self.settings, "segments": segments, "deletions": deletions}, sort_keys=True)
        _publish(self.spark, f"{self.folder}/snapshots/{made.number:09}.json", text)
        return made

    def _write(self, docs: DataFrame) -> str:
        """A segment of documents (doc, dl, tokens)."""
        name = f"segment-{uuid.uuid4().hex}"
        found = lexical.index(docs)  # texts are read once
        found.counted.select("doc", "dl").write.parquet(f"{self.folder}/{name}/docs")
        return self._finished(name, found.postings)

    def _finished(self, name: str, postings: DataFrame) -> str:
        path = f"{self.folder}/{name}"
        postings.repartitionByRange("term", "doc").sortWithinPartitions("term", "doc").write.parquet(f"{path}/postings")
        self._statistics(path, self.spark.read.parquet(f"{path}/docs"), self.spark.read.parquet(f"{path}/postings"))
        return name

    def _statistics(self, path: str, docs: DataFrame, postings: DataFrame) -> None:
        lexical.frequencies(postings).write.parquet(f"{path}/terms")
        docs.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).cast("bigint").alias("tokens")).write.parquet(f"{path}/counts")

    def _delete(self, keys: DataFrame) -> str | None:
        """Marks the living documents among keys (doc) as deleted; None if there are none."""
        docs = self.living("docs")
        if docs is None:
            return None
        name = f"deletion-{uuid.uuid4().hex}"
        path = f"{self.folder}/{name}"
        met = docs.join(keys.select("doc").distinct(), "doc", "left_semi")
        met.select(F.col("part").alias("segment"), "doc", "dl").write.parquet(f"{path}/gone")
        gone = self.spark.read.parquet(f"{path}/gone")
        if gone.isEmpty():
            return None
        postings = self._table("postings").join(gone.select(F.col("segment").alias("part"), "doc"), ["part", "doc"], "left_semi")
        self._statistics(path, gone, postings)
        return name

    def add(self, docs: DataFrame) -> Snapshot:
        """With documents (doc, dl, tokens), as lexical.documents gives them; those whose key is there are replaced."""
        if not docs.where("doc is null").isEmpty():
            raise ValueError("documents without a key")
        segment = self._write(docs)
        keys = self.spark.read.parquet(f"{self.folder}/{segment}/docs")
        if keys.isEmpty():
            return self
        gone = self._delete(keys)
        return self._next([*self.segments, segment], self.deletions + ([gone] if gone else []))

    def delete(self, keys: DataFrame) -> Snapshot:
        """Without the documents of keys (doc); keys that are not there are no matter."""
        gone = self._delete(keys)
        return self._next(self.segments, [*self.deletions, gone]) if gone else self

    def compact(self) -> Snapshot:
        """The same documents in one segment, without deletions."""
        if len(self.segments) < 2 and not self.deletions:
            return self
        name = f"segment-{uuid.uuid4().hex}"
        self.living("docs").drop("part").write.parquet(f"{self.folder}/{name}/docs")
        return self._next([self._finished(name, self.living("postings").drop("part"))], [])


def _publish(spark: SparkSession, path: str, text: str) -> None:
    fs, p = files._fs(spark, path)
    try:
        out = fs.create(p, False)
    except Exception as e:  # the store's own error, wrapped by the gateway
        if fs.exists(p):
            raise Conflict(path) from e
        raise
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def create(spark: SparkSession, folder: str, settings: dict) -> Snapshot:
    """An empty index; a folder that has one is an error."""
    _publish(spark, f"{folder}/snapshots/{0:09}.json", json.dumps({"settings": settings, "segments": [], "deletions": []}, sort_keys=True))
    return Snapshot(spark, folder, 0, settings)


def numbers(spark: SparkSession, folder: str) -> list[int]:
    fs, p = files._fs(spark, f"{folder}/snapshots")
    return sorted(int(f.getPath().getName().split(".")[0]) for f in fs.listStatus(p) if f.getPath().getName().endswith(".json"))


def open_snapshot(spark: SparkSession, folder: str, settings: dict, number: int | None = None) -> Snapshot:
    """The latest snapshot, or a given one; ValueError where it was made by other settings."""
    number = numbers(spark, folder)[-1] if number is None else number
    known = json.loads(files.read_text(spark, f"{folder}/snapshots/{number:09}.json"))
    files.check_basis(known["settings"], settings)
    return Snapshot(spark, folder, number, settings, known["segments"], known["deletions"])


def removable(spark: SparkSession, folder: str, settings: dict, oldest: int) -> list[str]:
    """Segments and deletions that no snapshot from number `oldest` on names."""
    kept = set()
    for n in numbers(spark, folder):
        if n >= oldest:
            found = open_snapshot(spark, folder, settings, n)
            kept |= {*found.segments, *found.deletions}
    fs, p = files._fs(spark, folder)
    return sorted(name for f in fs.listStatus(p) if (name := f.getPath().getName()).startswith(("segment-", "deletion-")) and name not in kept)


def bm25_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items ranked over an index of all documents from which those that are labelled toxic were deleted."""
    settings = {"k1": lexical.K1, "b": lexical.B, "tokenizer": "words"}
    docs = lexical.documents(spread(table(spark, sf_dir, "documents")), "doc_id", F.col("text"))
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("doc"))
    at = create(spark, f"{shared_dir(spark)}/bm25-{uuid.uuid4().hex}", settings).add(docs).delete(toxic)
    asked = lexical.query_terms(table(spark, sf_dir, "benchmark"), "item_id", F.col("text"))
    return lexical.best(at.index(asked.select("term").distinct()), asked, 10).select(F.col("query").alias("item_id"), F.col("doc").alias("doc_id"), "score", "rank")


QUERIES = {"bm25_segments": bm25_segments}
ORACLES = {"bm25_segments": f"""with {lexical.run_ctes().replace("as toks from documents)", "as toks from documents where doc_id not in (select doc_id from labels where toxic = 1))")} select item_id, doc_id, score, rank from run"""}
