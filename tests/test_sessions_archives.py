"""Transducers over streams, and label archives read by ranges of their directories."""

import json
import random
import time
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerline.functions.transducers import LeadMover, WordReplacer, whole
from ledgerline.sources import archives, files
from ledgerline.streaming import sessions

WORDS = {"ab": "X", "abc": "YY", "hello": "bye"}


def make():
    return WordReplacer(WORDS)


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    sessions.with_timers(spark)
    yield spark
    spark.conf.set(key, before)


class Running:
    """A query over a folder of pieces, and what it has given so far."""

    def __init__(self, spark, folder, maker, idle):
        self.spark, self.folder, self.got, self.n = spark, folder, [], 0
        (folder / "in").mkdir()
        stream = spark.readStream.schema("session string, seq bigint, text string, last boolean").option("recursiveFileLookup", "true").parquet(str(folder / "in"))
        out = sessions.transduced_stream(stream, maker, idle)
        self.query = out.writeStream.foreachBatch(lambda df, _: self.got.extend(df.collect())).outputMode("append").option("checkpointLocation", str(folder / "check")).start()

    def add(self, rows):
        self.spark.createDataFrame(rows, "session string, seq bigint, text string, last boolean").coalesce(1).write.parquet(str(self.folder / "in" / str(self.n)))
        self.n += 1

    def wait(self, done):
        until = time.time() + 60
        while not done(self.got) and time.time() < until and self.query.exception() is None:
            time.sleep(0.2)
        assert self.query.exception() is None and done(self.got)


def said(got, session):
    return "".join(r.text for r in sorted((r for r in got if r.session == session), key=lambda r: (r.seq is None, r.seq)))


@pytest.mark.parametrize("maker", [make, LeadMover])
def test_stream_of_pieces(rocks, tmp_path, maker):
    """Random pieces over several micro-batches, in any order within one."""
    rng = random.Random(4)
    lead = "2019년 3월 5일 국방위원회 회의에서 말했다 [1]. 3.5 그리고"
    texts = {f"s{i}": "".join(rng.choice(["ab", "c", "abc ", "hel", "lo", ". ", "x", lead]) for _ in range(rng.randint(1, 25))) for i in range(12)}
    batches = [[], [], []]
    for s, text in texts.items():
        cuts = sorted(rng.randrange(len(text) + 1) for _ in range(6))
        for seq, (i, j) in enumerate(zip([0, *cuts], [*cuts, len(text)])):
            batches[seq * 3 // 7].append((s, seq, text[i:j] or None, seq == 6))
    run = Running(rocks, tmp_path, maker, 1000.0)
    try:
        for k, rows in enumerate(batches):
            rng.shuffle(rows)
            run.add(rows)
            run.wait(lambda got: len(got) >= sum(map(len, batches[: k + 1])))
    finally:
        run.query.stop()
    assert {s: said(run.got, s) for s in texts} == {s: whole(maker, t) for s, t in texts.items()}
    assert sum(r.ended for r in run.got) == len(texts) and len(run.got) == 7 * len(texts)


def test_idle_sessions_are_flushed(rocks, tmp_path):
    run = Running(rocks, tmp_path, make, 0.5)
    try:
        run.add([("a", 0, "x he", False), ("b", 0, "hel", False), ("b", 1, "lo", True)])
        run.wait(lambda got: len(got) >= 4)
        run.add([("a", 0, "llo", True)])  # the session began anew
        run.wait(lambda got: len(got) >= 5)
    finally:
        run.query.stop()
    assert sorted((r.session, -1 if r.seq is None else r.seq, r.text, r.ended) for r in run.got) == [("a", -1, "he", True), ("a", 0, "llo", True), ("a", 0, "x ", False), ("b", 0, "", False), ("b", 1, "bye", True)]


def archive(path, n, prefix="LAB_"):
    path.parent.mkdir(parents=True, exist_ok=True)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for i in range(n):
            z.writestr(f"dir/{prefix}{i:05}.json", json.dumps({"id": f"{path.stem}-{i}", "q": {"comment": "é" * (i % 7)}}, ensure_ascii=False))
        z.writestr("dir/README.txt", "no record")


def test_archives(spark, tmp_path):
    archive(tmp_path / "Training" / "TL_1.zip", 10_000)
    archive(tmp_path / "Training" / "deep" / "TL_2.zip", 3)
    archive(tmp_path / "Training" / "OTHER.zip", 5)
    archive(tmp_path / "Validation" / "VL_1.zip", 4)
    archive(tmp_path / "Validation" / "VL_0.zip", 0, "none")
    schema = "id string, q struct<comment: string>"
    got = archives.labels(spark, str(tmp_path), schema, bytes=100_000)
    assert got.where("archive = 'TL_1.zip'").select(F.spark_partition_id()).distinct().count() > 4
    key = lambda df: sorted((r.split, r.record.id, r.record.q.comment) for r in df.collect())
    assert key(got) == key(files.labels(spark, str(tmp_path), schema)) and len(key(got)) == 10_007
    some = archives.members(spark, str(tmp_path), splits="Validation=VL_", archives="VL_1.zip,TL_1.zip")
    assert sorted(r.member for r in some.collect()) == [f"dir/LAB_{i:05}.json" for i in range(4)]
    assert archives.members(spark, str(tmp_path), records="false").where("json is null").count() == 10_007
    assert archives.members(spark, str(tmp_path / "nothing")).count() == 0


def test_archives_that_are_not_chosen_stay_unopened(tmp_path):
    archive(tmp_path / "Training" / "TL_1.zip", 3)
    (tmp_path / "Validation").mkdir()
    (tmp_path / "Validation" / "VL_broken.zip").write_bytes(b"no archive")
    for options in ({"splits": "Training=TL_"}, {"archives": "TL_1.zip"}):
        assert [(p.split, p.first, p.last) for p in archives.Reader({"path": str(tmp_path), **options}).partitions()] == [("Training", 0, 4)]
    with pytest.raises((zipfile.BadZipFile, pa.ArrowInvalid)):
        archives.Reader({"path": str(tmp_path)}).partitions()
