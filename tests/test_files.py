"""Sources, guarded writes, fingerprints, outside models."""

import json
import zipfile

import pytest

from ledgerline.operators import external
from ledgerline.sources import files


def test_labels(spark, tmp_path):
    folder = tmp_path / "Training" / "x"
    folder.mkdir(parents=True)
    (tmp_path / "Validation").mkdir()
    for name in ("TL_1.zip", "OTHER.zip"):
        with zipfile.ZipFile(folder / name, "w") as z:
            z.writestr("a/LAB_1.json", json.dumps({"id": "007", "q": {"comment": "c"}}))
            z.writestr("a/readme.txt", "x")
    with zipfile.ZipFile(tmp_path / "Validation" / "VL_1.zip", "w") as z:
        z.writestr("LAB_2.json", json.dumps({"id": "8"}))
    rows = files.labels(spark, str(tmp_path), "id string, q struct<comment: string>").collect()
    assert sorted((r.split, r.record.id) for r in rows) == [("Training", "007"), ("Validation", "8")]


def test_json_lines(spark, tmp_path):
    good = tmp_path / "good.jsonl"
    good.write_text('{"a": "01"}\n\n{"a": "2"}\n')
    assert [r.a for r in files.json_lines(spark, str(good), "a string").collect()] == ["01", "2"]
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"a": "01"}\n{"a": ')
    with pytest.raises(Exception, match="(?i)malformed"):
        files.json_lines(spark, str(bad), "a string").collect()


def test_runs(spark, tmp_path):
    df = spark.createDataFrame([("01", 1, "d"), ("01", 2, "e")], files.RUN_SCHEMA)
    files.write_run(df, str(tmp_path / "run"))
    assert files.run_file(spark, str(tmp_path / "run")).orderBy("rank").collect() == df.collect()


def test_guards(spark, tmp_path):
    path = str(tmp_path / "x.txt")
    assert files.write_guarded(spark, path, "é") is True and files.write_guarded(spark, path, "é") is False
    with pytest.raises(FileExistsError):
        files.write_guarded(spark, path, "other")
    assert files.write_guarded(spark, path, "other", overwrite=True) and files.write_new(spark, path, "z") is False
    with pytest.raises(FileExistsError):
        files.refuse_existing(spark, path)
    with pytest.raises(ValueError, match="size"):
        files.check_basis({"size": 1, "more": 2}, {"size": 2})
    files.check_basis({"size": 1, "more": 2}, {"size": 1})


def test_basis_and_append(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "qid string, n int")
    files.with_basis(df, str(tmp_path / "t"), {"v": 1})
    assert files.read_basis(spark, str(tmp_path / "t"), {"v": 1}).count() == 2
    with pytest.raises(ValueError):
        files.read_basis(spark, str(tmp_path / "t"), {"v": 2})
    more = spark.createDataFrame([("b", 2), ("c", 3)], "qid string, n int")
    out = str(tmp_path / "u")
    assert files.append_missing(spark, df, out, "qid", {"v": 1, "git": "x"}) == 2
    assert files.append_missing(spark, more, out, "qid", {"v": 1, "git": "y"}) == 1
    with pytest.raises(ValueError):
        files.append_missing(spark, more, out, "qid", {"v": 3})


def test_freeze_and_order(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "qid string, n int")
    kept, digest = files.freeze(df, "qid", ["b"])
    assert [r.qid for r in kept.orderBy("qid").collect()] == ["a", "c"] and digest == files.table_digest(kept.repartition(3))
    with pytest.raises(KeyError):
        files.freeze(df, "qid", ["z"])
    assert [r.qid for r in files.in_order(df, ["c", "a"]).collect()] == ["c", "a"]
    with pytest.raises(KeyError):
        files.in_order(df, ["c", "z"]).collect()


def test_models(spark):
    asked = spark.createDataFrame([("k1", "one"), ("k2", "two"), ("k2", "two")], "key string, body string")
    cache = spark.createDataFrame([("k1", '{"kept": true}')], "key string, reply string")
    rows = {r.key: r for r in external.ask(asked, cache, lambda body: '{"new": 1}' if body == "two" else "bad").collect()}
    assert rows["k1"].reply == '{"kept": true}' and rows["k2"].reply == '{"new": 1}' and len(rows) == 2
    failed = external.ask(asked, None, lambda body: "[1]").collect()
    assert [(r.reply, r.error) for r in failed] == [(None, "format")] * 2
    queries = spark.createDataFrame([(1, "what is the budget"), (2, "a b")], "qid int, query string")
    assert {r.qid: r.rewritten for r in external.rewrite(queries).collect()} == {1: "what budget", 2: "a b"}


def test_indexes(spark, tmp_path):
    from ledgerline.sources import indexes

    chunks = spark.createDataFrame([(0, "d", "x y"), (1, "e", "z")], "chunk_id bigint, doc_id string, text string")
    path = str(tmp_path / "v")
    assert indexes.embed_shards(chunks, path, external.embed_stub, 3, {"m": 1}) == 3
    assert indexes.embed_shards(chunks, path, external.embed_stub, 3, {"m": 1}) == 0
    with pytest.raises(ValueError):
        indexes.embed_shards(chunks, path, external.embed_stub, 3, {"m": 2})
    v = indexes.vectors(spark, path, 2)
    assert indexes.stacked([(chunks, v), (chunks, v)]).groupBy("index_no").count().count() == 2
    with pytest.raises(Exception, match="no pair"):
        indexes.stacked([(chunks, v.where("chunk_id = 0"))]).collect()
    assert indexes.unpacked(indexes.packed({"a": ["é", 1]})) == {"a": ["é", 1]}
