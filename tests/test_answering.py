"""Views, reports, the answering plan, settings and commands on hand-made cases."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline import __main__ as commands
from ledgerline import config
from ledgerline.operators import metrics, reports, views
from ledgerline.plans import answering
from ledgerline.sources import files, indexes

V = None


@pytest.fixture(scope="module", autouse=True)
def column(spark):
    global V
    V = F.col("v")


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column.alias("x")).first().x


def test_names(spark):
    assert one(spark, views.shown_date(V), "2000年6月28日(水)") == "2000년 6월 28일(수)"
    assert one(spark, views.shown_date(V), "2024.2.30") == "2024.2.30" and one(spark, views.shown_date(V), "soon") == "soon"
    name = lambda kind: views.doc_name(V, F.lit("위원회"), F.lit(kind), F.lit("제1회"), F.lit("제2차"))
    assert one(spark, name("국정감사"), "2021-01-04") == "2021년 1월 4일(월) 위원회 국정감사"
    assert one(spark, name(None), "2021-01-04") == "2021년 1월 4일(월) 위원회 제1회 제2차"
    docs = spark.createDataFrame([("m", 1, "x"), ("m", 2, "x"), ("n", 1, "y")], "conf string, no int, name string")
    assert sorted(r.name for r in views.siblings(docs, "conf", "no", "name").collect()) == ["x #1", "x #2", "y"]


def test_listings(spark):
    rows = [("a", "2020-01-02", "p"), ("a", "2020-03-01", "q"), ("b", "2020-01-02", "p"), ("c", "2021-05-05", "p")]
    docs = spark.createDataFrame(rows, "conf string, d string, name string").withColumn("d", F.col("d").cast("date"))
    assert [r.year for r in views.years(docs, "d").collect()] == [2021, 2020]
    assert [(r.conf, r.name) for r in views.meetings(docs, "d", "conf", "name").collect()] == [("c", "p"), ("b", "p (b)"), ("a", "p (a)")]
    assert [r.name for r in views.fetch(docs, "conf", ["c", "b"]).orderBy("ord").collect()] == ["p", "p"]


def test_places_and_blocks(spark):
    assert tuple(one(spark, views.place(V, F.lit("bc")), "abcbc")) == (1, 3) and one(spark, views.place(V, F.lit("x")), "abc") is None
    assert one(spark, views.marked(V, views.place(V, F.lit("b")), ("in", "out")), "abc") == "a\n\n**in**\n\nb\n\n**out**\n\nc"
    assert one(spark, views.marked(V, views.place(V, F.lit("z")), ("in", "out")), "abc") == "abc"
    assert one(spark, views.meta_line({"a": V, "b": F.lit(""), "c": F.lit(None).cast("string"), "d": F.lit(7)}, {"a": 3}), "abcdef") == "a: abc… | d: 7"
    assert one(spark, views.doc_block(F.lit("head"), V, 9), "One two. Three.") == "head\n\nOne two.\nThree."
    assert one(spark, views.agenda_items(V), "1. 가법안(갑 의원 발의) 2. 나법안 10. 다") == ["1. 가법안", "2. 나법안", "10. 다"]
    assert one(spark, views.scope_target(V, "law", "a|b"), "law b") is True and one(spark, views.scope_target(V, "law", "a|b"), "lw b") is False
    assert one(spark, views.doc_heads(V), "[1] one\nno\n[2] two\n[1] again") == {1: "again", 2: "two"}
    assert one(spark, views.chunk_row([5, 7, 2], V, F.lit(1)), 2, "int") == 13


def test_answers_and_contexts(spark):
    assert one(spark, views.no_citation(V, "no idea"), "A b. I have no idea.") is True
    assert one(spark, views.no_citation(V, "no idea"), "I have no idea.") is False and one(spark, views.no_citation(V, "no idea"), "A [1].") is False
    ctx = F.array(F.struct(F.lit(1).alias("n"), F.array(F.lit("Ann"), F.lit("Bo")).alias("names")), F.struct(F.lit(2).alias("n"), F.array(F.lit("Cy")).alias("names")))
    assert one(spark, views.speakers_named(V, ctx), "Bo and Cy said so [1].") == ["Bo"]
    split = one(spark, views.cited_split(V, F.lit(4)), "x [3]. y [1] [9]")
    assert sorted(split.cited) == [1, 3] and split.uncited == [2, 4]
    assert one(spark, views.paragraphs(V), "a\n\n b\nc \n \n") == ["a", "b\nc"]
    statements = spark.createDataFrame([("q", "u", "rain fell"), ("q", "w", "sun")], "qid string, uid string, text string")
    contexts = spark.createDataFrame([("q", 1, "All fine. The sun rose."), ("q", 2, "Then rain fell hard.")], "qid string, n int, text string")
    assert {r.uid: (r.n, r.hint) for r in views.hints(statements, contexts).collect()} == {"u": (2, "Then rain fell hard."), "w": (1, "The sun rose.")}
    rows = spark.createDataFrame([(1, "2020-01-06", "c", "m", "o", "d", "xx bc", "bc", "hidden")], "n int, date string, committee_name string, meeting_name string, original string, doc_id string, doc_text string, text string, split string")
    paid = views.context_payload(rows).first()
    assert (paid.start, paid.end, paid.date) == (3, 5, "2020년 1월 6일(월)") and "split" not in paid.asDict() and "doc_text" not in paid.asDict()


def test_pools(spark):
    pools = spark.createDataFrame([("p", "law", 0, ["a", "b"]), ("q", "law", 1, ["c"])], "pool_id string, type string, order int, doc_ids array<string>")
    docs = spark.createDataFrame([(x,) for x in "abd"], "doc_id string")
    speakers = spark.createDataFrame([("a", ["x"])], "doc_id string, speakers array<string>")
    assert {r.doc_id: r.speakers for r in views.pool_docs(pools, docs, speakers).collect()} == {"a": ["x"], "b": []}
    assert [r.pool_id for r in views.first_pools(pools, 1).collect()] == ["p"]


def test_blind(spark):
    schema = "qid string, items array<struct<item: string, state: string, handling: string, outcome: string>>, verdicts array<struct<statement: string, verdict: int>>, checks array<struct<statement: string, present: int>>, label string"
    rows = [("q", [("i", "present", "refused", "over_refusal")], [("s", 1), ("t", 0)], None, "good"), ("r", None, None, [("k", 1)], None)]
    units = reports.blind_units(spark.createDataFrame(rows, schema))
    assert sorted((r.qid, r.uid, r.judge) for r in units.collect()) == [("q", "faith0", "supported"), ("q", "faith1", "not"), ("q", "handling0", "refused"), ("q", "relevance", "good"), ("q", "state0", "present"), ("r", "inclusion0", "present")]
    assert {r.qid: r.failures for r in reports.unit_failures(units, {"faith": ["not"]}).collect()} == {"q": 2, "r": 0}
    pairs = [(f"q{i % 6}", "yes" if i % 3 else "no", "yes" if i % 4 else "no") for i in range(48)]
    out = reports.blind_stats(spark.createDataFrame(pairs, "qid string, person string, judge string"), ["no"], 300)
    a = np.array([[sum(p == x and j == y for _, p, j in pairs) for y in ("no", "yes")] for x in ("no", "yes")])
    chance = sum(a[i].sum() * a[:, i].sum() for i in (0, 1)) / 48**2
    assert out["n"] == 48 and out["queries"] == 6 and out["tpr"] == (a[0, 0], a[0].sum()) and out["tnr"] == (a[1, 1], a[1].sum())
    assert abs(out["kappa"] - ((np.trace(a) / 48 - chance) / (1 - chance))) < 1e-12 and out["kappa_ci"][0] <= out["kappa"] <= out["kappa_ci"][1]
    same = reports.blind_stats(spark.createDataFrame([("q", "x", "x")], "qid string, person string, judge string"))
    assert same["agreement"] == 1.0 and np.isnan(same["kappa"])
    verdicts = F.from_json(V, "array<struct<reason: string>>")
    assert one(spark, reports.speaker_mismatch(verdicts, "speaker:"), '[{"reason": "speaker: no"}, {"reason": "fine"}]') == 0.5


def test_bootstrap_in_strips(spark, monkeypatch):
    clusters = metrics.cluster_sums(spark.createDataFrame([(f"c{i % 9}", i % 4 / 2) for i in range(60)], "cluster string, diff double"))
    whole = metrics.bootstrap(clusters, 400)
    monkeypatch.setattr(metrics, "PICKS", 50)
    assert metrics.bootstrap(clusters, 400) == whole


def test_contexts_widen(spark):
    every = spark.createDataFrame([(i, i // 3, [float(i % 3 == 1), 1.0]) for i in range(9)], "chunk bigint, doc bigint, v array<double>")
    asked = spark.createDataFrame([(50, [1.0, 0.0])], "query bigint, qv array<double>")
    ranked = spark.createDataFrame([(50, 2, 1), (50, 0, 2), (50, 1, 3)], "query bigint, doc bigint, rank int")
    got = {r.n: (r.doc, r.chunk, r.first, r["last"]) for r in answering.contexts(ranked, every, asked, 2, 1).collect()}
    assert got == {1: (2, 7, 6, 8), 2: (0, 1, 1, 1)}


def test_second_scores(spark):
    fused = spark.createDataFrame([("q", "a", 1, 10), ("q", "b", 2, 11), ("q", "c", 3, 12)], "query string, doc string, rank int, chunk int")
    queries = spark.createDataFrame([("q", "red fish")], "query string, text string")
    texts = spark.createDataFrame([(10, "blue"), (11, "red fish"), (12, "red")], "chunk int, text string")
    assert {r.doc: r.second for r in answering.live_rerank(fused, queries, texts, 2).collect()} == {"a": 0.0, "b": 1.0}
    seen = []
    assert answering.live_rerank(fused, queries, texts, 2, lambda q, t: 1 / 0, seen.append) is None and len(seen) == 1


def test_second_pass(spark):
    first = spark.createDataFrame([(1, "a", 1), (2, "a", 1), (3, "a", 1)], "query int, doc string, rank int")
    rewrites = spark.createDataFrame([(1, "new"), (2, None), (3, " ")], "query int, rewritten string")
    out = answering.second_pass(first, rewrites, lambda valid: valid.select("query", F.lit("z").alias("doc"), F.lit(1).alias("rank")))
    assert {r.query: r.doc for r in out.collect()} == {1: "z", 2: "a", 3: "a"}


def test_generate(spark):
    def model(prompt):
        if prompt == "bad":
            raise RuntimeError("down")
        return {"text": "<think>hm</think>- Yes [1].", "finish": "length"} if prompt == "cut" else "Plain."

    asked = spark.createDataFrame([("a", "cut"), ("b", "bad"), ("c", "x")], "qid string, prompt string")
    got = {r.qid: (r.answer, r.thought, r.finish, r.error) for r in answering.generate(asked, model, True).collect()}
    assert got == {"a": ("Yes [1].", "hm", "length", None), "b": (None, "", None, "RuntimeError: down"), "c": ("Plain.", "", "stop", None)}


@pytest.mark.parametrize(("text", "want"), [("<think>a</think> Yes.", "Yes."), ("No mark.", "No mark."), ("<think>never", ""), ("<th", "<th"), ("a <think>b</think>", "a <think>b</think>"), ("<think></think>\n\nYes", "Yes")])
def test_answered_by_pieces(text, want):
    for n in range(1, len(text) + 1):
        assert "".join(answering.answered(text[i : i + n] for i in range(0, len(text), n))) == want


def test_chat_turn():
    calls = []

    def retrieve(search, rows):
        calls.append((search, rows))
        return [{"n": 1, "chunk": 41, "secret": 1}, {"n": 2, "chunk": 42, "secret": 2}]

    rewrite = answering.follow_up(lambda m, t: f"{m} fully\nmore", lambda m, t: 0.9)
    chat = answering.Chat(retrieve, lambda m, c, h: ["<think>x</think>", "Old word", " [2]."], rewrite, payload=lambda c: {"n": c["n"]}, words={"Old": "New"}, reuse="decision", most_chars=20)
    events = list(answering.chat_turn(chat, "Why?", [{"question": "a", "answer": "b"}], [7]))
    assert calls == [("Why? fully", [7])] and events[-1]["done"] and not any(e["done"] for e in events[:-1])
    assert (events[-1]["text"], events[-1]["raw"], events[-1]["rows"], events[-1]["contexts"]) == ("New word [2].", "Old word [2].", [42], [{"n": 1}, {"n": 2}])
    assert list(answering.chat_turn(chat, "  ")) == [] and len(calls) == 1
    assert [e["text"] for e in answering.chat_turn(chat, "x" * 21)] == [chat.too_long] and len(calls) == 1
    chat.limit = lambda: "later"
    assert [e["text"] for e in answering.chat_turn(chat, "x")] == ["later"] and len(calls) == 1
    with pytest.raises(ValueError):
        answering.Chat(retrieve, chat.stream, reuse="other")


def test_follow_up_falls_back():
    ask = answering.follow_up(lambda m, t: 1 / 0, lambda m, t: 1 / 0)
    assert ask("q", []) == ("q", {"rewrite": "ZeroDivisionError", "decision": "ZeroDivisionError", "needs_earlier": False})
    assert answering.follow_up(lambda m, t: "")("q", []) == ("q", {"rewrite": "invalid"})
    assert answering.follow_up(lambda m, t: "x" * 400)("q", [])[0] == "q"


def test_judged_records(spark):
    ctx = [("1", "d1", "2020-01-01", "c", "text one")]
    rows = [("a", "ask", "Said so [1].", "ref", ctx, "d1"), ("b", "ask", "I have no answer.", "ref", ctx, "d9"), ("c", "ask", "Said so [1].", "ref", ctx, "d1")]
    records = spark.createDataFrame(rows, "qid string, query string, answer string, reference string, contexts array<struct<n: string, doc_id: string, date: string, committee_name: string, text: string>>, gold string")
    checked = answering.record_checks(records, "no answer", [], [])
    got = {r.qid: r for r in checked.collect()}
    assert (got["a"].gold_n, got["a"].refusal, got["a"].citations.uncited) == (1, None, 0) and (got["b"].gold_n, got["b"].refusal, got["b"].citations) == (None, "full", None)
    prompt = {s: f"do {s}" for s in answering.STEPS}

    def model(body):
        step = json.loads(body)["step"]
        return None if step == "relevance" else json.dumps({"step": step})

    out = {r.qid: r for r in answering.judge_records(checked, prompt, model).collect()}
    assert set(out["a"].replies) == {"faithfulness", "key_statements"} and out["a"].errors == {"relevance": "format"} and out["b"].replies is None
    assert answering.judge_requests(checked, prompt).select("key").distinct().count() == 3  # a and c ask the same
    answering.check_steps(prompt)
    with pytest.raises(ValueError, match="items"):
        answering.check_steps(prompt, True)
    assert answering.latency(list(range(9)), 1, 4, lambda k: None)["n"] == 4 and answering.latency([1], 1, 4, lambda k: None) == {"n": 0}


def test_settings(monkeypatch):
    monkeypatch.setenv("LEDGER_TEST", "x")
    base = {"a": {"b": 1, "c": "${a.b}"}, "d": "v-${a.c}-${env:LEDGER_TEST}"}
    assert config.load(base, ["a.b=2", "+e.f=[1]"]) == {"a": {"b": 2, "c": 2}, "d": "v-2-x", "e": {"f": [1]}}
    for wrong, error in ((["a.x=1"], KeyError), (["a"], ValueError), (['a.b="${a.c}"'], ValueError), (['a.b="${env:NO_SUCH}"'], KeyError)):
        with pytest.raises(error):
            config.load(base, wrong)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 0.5), ("b", 2, None)], "qid string, n int, x double")
    files.export(df, str(tmp_path / "e"), ["qid"], {"k": 1})
    assert spark.read.json(str(tmp_path / "e")).columns == ["qid"] and json.loads(files.read_text(spark, str(tmp_path / "e.basis.json"))) == {"k": 1}
    with pytest.raises(FileExistsError):
        files.export(df, str(tmp_path / "e"), ["qid"])
    files.review_csv(spark, str(tmp_path / "r.csv"), ["a", "b"], [["x, y", 1]])
    assert (tmp_path / "r.csv").read_bytes() == '﻿a,b\n"x, y",1\n'.encode()
    assert files.markdown(df, 2) == "| qid | n | x |\n| --- | --- | --- |\n| a | 1 | 0.50 |\n| b | 2 |  |\n"
    assert files.save_record(spark, str(tmp_path), {"a": 1}) == files.save_record(spark, str(tmp_path), {"a": 1})
    files.check_frozen(df, files.table_digest(df))
    with pytest.raises(ValueError):
        files.check_frozen(df.limit(1), files.table_digest(df))
    assert [r.n for r in files.query_set({"dev": df}, "dev", ["b", "a"]).collect()] == [2, 1]
    assert [r.qid for r in files.references(df, ["b", "a"], ["b"]).collect()] == ["a"]
    with pytest.raises(KeyError, match="1 missing, such as z"):
        files.in_order(df, ["a", "z"])
    with pytest.raises(ValueError):
        files.query_set({"dev": df}, "test")


def test_index_building(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id int, text string")
    cut = lambda d: d.select(F.xxhash64("doc_id").alias("chunk_id"), "doc_id", F.explode(F.split("text", " ")).alias("text")).withColumn("chunk_id", F.xxhash64("chunk_id", "text"))
    model = lambda texts: [[float(len(t))] for t in texts]
    path = str(tmp_path / "i")
    first = indexes.build(docs, path, cut, model, {"size": 1}, 2)
    assert (first["n_chunks"], first["n_docs"]) == (3, 2) and indexes.build(docs, path, cut, model, {"size": 1}, 2) == first
    with pytest.raises(ValueError, match="size"):
        indexes.build(docs, path, cut, model, {"size": 2}, 2)
    a = spark.createDataFrame([(1,), (2,)], "chunk_id int")
    assert indexes.zipped(a, a.withColumn("s", F.lit(1))).count() == 2
    with pytest.raises(ValueError):
        indexes.zipped(a, a.limit(1))


def test_commands(spark, tmp_path, capsys):
    at = lambda name: str(tmp_path / name)
    docs = [("d1", "The red fox ran. It was late.", "en", "s"), ("d2", "A blue fish swam.", "en", "t"), ("d3", "Rain fell.", "fr", "s")]
    spark.createDataFrame(docs, "doc_id string, text string, lang string, source string").write.parquet(at("corpus.parquet"))
    spark.createDataFrame([("q1", "red fox"), ("q2", "blue fish")], "qid string, query string").write.parquet(at("queries.parquet"))
    spark.createDataFrame([("q1", "d1"), ("q2", "d2")], "qid string, doc_id string").write.parquet(at("gold.parquet"))
    run = lambda name, out, *more: commands.main([name, f"data={tmp_path}", f"out={at(out)}", *more], spark) or spark.read.parquet(at(out))
    assert run("index", "made").first().n_docs == 3
    found = run("search", "run.parquet")
    assert {(r.qid, r.doc_id) for r in found.where("rank = 1").collect()} == {("q1", "d1"), ("q2", "d2")}
    with pytest.raises(FileExistsError):
        run("search", "run.parquet")
    assert run("rerank", "second", f"run={at('run.parquet')}").where("score = 1.0").count() == 2
    scored = run("score", "score", f"run={at('run.parquet')}", f"gold={at('gold.parquet')}").first()
    assert scored.n == 2 and scored.mrr_10 == 1.0
    assert run("compare", "compare", f"run={at('run.parquet')}", f"base={at('run.parquet')}", f"gold={at('gold.parquet')}").first().mean == 0.0
    assert run("meta-dict", "dict").where("field = 'source' and value = 's'").first().docs == 2
    assert run("conditions", "conditions").count() == 2
    assert run("freeze", "frozen", f"records={at('gold.parquet')}", "key=qid", 'excluded=["q2"]').count() == 1 and (tmp_path / "frozen.sha256").exists()
    assert commands.main(["other"]) == 2 and "search" in capsys.readouterr().out
