"""Hand-computed cases of text functions, chunks, spans, answers, transducers and state."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import text as T
from ledgerline.functions.transducers import LeadMover, WordReplacer, whole
from ledgerline.operators import answers, chunking, conditions, corpus, pools, spans
from ledgerline.streaming import limits


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column.alias("x")).first().x


V = None


@pytest.fixture(scope="module", autouse=True)
def column(spark):
    global V
    V = F.col("v")


def test_sentences(spark):
    cases = {
        "One. Two! [1]\nThree?": ["One.", "Two! [1]", "Three?"],
        "1. First [2]. [3] Next": ["1. First [2].", "[3] Next"],
        "Say it.\n[1]\nMore": ["Say it. [1]", "More"],
        "": [],
        "- a\n* b": ["- a", "* b"],
    }
    for text, want in cases.items():
        assert one(spark, T.sentences(V), text) == want, text
    assert one(spark, T.sentences(V), "Say it.\n[1]\nMore") == ["Say it. [1]", "More"]
    assert one(spark, T.sentences(V), "1.\nFirst") == ["1. First"]


def test_citations(spark):
    r = one(spark, T.citation_check(V, F.lit(5), []), "A [1]. B [7]. C.")
    assert (r.n_sentences, r.invalid, r.uncited, r.filler) == (3, [7], 1, 0)


def test_refusal(spark):
    check = lambda text: one(spark, T.refusal(V, "no answer", ["Hello"], ["can not", "say"]), text)
    assert check("I have noanswer. Hello there.").kind == "full"
    assert check("I have no answer. But this is known.").kind == "partial"
    assert check("All fine.").kind is None and check("All fine.").rest == "All fine."
    assert check("I cannot say. Known.").rest == "Known."
    assert one(spark, T.unlisted_refusal(V, "no answer", ["can not", "say"]), "I cannot say.")
    assert one(spark, T.has_parts(V, []), "x") is False


def test_names(spark):
    name = T.person_name(V, ["위원", "장관"])
    for raw, want in {"홍길동 위원": "홍길동", "조달청장 홍길동": "홍길동", "홍길동(비)": "홍길동", "홍길동 위": "홍길동", "홍길동": "홍길동"}.items():
        assert one(spark, name, raw) == want


def test_dates(spark):
    assert one(spark, conditions.dates(V), "2019년 3월 5일, '98년 12월과 2020년도") == ["2019-03-05", "1998-12"]
    assert one(spark, conditions.year_refs(V), "2019년도 예산안과 '18회계연도") == ["2019", "2018"]
    assert one(spark, T.doc_date(V), "2001年 9月 18日") == "2001-09-18"
    assert one(spark, T.full_year(F.lit(""), V), "31") == "1931"


def test_extractor(spark):
    values = [("committee_name", "국방위원회-제1반"), ("committee_name", "법제사법위원회"), ("meeting_name", "국정감사"), ("names", "홍길동"), ("names", "통일부장관"), ("names", "홍길"), ("law", "민법"), ("names", None)]
    known = conditions.entries(spark.createDataFrame(values, "field string, value string"), ["위원", "장관"], ["은", "이"], aliases={"법사위": ["법제사법위원회"]})
    texts = [
        (1, "제21대 국회 제380회 제2차 국방위 국정감사에서 홍길동 위원이 말한 민 법과 법사위"), (2, "nothing"), (3, None), (4, ""),
        (5, "김홍길동 홍길동가 홍길동은 홍길 통일부장관"), (6, "국민법 민ㆍ법"),
    ]
    got = {r.k: r.conditions for r in conditions.extract(spark.createDataFrame(texts, "k int, text string"), "k", known).collect()}
    assert got[1] == {"generation_number": ["21"], "meeting_number": ["제380회"], "session_number": ["제2차"], "committee_name": ["국방위원회", "법제사법위원회"], "meeting_name": ["국정감사"], "names": ["홍길동"], "law": ["민법"]}
    assert got[2] == {} and got[4] == {} and not got[3]
    assert got[5] == {"names": ["홍길동", "홍길"]} and got[6] == {"law": ["민법"]}
    plain = conditions.extract(spark.createDataFrame(texts[:2], "k int, text string"), "k").collect()
    assert {r.k: set(r.conditions) for r in plain} == {1: {"generation_number", "meeting_number", "session_number"}, 2: set()}
    assert one(spark, F.size(conditions.agenda_laws(V)), "1. 국가재정법 일부개정법률안 2. 도로교통법안") == 2


def test_condition_ranking(spark):
    counts = spark.createDataFrame([(0, "k", 1), (0, "m", 3), (0, "n", 3), (0, "o", 2), (0, "p", 3), (0, "r", 2)], "query int, doc string, matches int")
    scores = spark.createDataFrame([("k", 9.0), ("m", 2.0), ("n", 5.0), ("o", 1.0), ("p", 5.0)], "doc string, score double")
    got = conditions.ranked(counts.where("matches >= 2").join(scores, "doc", "left"), 4).orderBy("rank").collect()
    assert [r.doc for r in got] == ["n", "p", "m", "o"]  # r has no score, k too few matches


def test_year_offset_is_its_own_field(spark):
    index = spark.createDataFrame([(1, "date", "2019"), (1, "nation", "x"), (2, "date", "2022")], "doc int, field string, value string")
    asked = spark.createDataFrame([(0, "date", "2019"), (0, "year_ref", "2020"), (0, "nation", "x"), (0, "nation", "y")], "query int, field string, value string")
    assert {r.doc: r.matches for r in conditions.match_counts(index, asked).collect()} == {1: 3}


def test_scalars(spark):
    assert one(spark, T.collapsed(V), " a　 b ") == "a b"
    assert one(spark, T.pause_seconds(V), "1h2m3.5s") == 3723.5
    assert one(spark, T.first_line(V, 5), "\n abc \nd") == "abc" and one(spark, T.first_line(V, 2), "abc") is None
    assert one(spark, T.json_object(V), '```json\n{"a": 1}\n```') == '{"a": 1}' and one(spark, T.json_object(V), "[1]") is None
    assert one(spark, T.forwarded_ip(V, F.lit("f")), "1.1.1.1, 2.2.2.2") == "2.2.2.2"
    assert one(spark, T.split_thought(V), "<think>why</think> so")["answer"] == "so"
    assert one(spark, T.split_thought(V), "<think>why")["answer"] == ""
    assert one(spark, T.strip_lone_bullet(V), "- a\nb") == "a\nb" and one(spark, T.strip_lone_bullet(V), "- a\n- b") == "- a\n- b"
    assert one(spark, T.found(F.lit("a  b"), V, F.lit(None).cast("double"), 0.9), "x a b") is True
    with pytest.raises(ValueError):
        T.replace_words(V, {"": "x"})


@pytest.mark.parametrize(("n", "size", "overlap"), [(10, 4, 2), (1, 4, 2), (4, 4, 0), (9, 4, 3), (100, 7, 2)])
def test_fixed_chunks(spark, n, size, overlap):
    df = spark.createDataFrame([(0, n)], "k int, n int")
    rows = chunking.fixed(df, "k", F.col("n"), size, overlap).orderBy("chunk_no").collect()
    assert rows[0].first == 0 and rows[-1]["last"] == n - 1 and all(r.n <= size for r in rows)
    assert all(b["first"] - a["first"] == size - overlap for a, b in zip(rows, rows[1:]))
    assert all(r["last"] < n - 1 for r in rows[:-1])
    with pytest.raises(ValueError):
        chunking.fixed(df, "k", F.col("n"), 4, 4)


def test_packing():
    units = [(0, 3), (3, 5), (5, 9), (9, 10)]
    assert chunking.pack_units(units, 5, 0) == [(0, 5), (5, 10)]
    assert chunking.pack_units(units, 5, 2) == [(0, 5), (3, 5), (5, 10)]
    assert chunking.pack_units(units, 6, 2) == [(0, 5), (3, 9), (9, 10)] and chunking.pack_units([], 6, 2) == []
    rng = random.Random(2)
    for _ in range(50):
        ends = [0]
        while len(ends) < 20:
            ends.append(ends[-1] + rng.randint(1, 7))
        got = chunking.pack_units(list(zip(ends, ends[1:])), 9, 4)
        assert got[0][0] == 0 and got[-1][1] == ends[-1] and all(b - a <= 9 for a, b in got)
        assert all(p[0] < q[0] <= p[1] <= q[1] and p[1] - q[0] <= 4 for p, q in zip(got, got[1:]))
    assert chunking.sentence_units([(0, 1), (2, 3), (5, 6)], [0, 4], 10) == [(0, 2), (2, 3)]
    assert chunking.token_batches([5, 1, 4], 8, 10) == [[0], [2, 1]]
    assert chunking.jobs([(5, 1), (5, 1), (1, 1)], 9, 5) == [[0], [1, 2]]
    with pytest.raises(ValueError):
        chunking.chunker("other")


def test_spans(spark):
    assert spans.occurrences("aXa" + "y" * 30 + "aXa", "aXa") == []
    assert spans.occurrences("aXaXa", "aXa", 1) == [(0, 3), (2, 5)]
    df = spark.createDataFrame([(1, 0, 5), (1, 3, 8), (1, 20, 22), (1, 4, 6)], "doc int, start int, end int")
    assert spans.covered(df, "doc").first().covered == 10
    assert spans.marked_up("abcd", [{"role": "q", "start": 0, "end": 2}, {"role": "a", "start": 2, "end": 4}]) == "<q>ab</q><a>cd</a>"


def test_outcomes(spark):
    want = {("partial", "explained"): "partial_unmarked", ("partial", "answered_partly"): "right", ("present", "answered_partly"): "needless_notice", ("partial", "refused"): "over_refusal", ("absent", "refused"): "right",
            ("absent", "answered_partly"): "unsupported", ("absent", "ignored"): "silent_omission", ("partial", "ignored"): "omitted", ("evasive", "explained"): "situation_told", ("unclear", "ignored"): "situation_untold", ("other", "answered"): None}
    df = spark.createDataFrame(list(want), "s string, h string").select("s", "h", answers.outcome(F.col("s"), F.col("h")).alias("o"))
    assert {(r.s, r.h): r.o for r in df.collect()} == want


def test_mismatches(spark):
    contexts = [(1, "2020-05-07", "교육위원회", "2020년 5월 1일에 접수"), (2, "2020-06-01", None, None)]
    df = spark.createDataFrame([(contexts,)], "c array<struct<n: int, date: string, committee_name: string, text: string>>")
    names = ["교육위원회", "국토교통위원회", "교통위원회"]

    def found(answer):
        return [tuple(x) for x in df.select(answers.mismatches(F.lit(answer), F.col("c"), names).alias("m")).first().m]

    assert found("2020년 5월 8일 교육위원회 회의 [1].") == [("date", "2020-05-08")]
    assert found("2020년 5월 7일 말이 2020년 5월 8일 기록에 있다 [1].") == []
    assert found("2020년 5월 1일 접수 [1]. 2020년 5월 1일 접수 [2].") == [("date", "2020-05-01")]
    assert found("국토교통위원회 회의 [1][2].") == [("committee", "국토교통위원회")]
    assert found("2001년 1월 1일 국토교통위원회 회의. 다음 [9].") == []


def test_gold_reasons(spark):
    support = spark.createDataFrame([("p", 1, "a"), ("p", 2, "b"), ("q", 1, "a"), ("q", 1, "b"), ("r", 1, "a")], "pool string, element int, doc string")
    seeds = spark.createDataFrame([("p", ["a", "b"]), ("q", ["a", "b"]), ("r", ["b"])], "pool string, seeds array<string>")
    got = {r.pool: r.reasons for r in answers.gold_reasons(support, seeds).collect()}
    assert got == {"p": [], "q": ["substitutable"], "r": ["single_doc", "seed_mismatch"]}


def test_fuzzy():
    assert answers.partial_ratio("abc", "xxabcxx") == 100.0
    parts = ["The sun rose.", "Rain fell late.", "All went home.", "The sun set."]
    assert answers.quote_candidates("Rain fell", parts, 1, 1) == ["Rain fell late."]
    assert answers.quote_candidates("late. All", parts, 5, 2)[0] == "Rain fell late. All went home."
    assert answers.quote_candidates("x", [], 3, 2) == [] and answers.quote_candidates("The sun", parts, 9, 3) == [" ".join(parts[:3]), " ".join(parts[1:])]


def test_wrapped(spark):
    line = "One two. Three four five six seven. Eight! Nine?"
    assert one(spark, answers.wrapped(V, 20), line) == "One two.\nThree four five six seven.\nEight! Nine?"
    assert one(spark, answers.wrapped(V, 99), line + "\n\nTen.") == line + "\n\nTen."
    assert one(spark, answers.wrapped(V, 12), "A. B. C.\nOne two. Six.") == "A. B. C.\nOne two.\nSix."


def test_judged(spark):
    good = '{"verdicts": [{"statement": "a", "supported": true}, {"statement": "b", "supported": false}]}'
    score = answers.judged(V, F.array(F.lit("a"), F.lit("b")))
    assert one(spark, score, good) == 0.5
    assert one(spark, score, good.replace('"b"', '"c"')) is None and one(spark, score, "no") is None


def test_splits():
    meetings = {f"a{i}": ("A", 1) for i in range(30)} | {f"b{i}": ("B", 1) for i in range(10)}
    got = corpus.assign_splits(meetings, 3, [("dev", 20)])
    assert sum(k[0] == "a" for k in got) == 15 and sum(k[0] == "b" for k in got) == 5
    assert corpus.assign_splits(meetings, 3, [("dev", 20)]) == got
    small = corpus.pick_small({"x": {1, 2}, "y": {3}, "z": {4, 5}}, 1, 3)
    assert len(small) >= 3 and small == sorted(small)
    ids = [f"q{i}" for i in range(40)]
    assert corpus.sample_ids(ids, 5, 10) == corpus.sample_ids(ids, 5, 20)[:10]
    assert "q3" not in corpus.sample_ids(ids, 5, 40, exclude=["q3"])


def test_build(spark):
    rows = [("d", "2", "x", "train"), ("d", "10", "y", "valid"), ("e", "1", "z", "train")]
    got = {r.key: r for r in corpus.build(spark.createDataFrame(rows, "key string, qid string, meta string, split string"), "key", "qid", ["meta"], "split").collect()}
    assert (got["d"].meta, got["d"].splits, got["d"].n_qa) == ("y", ["train", "valid"], 2)


def test_pools(spark):
    rows = [("k", "d1", "m1"), ("k", "d2", "m2"), ("l", "d3", "m1"), ("l", "d4", "m1"), ("", "d5", "m1")]
    df = spark.createDataFrame(rows, "key string, doc string, cluster string")
    assert [r.key for r in pools.find(df, ["key"]).collect()] == ["k"]
    assert sorted(r.key for r in pools.find(df, ["key"], cross=False).collect()) == ["k", "l"]
    made = pools.build([("k", {"m1": ["d1"], "m2": ["d2"]})], "law", 5, [2], 1, True)
    assert made[0]["pool_id"] == "law-0000" and sorted(made[0]["seed_doc_ids"]) == ["d1", "d2"]


@pytest.mark.parametrize("text", ["ab abc abcd b", "aab", "xyz", "", "abcabd"])
def test_replacer_by_pieces(text):
    make = lambda: WordReplacer({"abc": "1", "abcd": "2", "b": "3"})
    want = whole(make, text)
    rng = random.Random(4)
    for _ in range(20):
        t, at, out = make(), 0, ""
        while at < len(text):
            n = rng.randint(1, 3)
            out += t.feed(text[at : at + n])
            at += n
        assert out + t.finish() == want


@pytest.mark.parametrize("text", ["2019년 3월 5일 국방위원회 회의에서 1.5배라고 말했다 [1]. 다음.", "[1] 2019년 3월 5일 본회의에서는 끝\n둘째", "그냥 글이다. 3.14", "2019년 3월 5일 본회의에서"])
def test_mover_by_pieces(text):
    want = whole(LeadMover, text)
    for cut in range(len(text) + 1):
        t = LeadMover()
        assert t.feed(text[:cut]) + t.feed(text[cut:]) + t.finish() == want
    t = LeadMover()
    assert "".join(map(t.feed, text)) + t.finish() == want


def test_mover():
    assert whole(LeadMover, "2019년 3월 5일 국방위원회 회의에서 말했다 [1].") == "말했다(2019년 3월 5일 국방위원회) [1]."
    assert whole(LeadMover, "2019년 3월 5일 본회의에서") == "2019년 3월 5일 본회의에서"


def test_limiter():
    hour = limits.HOUR
    x = limits.Limiter(2, 3)
    assert [x.check(t) for t in (0, 1, 2, hour, hour + 1, hour + 2, 24 * hour)] == [True, True, False, True, False, False, True]


def test_usage_limit():
    x = limits.UsageLimit(2, 5, 3)
    assert [x.check(k, t) for k, t in (("a", 0), ("a", 1), ("a", 2), ("b", 3), ("b", 4), ("b", 24 * limits.HOUR))] == [True, True, False, True, False, True]


def test_breaker_and_switch():
    b = limits.Breaker(10)
    assert b.call(0, lambda: 1) == 1
    assert b.call(1, lambda: 1 / 0) is None and b.call(5, lambda: 2) is None and b.call(11, lambda: 3) == 3
    s = limits.MonthlySwitch("quota")
    s.message("over quota", "2024-01")
    assert not s.on("2024-01") and s.on("2024-02") and s.on("2024-02")


def test_stream_equals_batch(spark, tmp_path):
    rows = [(u, i, i * 600_000_000) for u in (1, 2) for i in range(30)]
    df = spark.createDataFrame([(u, u * 1000 + i, t) for u, i, t in rows], "user_id bigint, event_id bigint, us bigint")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = limits.limited_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), 3, 8)
    q = stream.writeStream.format("memory").queryName("limits").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        q.processAllAvailable()
        got = {(r.event_id, r.accepted) for r in spark.sql("select * from limits").collect()}
    finally:
        q.stop()
    assert got == {(r.event_id, r.accepted) for r in limits.limited(df, 3, 8).collect()}
