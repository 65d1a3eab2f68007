"""From ranked documents to answers: contexts, generation, conversations a turn at a time, judged records.

Models are callables (operators/external.py). Batches of questions go through DataFrames; a turn of an
online conversation is one generator on the driver, which holds that turn alone.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.transducers import LeadMover, WordReplacer
from ..operators import answers, dense, external
from ..sources.tables import table
from . import retrieval


# ranking and contexts


def live_rerank(fused: DataFrame, queries: DataFrame, texts: DataFrame, depth: int, model: Callable = external.overlap_stub, failed: Callable[[Exception], None] | None = None) -> DataFrame | None:
    """Second scores (query, doc, second) of the fused heads' chunks; None, and a word to `failed`, where the model fails.

    fused: (query, doc, rank, chunk), queries: (query, text), texts: (chunk, text). Scores are written to
    memory once, so a failure shows here and not in the query that reads them.
    """
    head = fused.where(F.col("rank") <= depth).join(queries.withColumnRenamed("text", "asked"), "query").join(texts, "chunk")
    pairs = head.select(F.col("query").alias("qid"), F.col("doc").alias("doc_id"), F.col("asked").alias("query"), "text")
    try:
        scored = external.rerank(pairs, model).select(F.col("qid").alias("query"), F.col("doc_id").alias("doc"), F.col("score").alias("second")).persist()
        scored.count()
    except Exception as e:  # noqa: BLE001 ranking goes on without second scores
        if failed is not None:
            failed(e)
        return None
    return scored


def rank(config: retrieval.Config, inputs: dict, second: DataFrame | None = None) -> DataFrame:
    """The retriever's order with stored second scores; every query needs them if the configuration reranks and has any."""
    if config.rerank_depth and second is not None:
        lacking = inputs["dense_docs"].select("query").distinct().join(second.select("query").distinct(), "query", "left_anti")
        if not lacking.isEmpty():
            raise KeyError("queries without second scores")
    return retrieval.retrieve(config, **inputs, second=second)


def contexts(ranked: DataFrame, chunks: DataFrame, queries: DataFrame, k: int, widen_top: int = 0, widen: int = 1) -> DataFrame:
    """(query, n, doc, chunk, score, first, last): the best chunk of each of the k first documents; the first `widen_top` take neighbours.

    ranked: (query, doc, rank); first and last are the numbers of the neighbouring chunks of the document
    that go in.
    """
    head = ranked.where(F.col("rank") <= k).select("query", "doc", "rank")
    best = dense.best_chunks(dense.pair_scores(head, chunks, queries))
    named = head.join(best, ["query", "doc"])
    near = chunks.select("doc", F.col("chunk").alias("near"))
    reach = F.when(F.col("rank") <= widen_top, widen).otherwise(0)
    met = named.join(near, "doc").where(F.abs(F.col("near") - F.col("chunk")) <= reach)
    return met.groupBy("query", F.col("rank").alias("n"), "doc", "chunk", "score").agg(F.min("near").alias("first"), F.max("near").alias("last"))


def second_pass(first: DataFrame, rewrites: DataFrame, rerun: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rankings in which queries with a valid rewrite (query, rewritten) have the ranks of the second run; others keep theirs.

    rerun gets (query, rewritten) of the valid ones only.
    """
    valid = rewrites.where("rewritten is not null and trim(rewritten) <> ''").select("query", "rewritten")
    again = rerun(valid)
    return first.join(valid.select("query"), "query", "left_anti").unionByName(again.select(*first.columns))


# generation


def complete_stub(prompt: str) -> str:
    """The first context's first words, cited."""
    line = next((x for x in prompt.split("\n") if x.startswith("[1] ")), "")
    return " ".join(line[4:].split()[:12]) + " [1]." if line else "I cannot answer that."


RESULT = "qid string, answer string, thought string, finish string, total_s double, error string"


def generate(requests: DataFrame, model: Callable[[str], str | dict] = complete_stub, strip_bullet: bool = False) -> DataFrame:
    """requests (qid, prompt) -> (qid, answer, thought, finish, total_s, error); a failed call is an error and no answer.

    A model gives a text, or a dict with text and finish; what it thinks aloud is kept apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for qid, prompt in zip(b.column("qid").to_pylist(), b.column("prompt").to_pylist()):
                begun, error, got = time.perf_counter(), None, {}
                try:
                    got = model(prompt)
                    got = got if isinstance(got, dict) else {"text": got, "finish": "stop"}
                except Exception as e:  # noqa: BLE001 kept beside the request
                    error = f"{type(e).__name__}: {e}"[:200]
                rows.append((qid, got.get("text"), got.get("finish"), time.perf_counter() - begun, error))
            kinds = [pa.string(), pa.string(), pa.string(), pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows) if rows else [()] * 5, kinds)], names=["qid", "raw", "finish", "total_s", "error"])

    made = requests.select(F.col("qid").cast("string").alias("qid"), "prompt").mapInArrow(run, "qid string, raw string, finish string, total_s double, error string")
    split = T.split_thought(F.col("raw"))
    answer = T.strip_lone_bullet(split["answer"]) if strip_bullet else split["answer"]
    return made.select("qid", answer.alias("answer"), split["thought"].alias("thought"), "finish", "total_s", "error")


def answered(pieces: Iterable[str], opening: str = "<think>", closing: str = "</think>") -> Iterator[str]:
    """The answer's pieces of a stream whose reasoning block, if it starts with one, is left out; may hold back a possible mark."""
    held, state = "", "start"
    for piece in pieces:
        if state == "answer":
            yield piece
            continue
        held += piece
        if state == "start":
            bare = held.lstrip()
            if bare.startswith(opening):
                state = "thought"
            elif bare and not opening.startswith(bare):
                state = "answer"
                yield held
                continue
        if state == "thought" and closing in held:
            held = held.split(closing, 1)[1].lstrip()
            if held:
                state = "answer"
                yield held
            else:
                state = "gap"
        elif state == "gap" and held.strip():
            state = "answer"
            yield held.lstrip()
    if state == "start" and held:
        yield held


# conversations


@dataclass
class Chat:
    """What a turn needs; every part is a callable, so tests and services bring their own."""

    retrieve: Callable[[str, list[int]], list[dict]]  # search text, chunk rows to keep -> contexts
    stream: Callable[[str, list[dict], list[dict]], Iterable[str]]  # question, contexts, history -> pieces
    rewrite: Callable[[str, list[dict]], tuple[str, dict]] = lambda message, turns: (message, {})
    limit: Callable[[], str | None] = lambda: None
    payload: Callable[[dict], dict] = dict
    most_chars: int = 1000
    too_long: str = "The question is too long."
    no_answer: str = "There is no answer."
    words: dict[str, str] = field(default_factory=dict)
    reuse: str = "off"  # off, rule (always kept rows are offered), rewrite or decision (where the rewrite says so)

    def __post_init__(self):
        if self.reuse not in ("off", "rule", "rewrite", "decision"):
            raise ValueError(f"no reuse {self.reuse!r}")


def follow_up(rewrite: Callable[[str, list[dict]], str | None], decide: Callable[[str, list[dict]], float] | None = None, least: float = 0.5, most_chars: int = 300) -> Callable[[str, list[dict]], tuple[str, dict]]:
    """A rewriter of follow-up questions with, beside it, a decision whether earlier contexts are needed.

    Both are asked at the same time. A failed, empty or too long rewrite leaves the question, a failed
    decision needs nothing.
    """

    def quiet(f, *args):
        try:
            return f(*args), "ok"
        except Exception as e:  # noqa: BLE001 the turn goes on
            return None, type(e).__name__

    def both(message: str, turns: list[dict]) -> tuple[str, dict]:
        with ThreadPoolExecutor(2) as pool:
            decided = pool.submit(quiet, decide, message, turns) if decide else None
            text, status = quiet(rewrite, message, turns)
            line = next((x.strip() for x in (text or "").split("\n") if x.strip()), None)
            valid = line is not None and len(line) <= most_chars
            meta = {"rewrite": status if valid or status != "ok" else "invalid"}
            if decided is not None:
                p, how = decided.result()
                meta |= {"decision": how, "needs_earlier": p is not None and p >= least}
        return (line if valid else message), meta

    return both


def chat_turn(chat: Chat, message: str, history: list[dict] = (), rows: list[int] = ()) -> Iterator[dict]:
    """Events of one turn: texts so far, then the whole answer with its contexts and the chunk rows it cites.

    history: earlier turns (question, answer); rows: chunk rows that the last answer cited. A question
    that is too long or over the usage limit is answered at once, before anything is searched.
    """
    if not message.strip():
        return
    note = chat.too_long if len(message) > chat.most_chars else chat.limit()
    if note:
        yield {"text": note, "done": True, "raw": "", "contexts": [], "rows": []}
        return
    history = list(history)
    search, meta = chat.rewrite(message, history) if history else (message, {})
    offered = bool(history) and (chat.reuse == "rule" or (chat.reuse != "off" and meta.get("needs_earlier", False)))
    found = chat.retrieve(search, list(rows) if offered else [])
    mover, replacer = LeadMover(), WordReplacer(chat.words) if chat.words else None
    shown = lambda text: replacer.feed(text) if replacer else text
    raw = text = ""
    for piece in answered(chat.stream(message, found, history)):
        raw += piece
        new = shown(mover.feed(piece))
        if new:
            text += new
            yield {"text": text, "done": False}
    text += shown(mover.finish()) + (replacer.finish() if replacer else "")
    cited = sorted({int(n) for n in re.findall(T.CITATION, raw) if 1 <= int(n) <= len(found)})
    kept = [found[n - 1]["chunk"] for n in cited] if chat.reuse != "off" else []
    yield {"text": text or chat.no_answer, "done": True, "raw": raw, "contexts": [chat.payload(c) for c in found], "rows": kept, "meta": meta}


# judging


#: The judge's steps; a prompt has to have all that a run asks for.
STEPS = ("faithfulness", "relevance", "key_statements", "chunk_checks", "inclusion")
ITEM_STEPS = ("items", "item_handling")


def check_steps(prompt: dict, items: bool = False) -> None:
    """Stops before any call where a prompt lacks steps."""
    missing = [s for s in (*STEPS, *(ITEM_STEPS if items else ())) if s not in prompt]
    if missing:
        raise ValueError(f"the judge's prompt lacks {', '.join(missing)}")


def record_checks(records: DataFrame, phrase: str, fillers: list[str], parts: list[str], committees: list[str] = ()) -> DataFrame:
    """records (qid, answer, contexts, gold) with what needs no judge: refusal, the rest of the answer, gold's place, citations, mismatches.

    contexts: array<struct<n, doc_id, date, committee_name, text>>. Full refusals have no citations and
    mismatches.
    """
    r = T.refusal(F.col("answer"), phrase, fillers, parts)
    out = records.withColumn("r", r).select("*", F.col("r.kind").alias("refusal"), F.col("r.rest").alias("rest"), answers.gold_position(F.transform("contexts", lambda c: c["doc_id"]), F.col("gold")).cast("int").alias("gold_n")).drop("r")
    full = F.coalesce(F.col("refusal") == "full", F.lit(False))
    cited = T.citation_check(F.col("rest"), F.size("contexts"), fillers)
    return out.withColumns({"citations": F.when(~full, cited), "mismatches": F.when(~full, answers.mismatches(F.col("rest"), F.col("contexts"), list(committees)))})


def judge_requests(checked: DataFrame, prompt: dict[str, str], steps: tuple[str, ...] = ("faithfulness", "relevance", "key_statements")) -> DataFrame:
    """(qid, step, key, body): what the judge is asked about each record; key is the digest of the body.

    Full refusals are only asked for key statements, and those only where gold is among the contexts.
    """
    full = F.coalesce(F.col("refusal") == "full", F.lit(False))
    wanted = F.array_compact(F.array(*(F.when(F.col("gold_n").isNotNull() if s == "key_statements" else ~full, s) for s in steps)))
    each = checked.withColumn("step", F.explode(wanted))
    told = F.coalesce(*(F.when(F.col("step") == s, F.lit(prompt[s])) for s in steps))
    texts = F.when(F.col("step") == "faithfulness", F.array_join(F.transform("contexts", lambda c: c["text"]), "\n")).otherwise("")
    body = F.to_json(F.struct("step", told.alias("prompt"), F.col("query"), F.when(F.col("step") == "key_statements", F.col("reference")).otherwise(F.col("rest")).alias("answer"), texts.alias("contexts")))
    return each.select("qid", "step", body.alias("body")).withColumn("key", F.sha2("body", 256))


def judge_records(checked: DataFrame, prompt: dict[str, str], model: Callable[[str], str | None], cache: DataFrame | None = None, steps: tuple[str, ...] = ("faithfulness", "relevance", "key_statements")) -> DataFrame:
    """checked records with a map of the judge's replies by step and one of its errors; equal requests are sent once."""
    asked = judge_requests(checked, prompt, steps)
    replies = external.ask(asked.select("key", "body"), cache, model)
    met = asked.join(replies, "key").groupBy("qid").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("reply").isNotNull(), F.struct("step", "reply")))).alias("replies"),
        F.map_from_entries(F.collect_list(F.when(F.col("error").isNotNull(), F.struct("step", "error")))).alias("errors"),
    )
    return checked.join(met, "qid", "left")


def latency(keys: list, seed: int, n: int, call: Callable) -> dict:
    """Seconds of `call` on n seeded keys after one to warm up: n, mean, p50, p95 and most."""
    import numpy as np

    from ..operators.review import seeded_subset

    seconds = []
    for key in seeded_subset(keys, seed, min(n + 1, len(keys))):
        begun = time.perf_counter()
        call(key)
        seconds.append(time.perf_counter() - begun)
    kept = np.array(seconds[1:])
    return {"n": len(kept), "mean": float(kept.mean()), "p50": float(np.percentile(kept, 50)), "p95": float(np.percentile(kept, 95)), "most": float(kept.max())} if len(kept) else {"n": 0}


# queries


def _asked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return dense.chunks(spark, sf_dir), dense.queries(spark, sf_dir)


def answer_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three first documents of each vector query, the first with its chunk's neighbours."""
    every, asked = _asked(spark, sf_dir)
    ranked = dense.search(every, asked, 3, (1.0,))
    return contexts(ranked, every, asked, 3, 1).select("query", "n", "doc", "chunk", "score", "first", "last")


def rewritten_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector queries; every other one is searched again as the vector of the number before it, but for those without one."""
    every, asked = _asked(spark, sf_dir)
    first = dense.search(every, asked, 5)
    other = F.when((F.col("query") / 100) % 2 == 1, F.when(F.col("query") % 300 != 0, (F.col("query") - 1).cast("string")))

    def rerun(valid: DataFrame) -> DataFrame:
        moved = valid.select("query", F.col("rewritten").cast("bigint").alias("chunk")).join(every.select("chunk", F.col("v").alias("qv")), "chunk").select("query", "qv")
        return dense.search(every, moved, 5)

    return second_pass(first, asked.select("query", other.alias("rewritten")), rerun)


def checked_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies as records with three contexts of their conversation's number: refusal, gold's place and citations."""
    c = F.col("conv_id")
    ctx = F.array(*(F.struct(F.lit(i).alias("n"), (c + i).cast("string").alias("doc_id"), F.lit(None).cast("string").alias("date"), F.lit(None).cast("string").alias("committee_name"), F.lit("").alias("text")) for i in (1, 2, 3)))
    gold = (c + c % 5).cast("string")
    found = answers.replies(spark, sf_dir).select(F.concat_ws("-", "conv_id", "turn").alias("qid"), "answer", ctx.alias("contexts"), gold.alias("gold"))
    out = record_checks(found, "I cannot answer that", [], ["cannot", "answer"])
    return out.select("qid", "refusal", "gold_n", F.col("citations.n_sentences").cast("bigint").alias("n_sentences"), F.col("citations.uncited").cast("bigint").alias("uncited"))


def generated_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items answered by the stand-in from their best documents: answers and finish."""
    from ..operators import lexical

    run = lexical.benchmark_run(spark, sf_dir, k=3)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text")
    listed = run.join(docs, "doc").groupBy("query").agg(F.sort_array(F.collect_list(F.struct("rank", "text"))).alias("c"))
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), F.col("text").alias("asked"))
    prompts = items.join(listed, "query").select(F.col("query").cast("string").alias("qid"), external.messages(F.col("asked"), F.col("c.text")).alias("prompt"))
    return generate(prompts).select("qid", "answer", "finish", "error")


_SPLIT = answers._SENTENCES
QUERIES = {"answer_contexts": answer_contexts, "rewritten_ranks": rewritten_ranks, "checked_replies": checked_replies, "generated_answers": generated_answers}
ORACLES = {
    "answer_contexts": f"""with {dense.SCORED_SQL}, t as (select query, doc, rank from ({dense.top_sql('docmax', 3, 'doc', 'query, doc')})),
b as (select t.query, t.rank as n, t.doc, r.chunk, r.score from t join ranked r on r.query = t.query and r.doc = t.doc and r.i = 1)
select b.query, b.n, b.doc, b.chunk, b.score, min(c.chunk) as first, max(c.chunk) as last from b join c on c.doc = b.doc and abs(c.chunk - b.chunk) <= case when b.n <= 1 then 1 else 0 end group by all""",
    "rewritten_ranks": f"""with {dense.SCORED_SQL},
asked as (select chunk as query, case when (chunk // 100) % 2 = 1 and chunk % 300 <> 0 then chunk - 1 else chunk end as used from c where chunk % 100 = 0),
s as (select a.query, c.chunk, round(list_dot_product(c.v, q.v), 6) as score from asked a join c q on q.chunk = a.used join c on c.chunk <> a.query)
{dense.top_sql('s', 5, 'chunk', 'query, chunk, score')}""",
    "checked_replies": rf"""with {answers._REPLIES}, {_SPLIT},
f as (select conv_id, turn, g, s, contains(replace(s, ' ', ''), 'cannot') and contains(replace(s, ' ', ''), 'answer') as no from sent),
c as (select conv_id, turn, count(*) filter (no) as n_no, count(*) filter (not no) as n_sentences, count(*) filter (not no and not regexp_matches(s, '\[(\d+)\]')) as uncited from f group by all),
k as (select r.conv_id, r.turn, case when coalesce(n_no, 0) = 0 then null when n_sentences > 0 then 'partial' else 'full' end as refusal, coalesce(n_sentences, 0) as n_sentences, coalesce(uncited, 0) as uncited from r left join c using (conv_id, turn))
select conv_id::varchar || '-' || turn::varchar as qid, refusal, cast(nullif(case when conv_id % 5 <= 3 then conv_id % 5 else 0 end, 0) as integer) as gold_n,
  case when refusal is distinct from 'full' then n_sentences end as n_sentences, case when refusal is distinct from 'full' then uncited end as uncited from k""",
}
