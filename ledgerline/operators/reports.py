"""Reports on checked and judged answers: buckets, histograms, contingencies, judge calls, blind agreement."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import table
from .answers import AMBIGUOUS, label_items

#: Outcomes that are not a wrong handling.
NOT_WRONG = ("right", "situation_told", "situation_untold")
#: Resamples at a time in the bootstrap.
STRIP = 256


def check_summary(records: DataFrame) -> DataFrame:
    """records (type, passed, reasons) -> (type, what, n): passed, failed and every reason."""
    what = F.concat(F.array(F.when(F.col("passed"), "passed").otherwise("failed")), F.coalesce("reasons", F.array().cast("array<string>")))
    return records.select("type", F.explode(what).alias("what")).groupBy("type", "what").agg(F.count("*").alias("n"))


def refusal_table(records: DataFrame) -> DataFrame:
    """records (gold_n, answer_in_chunk, keys, refusal) -> (bucket, n, refused) by what the contexts had.

    keys: the reference's key statements, null where the judge's reply had no such list. An unknown
    presence is told apart by whether the reference was of no use (no key statements).
    """
    no_gold = F.col("gold_n").isNull()
    bucket = (
        F.when(no_gold, "no_gold")
        .when(F.col("answer_in_chunk"), "in_chunk")
        .when(~F.col("answer_in_chunk"), "not_in_chunk")
        .when(F.size("keys") == 0, "reference_unusable")
        .otherwise("judge_error")
    )
    return records.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.count_if(F.col("refusal").isNotNull()).alias("refused"))


def ratio_histogram(records: DataFrame) -> DataFrame:
    """records (score, refusal) -> (ratio, n, refused): scores to two digits."""
    known = records.where("score is not null").withColumn("ratio", F.round("score", 2))
    return known.groupBy("ratio").agg(F.count("*").alias("n"), F.count_if(F.col("refusal").isNotNull()).alias("refused"))


def unlisted_table(answers: DataFrame, phrase: str, parts: list[str]) -> DataFrame:
    """answers (answer, refusal, no_statements) -> (kind, n): refusals in other words by how they were counted, and silent answers."""
    other = T.unlisted_refusal(F.col("answer"), phrase, parts)
    kind = F.when(other, F.coalesce(F.concat(F.lit("counted_"), F.col("refusal")), F.lit("not_counted"))).when(F.col("no_statements"), "no_statements")
    return answers.select(kind.alias("kind")).where("kind is not null").groupBy("kind").agg(F.count("*").alias("n"))


def item_table(items: DataFrame) -> DataFrame:
    """items (state, handling) -> one row for each state, a column for each handling."""
    return items.groupBy("state").pivot("handling", ["answered", "answered_partly", "explained", "refused", "ignored"]).agg(F.count("state")).na.fill(0)


def item_summary(items: DataFrame, key: str) -> DataFrame:
    """items (key, state, outcome) -> correct, judged, accuracy, told, ambiguous, items, queries and those with a wrong handling."""
    right, ambiguous = F.col("outcome") == "right", F.col("state").isin(*AMBIGUOUS)
    each = items.groupBy(key).agg(
        F.count_if(right).alias("correct"), F.count_if(~ambiguous).alias("judged"), F.count_if(F.col("outcome") == "situation_told").alias("told"),
        F.count_if(ambiguous).alias("ambiguous"), F.count("*").alias("items"), F.count_if(~F.col("outcome").isin(*NOT_WRONG)).alias("wrong"),
    )
    total = each.agg(*(F.sum(c).alias(c) for c in ("correct", "judged", "told", "ambiguous", "items")), F.count("*").alias("queries"), F.count_if(F.col("wrong") > 0).alias("wrong_queries"))
    return total.withColumn("accuracy", F.round(F.try_divide("correct", "judged"), 6))


def judge_calls(calls: DataFrame) -> DataFrame:
    """calls (step, cached, latency_s, tokens_in, tokens_out, finish, retried) -> a row for each step.

    Latency, tokens and unfinished replies are of calls that were made anew.
    """
    new = ~F.col("cached")
    of_new = lambda c: F.when(new, F.col(c))
    return calls.groupBy("step").agg(
        F.count("*").alias("calls"),
        F.count_if(new).alias("made"),
        F.round(F.percentile(of_new("latency_s"), F.array(F.lit(0.5), F.lit(0.95)))[0], 6).alias("p50"),
        F.round(F.percentile(of_new("latency_s"), F.array(F.lit(0.5), F.lit(0.95)))[1], 6).alias("p95"),
        F.coalesce(F.sum(of_new("tokens_in")), F.lit(0)).alias("tokens_in"),
        F.coalesce(F.sum(of_new("tokens_out")), F.lit(0)).alias("tokens_out"),
        F.count_if(new & (F.coalesce("finish", F.lit("")) != "stop")).alias("unfinished"),
        F.count_if("retried").alias("retried"),
    )


def speaker_mismatch(verdicts, mark: str):
    """Share of a judge's verdicts (array<struct<reason>>) whose reason starts with a mark; null without verdicts."""
    return F.try_divide(F.size(F.filter(verdicts, lambda v: v["reason"].startswith(mark))), F.nullif(F.size(verdicts), F.lit(0)))


def perturb_summary(pairs: DataFrame) -> DataFrame:
    """pairs (kind, base, score) -> (kind, worse, same, better, unjudged) of perturbed answers against their base."""
    rows = {"worse": "score < base", "same": "score = base", "better": "score > base", "unjudged": "score is null or base is null"}
    return pairs.groupBy("kind").agg(*(F.count_if(F.expr(e)).alias(n) for n, e in rows.items()))


def blind_units(records: DataFrame) -> DataFrame:
    """records (qid, items, verdicts, checks, label) -> (qid, kind, uid, text, judge, outcome): what a person is to judge again.

    items: array<struct<item, state, handling, outcome>>, verdicts: array<struct<statement, verdict>>,
    checks: array<struct<statement, present>>.
    """

    def unit(kind, text, judge, outcome=None):
        return lambda x, i: F.struct(F.lit(kind).alias("kind"), F.concat(F.lit(kind), i.cast("string")).alias("uid"), text(x).alias("text"), judge(x).alias("judge"), (F.lit(None).cast("string") if outcome is None else outcome(x)).alias("outcome"))

    yes = lambda c, word: F.when(c == 1, word).otherwise("not")
    parts = [
        F.transform("items", unit("state", lambda x: x["item"], lambda x: x["state"])),
        F.transform("verdicts", unit("faith", lambda x: x["statement"], lambda x: yes(x["verdict"], "supported"))),
        F.transform("items", unit("handling", lambda x: x["item"], lambda x: x["handling"], lambda x: x["outcome"])),
        F.transform("checks", unit("inclusion", lambda x: x["statement"], lambda x: yes(x["present"], "present"))),
        F.transform(F.array_compact(F.array("label")), lambda v: F.struct(F.lit("relevance").alias("kind"), F.lit("relevance").alias("uid"), F.lit("").alias("text"), v.alias("judge"), F.lit(None).cast("string").alias("outcome"))),
    ]
    none = F.array().cast("array<struct<kind: string, uid: string, text: string, judge: string, outcome: string>>")
    return records.select("qid", F.explode(F.concat(*(F.coalesce(p, none) for p in parts))).alias("u")).select("qid", "u.*")


def unit_failures(units: DataFrame, failing: dict[str, list[str]]) -> DataFrame:
    """(qid, failures): units that the judge saw fail; handlings by their outcome, other kinds by the failing labels."""
    bad = (F.col("kind") == "handling") & ~F.coalesce(F.col("outcome").isin(*NOT_WRONG), F.lit(False))
    for kind, labels in failing.items():
        bad = bad | ((F.col("kind") == kind) & F.col("judge").isin(*labels))
    return units.groupBy("qid").agg(F.count_if(bad).alias("failures"))


def agreement_of(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(agreement, kappa) of confusion tables [..., labels, labels]; kappa is not a number where only one label is used."""
    n = table.sum((-2, -1))
    seen = np.trace(table, axis1=-2, axis2=-1) / n
    chance = (table.sum(-1) * table.sum(-2)).sum(-1) / n**2
    with np.errstate(invalid="ignore", divide="ignore"):
        return seen, np.where(chance < 1, (seen - chance) / (1 - chance), np.nan)


def blind_stats(pairs: DataFrame, failing: list[str] | None = None, resamples: int = 2000, seed: int = 20260929) -> dict:
    """pairs (qid, person, judge): agreement and kappa with bootstrap intervals over queries, and rates of failing labels.

    Counts come to the driver as one row for each query and pair of labels: as many as people have judged.
    """
    counted = pairs.groupBy("qid", "person", "judge").agg(F.count("*").alias("n")).orderBy("qid", "person", "judge").collect()
    if not counted:
        return {"n": 0, "queries": 0}
    labels = sorted({r.person for r in counted} | {r.judge for r in counted})
    queries = sorted({r.qid for r in counted})
    place, row = {x: i for i, x in enumerate(labels)}, {q: i for i, q in enumerate(queries)}
    each = np.zeros((len(queries), len(labels), len(labels)))
    for r in counted:
        each[row[r.qid], place[r.person], place[r.judge]] = r.n
    whole = each.sum(0)
    seen, kappa = agreement_of(whole)
    rng = np.random.default_rng(seed)
    flat, found = each.reshape(len(queries), -1), []
    for i in range(0, resamples, STRIP):
        times = rng.multinomial(len(queries), np.full(len(queries), 1 / len(queries)), size=min(STRIP, resamples - i))
        found.append(np.stack(agreement_of((times @ flat).reshape(-1, *whole.shape))))
    both = np.concatenate(found, axis=1)
    out = {"n": int(whole.sum()), "queries": len(queries), "agreement": float(seen), "kappa": float(kappa), "agreement_ci": tuple(np.nanquantile(both[0], [0.025, 0.975])), "kappa_ci": tuple(np.nanquantile(both[1], [0.025, 0.975])) if not np.isnan(both[1]).all() else (np.nan, np.nan)}
    if failing is not None:
        bad = np.array([x in failing for x in labels])
        out |= {"tpr": (int(whole[bad][:, bad].sum()), int(whole[bad].sum())), "tnr": (int(whole[~bad][:, ~bad].sum()), int(whole[~bad].sum()))}
    return out


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as judged records: what a reference and a judge would have said follows from the id."""
    k = F.col("doc_id")
    return table(spark, sf_dir, "labels").select(
        "doc_id",
        F.when(k % 5 != 0, (k % 4 + 1).cast("int")).alias("gold_n"),
        F.when(k % 3 == 0, F.col("quality") == 1).alias("answer_in_chunk"),
        F.when(k % 7 != 0, F.when(k % 2 == 0, F.array(F.lit("key"))).otherwise(F.array().cast("array<string>"))).alias("keys"),
        F.when(F.col("toxic") == 1, "full").when(k % 11 == 0, "partial").alias("refusal"),
        F.when(k % 6 != 0, (k % 8) / 7).alias("score"),
    )


def refusal_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refusal_table(records(spark, sf_dir))


def chunk_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ratio_histogram(records(spark, sf_dir))


def label_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return item_summary(label_items(spark, sf_dir).join(docs, "doc_id"), "source")


def label_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return item_table(label_items(spark, sf_dir))


def event_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as calls of a judge: their type is the step."""
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    return judge_calls(e.select(F.col("event_type").alias("step"), (k % 3 == 0).alias("cached"), F.col("value").alias("latency_s"), (k % 100).alias("tokens_in"), (k % 10).alias("tokens_out"), F.when(k % 5 != 0, "stop").alias("finish"), (k % 13 == 0).alias("retried")))


def checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as checked records of each language."""
    joined = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    reasons = F.array_compact(F.array(F.when(F.col("quality") == 0, "quality"), F.when(F.col("toxic") == 1, "toxic")))
    return check_summary(joined.select(F.col("lang").alias("type"), (F.size(reasons) == 0).alias("passed"), reasons.alias("reasons")))


def perturbed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of each source as perturbed answers: toxicity against quality."""
    joined = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return perturb_summary(joined.select(F.col("source").alias("kind"), F.when(F.col("doc_id") % 9 != 0, F.col("quality")).alias("base"), F.col("toxic").alias("score")))


def unlisted(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .answers import replies

    k = F.col("conv_id")
    kinds = F.when(k % 3 == 0, "full").when(k % 3 == 1, "partial")
    return unlisted_table(replies(spark, sf_dir).select("answer", kinds.alias("refusal"), (k % 5 == 0).alias("no_statements")), "I do not know", ["cannot", "answer"])


_ITEMS = """i as (select doc_id, case when doc_id % 7 = 0 then 'unclear' when quality = 1 then case when doc_id % 3 = 0 then 'partial' else 'present' end else 'absent' end as state,
  case when toxic = 1 then case when doc_id % 2 = 0 then 'refused' else 'ignored' end when doc_id % 5 = 0 then 'explained' when doc_id % 5 = 1 then 'answered_partly' else 'answered' end as handling from labels),
l as (select *, case state when 'absent' then 0 when 'partial' then 1 when 'present' then 2 end as known, case handling when 'refused' then 0 when 'answered_partly' then 1 when 'answered' then 2 when 'explained' then 2 end as given from i),
o as (select doc_id, state, handling, state = 'unclear' as amb, state <> 'unclear' and handling <> 'ignored' and known = given as ok, state = 'unclear' and handling = 'explained' as told from l)"""
_RECORDS = """r as (select doc_id, case when doc_id % 5 <> 0 then doc_id % 4 + 1 end as gold_n, case when doc_id % 3 = 0 then quality = 1 end as in_chunk,
  case when doc_id % 7 <> 0 then case when doc_id % 2 = 0 then 1 else 0 end end as n_keys, case when toxic = 1 then 'full' when doc_id % 11 = 0 then 'partial' end as refusal, case when doc_id % 6 <> 0 then (doc_id % 8) / 7 end as score from labels)"""
QUERIES = {"refusal_buckets": refusal_buckets, "chunk_ratios": chunk_ratios, "item_summary": label_summary, "item_table": label_table, "judge_calls": event_calls, "check_summary": checks, "perturb_summary": perturbed, "unlisted_refusals": unlisted}
ORACLES = {
    "refusal_buckets": f"""with {_RECORDS} select case when gold_n is null then 'no_gold' when in_chunk then 'in_chunk' when not in_chunk then 'not_in_chunk' when n_keys = 0 then 'reference_unusable' else 'judge_error' end as bucket,
count(*) as n, count(refusal) as refused from r group by 1""",
    "chunk_ratios": f"with {_RECORDS} select round(score, 2) as ratio, count(*) as n, count(refusal) as refused from r where score is not null group by 1",
    "item_summary": f"""with {_ITEMS}, e as (select source, count(*) filter (ok) as correct, count(*) filter (not amb) as judged, count(*) filter (told) as told, count(*) filter (amb) as ambiguous, count(*) as items, count(*) filter (not ok and not amb) as wrong
  from o join documents using (doc_id) group by source)
select cast(sum(correct) as bigint) as correct, cast(sum(judged) as bigint) as judged, cast(sum(told) as bigint) as told, cast(sum(ambiguous) as bigint) as ambiguous, cast(sum(items) as bigint) as items, count(*) as queries, count(*) filter (wrong > 0) as wrong_queries, round(sum(correct) / sum(judged), 6) as accuracy from e""",
    "item_table": f"with {_ITEMS} select state, " + ", ".join(f"count(*) filter (handling = '{h}') as {h}" for h in ("answered", "answered_partly", "explained", "refused", "ignored")) + " from o group by state",
    "judge_calls": """with c as (select event_type as step, event_id as k, value, event_id % 3 = 0 as cached from events)
select step, count(*) as calls, count(*) filter (not cached) as made, round(quantile_cont(value, 0.5) filter (not cached), 6) as p50, round(quantile_cont(value, 0.95) filter (not cached), 6) as p95,
cast(coalesce(sum(k % 100) filter (not cached), 0) as bigint) as tokens_in, cast(coalesce(sum(k % 10) filter (not cached), 0) as bigint) as tokens_out, count(*) filter (not cached and k % 5 = 0) as unfinished, count(*) filter (k % 13 = 0) as retried from c group by step""",
    "check_summary": """with x as (select lang as type, unnest(list_concat([case when quality <> 0 and toxic <> 1 then 'passed' else 'failed' end], list_filter([case when quality = 0 then 'quality' end, case when toxic = 1 then 'toxic' end], lambda v: v is not null))) as what
from labels join documents using (doc_id)) select type, what, count(*) as n from x group by all""",
    "perturb_summary": """with p as (select source as kind, case when doc_id % 9 <> 0 then quality end as base, toxic as score from labels join documents using (doc_id))
select kind, count(*) filter (score < base) as worse, count(*) filter (score = base) as same, count(*) filter (score > base) as better, count(*) filter (score is null or base is null) as unjudged from p group by kind""",
    "unlisted_refusals": r"""with r as (select conv_id, case when conv_id % 2 = 0 then a || chr(10) || 'I cannot answer that.' else a end as answer from (
  select conv_id, replace(text, chr(10), ' [1]' || chr(10)) || ' [' || turn::varchar || ']' as a from conversations where role = 'assistant')),
k as (select case when contains(answer, 'I cannot answer that.') then coalesce('counted_' || case when conv_id % 3 = 0 then 'full' when conv_id % 3 = 1 then 'partial' end, 'not_counted') when conv_id % 5 = 0 then 'no_statements' end as kind from r)
select kind, count(*) as n from k where kind is not null group by kind""",
}
