"""Checks of generated answers: citations, refusals, item outcomes, metadata, verdicts of judges, perturbations."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import spread, table
from .similarity import partial_ratio

#: How much of the wanted information there is, and how much of an answer is given.
KNOWN = {"absent": 0, "partial": 1, "present": 2}
GIVEN = {"refused": 0, "answered_partly": 1, "answered": 2}
AMBIGUOUS = ("unclear", "evasive")


def outcome(state: Column, handling: Column) -> Column:
    """What a handling makes of a state: right if as much is given as is known.

    Ambiguous states are told or untold; elsewhere an explained situation counts as answered. Giving
    less than is known is an over-refusal if all is refused and a needless notice otherwise; giving more
    is unsupported if nothing is known and unmarked otherwise. Ignored items are omissions.
    """
    level = lambda names, x: F.coalesce(*(F.when(x == n, v) for n, v in names.items()))
    known = level(KNOWN, state)
    given = level(GIVEN, F.when(handling == "explained", "answered").otherwise(handling))
    return (
        F.when(state.isin(*AMBIGUOUS), F.when(handling == "explained", "situation_told").otherwise("situation_untold"))
        .when(known.isNotNull() & (handling == "ignored"), F.when(known == 0, "silent_omission").otherwise("omitted"))
        .when(known == given, "right")
        .when(given < known, F.when(given == 0, "over_refusal").otherwise("needless_notice"))
        .when(given > known, F.when(known == 0, "unsupported").otherwise("partial_unmarked"))
    )


def item_counts(items: DataFrame, key: str) -> DataFrame:
    """items (key, state, outcome) -> counts by query; ambiguous items are not judged."""
    n = lambda c: F.count_if(c).alias
    return items.groupBy(key).agg(
        n(F.col("outcome") == "right")("correct"), n(~F.col("state").isin(*AMBIGUOUS))("judged"), n(F.col("outcome") == "over_refusal")("over_refusal"), n(F.col("outcome") == "unsupported")("unsupported")
    )


def gold_position(contexts: Column, gold: Column) -> Column:
    return F.nullif(F.array_position(contexts, gold), F.lit(0))


def composite(faithfulness: Column, relevance: Column) -> Column:
    """The mean of both; null unless both are there."""
    return (faithfulness + relevance) / 2


def criterion(records: DataFrame, by: list[str]) -> DataFrame:
    """records (score, excluded, error): mean of scores, numbers scored, excluded and failed."""
    scored = F.col("score").isNotNull() & F.col("excluded").isNull() & F.col("error").isNull()
    return records.groupBy(*by).agg(F.round(F.avg(F.when(scored, F.col("score"))), 6).alias("mean"), F.count_if(scored).alias("n"), F.count_if(F.col("excluded").isNotNull()).alias("excluded"), F.count_if(F.col("error").isNotNull()).alias("errors"))


def agreement(pairs: DataFrame) -> DataFrame:
    """pairs (a, b booleans) -> agreement, kappa, rates of true positives and true negatives (a is the truth)."""
    c = pairs.agg(*(F.count_if(F.expr(e)).alias(n) for n, e in (("tp", "a and b"), ("tn", "not a and not b"), ("fp", "not a and b"), ("fn", "a and not b"))))
    n = F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")
    seen = (F.col("tp") + F.col("tn")) / n
    chance = ((F.col("tp") + F.col("fn")) * (F.col("tp") + F.col("fp")) + (F.col("tn") + F.col("fp")) * (F.col("tn") + F.col("fn"))) / (n * n)
    rate = lambda x, y: F.round(F.try_divide(F.col(x), F.col(x) + F.col(y)), 6)
    return c.select(n.alias("n"), F.round(seen, 6).alias("agreement"), F.round(F.try_divide(seen - chance, 1 - chance), 6).alias("kappa"), rate("tp", "fn").alias("tpr"), rate("tn", "fp").alias("tnr"))


def judged(raw: Column, statements: Column) -> Column:
    """Share of supported statements in a judge's JSON reply {"verdicts": [{"statement", "supported"}]}.

    Null where the reply is no such object or does not echo the statements in their order.
    """
    reply = F.from_json(T.json_object(raw), "verdicts array<struct<statement: string, supported: boolean>>")["verdicts"]
    echo = F.transform(reply, lambda v: v["statement"]) == statements
    whole = F.forall(reply, lambda v: v["supported"].isNotNull())
    return F.when(echo & whole & (F.size(statements) > 0), F.size(F.filter(reply, lambda v: v["supported"])) / F.size(statements))


def resolve(support: DataFrame, least: float = 0.9) -> DataFrame:
    """support (pool, element, doc, quote, text, p): rows whose quote is in the text or judged to be."""
    return support.where(T.found(F.col("quote"), F.col("text"), F.col("p"), least))


def gold_reasons(support: DataFrame, seeds: DataFrame) -> DataFrame:
    """(pool, gold, reasons): all supporting documents, and why they fail the rules.

    single_doc: fewer than two; substitutable: one is nowhere the only support; seed_mismatch: not the seeds.
    """
    docs = support.groupBy("pool", "element").agg(F.sort_array(F.collect_set("doc")).alias("docs"))
    gold = docs.groupBy("pool").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("docs")))).alias("gold"), F.collect_set(F.when(F.size("docs") == 1, F.col("docs")[0])).alias("only"))
    met = gold.join(seeds, "pool")
    reasons = F.array_compact(F.array(
        F.when(F.size("gold") < 2, "single_doc"),
        F.when(F.size(F.array_except("gold", "only")) > 0, "substitutable"),
        F.when((F.size(F.array_except("gold", "seeds")) > 0) | (F.size(F.array_except("seeds", "gold")) > 0), "seed_mismatch"),
    ))
    return met.select("pool", "gold", reasons.alias("reasons"))


def mismatches(answer: Column, contexts: Column, committees: list[str]) -> Column:
    """array<struct<field, value>>: dates and committees of cited sentences that no cited context has.

    contexts: array<struct<n, date, committee_name, text>>. A sentence that names the date of a context
    it cites is not asked for its other dates; dates in the cited texts are known, too. Longer committee
    names win at one place, and each name counts once in a sentence.
    """
    from .conditions import dates

    days = lambda text: F.filter(dates(text), lambda d: F.length(d) == 10)
    none = F.array().cast("array<struct<field: string, value: string>>")
    named = lambda field, values: F.transform(values, lambda v: F.struct(F.lit(field).alias("field"), v.alias("value")))

    def one(sentence):
        numbers = F.regexp_extract_all(sentence, F.lit(T.CITATION), F.lit(1)).cast("array<int>")
        cited = F.filter(contexts, lambda c: F.array_contains(numbers, c["n"].cast("int")))
        own = F.transform(cited, lambda c: c["date"])
        told = F.flatten(F.transform(cited, lambda c: days(F.coalesce(c["text"], F.lit("")))))
        wrong_days = F.when(F.arrays_overlap(days(sentence), own), F.array().cast("array<string>")).otherwise(F.array_except(days(sentence), told))
        out = named("date", wrong_days)
        if committees:
            places = F.array_distinct(F.regexp_extract_all(sentence, F.lit(T.alternation(committees)), F.lit(0)))
            out = F.concat(out, named("committee", F.filter(places, lambda p: ~F.exists(cited, lambda c: F.coalesce(c["committee_name"].contains(p), F.lit(False))))))
        return F.when(F.size(cited) > 0, out).otherwise(none)

    return F.flatten(F.transform(T.sentences(answer), one))


def quote_candidates(quote: str, parts: list[str], top: int = 3, window: int = 3) -> list[str]:
    """Windows of neighbouring sentences that are most like a quote, best first, ties in order."""
    last = max(0, len(parts) - window)
    places = sorted((-partial_ratio(quote, " ".join(parts[i : i + window])), i) for i in range(last + 1)) if parts else []
    return [" ".join(parts[i : i + window]) for _, i in places[:top]]


def wrapped(text: Column, width: int) -> Column:
    """Text whose lines over width are broken after sentence ends, as full as they may be."""
    empty = F.struct(F.lit("").alias("done"), F.lit("").alias("line"))

    def add(state, piece):
        full = F.length(state["line"]) + 1 + F.length(piece) > width
        return (
            F.when(state["line"] == "", F.struct(state["done"].alias("done"), piece.alias("line")))
            .when(full, F.struct(F.concat(state["done"], state["line"], F.lit("\n")).alias("done"), piece.alias("line")))
            .otherwise(F.struct(state["done"].alias("done"), F.concat_ws(" ", state["line"], piece).alias("line")))
        )

    broken = lambda line: F.aggregate(F.split(line, r"(?<=[.!?])\s+"), empty, add, lambda s: F.concat(s["done"], s["line"]))
    return F.array_join(F.transform(F.split(text, "\n"), lambda line: F.when(F.length(line) <= width, line).otherwise(broken(line))), "\n")


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns with a citation of their number put behind each line; even ones get a refusing sentence."""
    turns = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    cited = F.concat(F.replace("text", F.lit("\n"), F.lit(" [1]\n")), F.lit(" ["), F.col("turn").cast("string"), F.lit("]"))
    return turns.select("conv_id", "turn", F.when(F.col("conv_id") % 2 == 0, F.concat(cited, F.lit("\nI cannot answer that."))).otherwise(cited).alias("answer"))


def citation_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = T.citation_check(F.col("answer"), F.lit(3), ["cannot answer"])
    return replies(spark, sf_dir).select("conv_id", "turn", c.alias("c")).select("conv_id", "turn", F.col("c.n_sentences").cast("bigint").alias("n_sentences"), F.array_join(F.col("c.invalid").cast("array<string>"), ",").alias("invalid"), F.col("c.uncited").cast("bigint").alias("uncited"), F.col("c.filler").cast("bigint").alias("filler"))


def refusal_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = T.refusal(F.col("answer"), "I cannot answer that", [], ["cannot", "answer"])
    out = replies(spark, sf_dir).select("conv_id", "turn", r.alias("r"))
    return out.select("conv_id", "turn", F.col("r.kind").alias("kind"), F.size("r.refused").cast("bigint").alias("n_refused"))


def label_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as judged items: quality and id give states, toxicity and id give handlings."""
    state = F.when(F.col("doc_id") % 7 == 0, "unclear").when(F.col("quality") == 1, F.when(F.col("doc_id") % 3 == 0, "partial").otherwise("present")).otherwise("absent")
    handling = F.when(F.col("toxic") == 1, F.when(F.col("doc_id") % 2 == 0, "refused").otherwise("ignored")).when(F.col("doc_id") % 5 == 0, "explained").when(F.col("doc_id") % 5 == 1, "answered_partly").otherwise("answered")
    return table(spark, sf_dir, "labels").select("doc_id", state.alias("state"), handling.alias("handling")).withColumn("outcome", outcome(F.col("state"), F.col("handling")))


def item_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = label_items(spark, sf_dir)
    right = F.sum((F.col("outcome") == "right").cast("bigint"))
    return items.groupBy("state", "handling", "outcome").agg(F.count("*").alias("n"), right.alias("correct"))


def item_counts_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return item_counts(label_items(spark, sf_dir).join(docs, "doc_id"), "source")


def label_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How toxicity agrees with low quality."""
    return agreement(table(spark, sf_dir, "labels").where("quality is not null and toxic is not null").select((F.col("toxic") == 1).alias("a"), (F.col("quality") == 0).alias("b")))


def judge_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies of a deterministic judge over all sentences of documents: supported if their length is even."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text")).select("doc_id", "lang", T.pieces(F.col("text")).alias("statements"))
    reply = F.to_json(F.struct(F.transform("statements", lambda s: F.struct(s.alias("statement"), (F.length(s) % 2 == 0).alias("supported"))).alias("verdicts")))
    scored = docs.withColumn("score", judged(reply, F.col("statements")))
    flagged = scored.withColumns({"excluded": F.when(F.size("statements") < 2, "few statements"), "error": F.when(F.col("score").isNull(), "format")})
    return criterion(flagged, ["lang"])


_PIECES = r"list_filter(list_transform(regexp_split_to_array(regexp_replace({0}, '([.!?])\s+', '\1' || chr(10), 'g'), '\n+'), lambda p: trim(p, ' ' || chr(9) || chr(10) || chr(13))), lambda p: p <> '')"
_REPLIES = """r as (select conv_id, turn, case when conv_id % 2 = 0 then a || chr(10) || 'I cannot answer that.' else a end as answer from (
  select conv_id, turn, replace(text, chr(10), ' [1]' || chr(10)) || ' [' || turn::varchar || ']' as a from conversations where role = 'assistant'))"""
# a piece of citations only goes to the piece before it, unless it is the first: then it stands alone
_SENTENCES = rf"""p as (select conv_id, turn, answer, {_PIECES.format('answer')} as ps from r),
e as (select conv_id, turn, unnest(ps) as piece, generate_subscripts(ps, 1) as i from p),
s as (select conv_id, turn, i, piece, sum(case when i > 1 and trim(regexp_replace(piece, '\[(\d+)\]', '', 'g')) = '' then 0 else 1 end) over (partition by conv_id, turn order by i) as g from e),
sent as (select conv_id, turn, g, string_agg(piece, ' ' order by i) as s from s group by all)"""
_STATE = """i as (select doc_id,
  case when doc_id % 7 = 0 then 'unclear' when quality = 1 then case when doc_id % 3 = 0 then 'partial' else 'present' end else 'absent' end as state,
  case when toxic = 1 then case when doc_id % 2 = 0 then 'refused' else 'ignored' end when doc_id % 5 = 0 then 'explained' when doc_id % 5 = 1 then 'answered_partly' else 'answered' end as handling
  from labels),
l as (select *, case state when 'absent' then 0 when 'partial' then 1 when 'present' then 2 end as known,
  case handling when 'refused' then 0 when 'answered_partly' then 1 when 'answered' then 2 when 'explained' then 2 end as given from i),
o as (select doc_id, state, handling, case
  when state in ('unclear', 'evasive') then case when handling = 'explained' then 'situation_told' else 'situation_untold' end
  when handling = 'ignored' then case when known = 0 then 'silent_omission' else 'omitted' end
  when known = given then 'right'
  when given < known then case when given = 0 then 'over_refusal' else 'needless_notice' end
  else case when known = 0 then 'unsupported' else 'partial_unmarked' end end as outcome from l)"""

QUERIES = {
    "citation_check": citation_check,
    "refusal_split": refusal_split,
    "item_outcomes": item_outcomes,
    "item_counts": item_counts_query,
    "label_agreement": label_agreement,
    "judge_scores": judge_scores,
}
ORACLES = {
    "citation_check": rf"""with {_REPLIES}, {_SENTENCES},
c as (select conv_id, turn, count(*) filter (not contains(s, 'cannot answer')) as n_sentences,
  count(*) filter (not contains(s, 'cannot answer') and not regexp_matches(s, '\[(\d+)\]')) as uncited, count(*) filter (contains(s, 'cannot answer')) as filler from sent group by all),
v as (select conv_id, turn, array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(answer, '\[(\d+)\]', 1), lambda n: n::int), lambda n: n < 1 or n > 3))), ',') as invalid from r)
select v.conv_id, v.turn, coalesce(n_sentences, 0) as n_sentences, invalid, coalesce(uncited, 0) as uncited, coalesce(filler, 0) as filler from v left join c using (conv_id, turn)""",
    "refusal_split": rf"""with {_REPLIES}, {_SENTENCES},
f as (select conv_id, turn, contains(replace(s, ' ', ''), 'cannot') and contains(replace(s, ' ', ''), 'answer') as no from sent),
c as (select conv_id, turn, count(*) filter (no) as n_refused, count(*) filter (not no) as other from f group by all)
select r.conv_id, r.turn, case when coalesce(n_refused, 0) = 0 then null when other > 0 then 'partial' else 'full' end as kind, coalesce(n_refused, 0) as n_refused from r left join c using (conv_id, turn)""",
    "item_outcomes": f"with {_STATE} select state, handling, outcome, count(*) as n, cast(sum(case when outcome = 'right' then 1 else 0 end) as bigint) as correct from o group by all",
    "item_counts": f"""with {_STATE} select source, count(*) filter (outcome = 'right') as correct, count(*) filter (state not in ('unclear', 'evasive')) as judged,
count(*) filter (outcome = 'over_refusal') as over_refusal, count(*) filter (outcome = 'unsupported') as unsupported from o join documents using (doc_id) group by source""",
    "label_agreement": """with c as (select count(*) filter (toxic = 1 and quality = 0) as tp, count(*) filter (toxic <> 1 and quality <> 0) as tn,
count(*) filter (toxic <> 1 and quality = 0) as fp, count(*) filter (toxic = 1 and quality <> 0) as fn from labels where quality is not null and toxic is not null),
x as (select *, tp + tn + fp + fn as n from c), y as (select *, (tp + tn) / n as po, ((tp + fn) * (tp + fp) + (tn + fp) * (tn + fn)) / (n * n) as pe from x)
select n, round(po, 6) as agreement, round((po - pe) / nullif(1 - pe, 0), 6) as kappa, round(tp / nullif(tp + fn, 0), 6) as tpr, round(tn / nullif(tn + fp, 0), 6) as tnr from y""",
    "judge_scores": f"""with p as (select doc_id, lang, {_PIECES.format('text')} as st from documents),
s as (select lang, st, case when len(st) > 0 then len(list_filter(st, lambda x: length(x) % 2 = 0)) / len(st) end as score from p)
select lang, round(avg(case when len(st) >= 2 then score end), 6) as mean, count(*) filter (len(st) >= 2 and score is not null) as n, count(*) filter (len(st) < 2) as excluded, count(*) filter (score is null) as errors from s group by lang""",
}
