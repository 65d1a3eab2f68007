"""Conversations: history for a turn, repetition, replay; page and event scalars."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import table
from .similarity import ratios

TURNS, MOST_CHARS, REPEAT = 3, 3000, 0.6
#: Lengths of the substrings by which the longest block is looked for, one after another.
GRAMS = (8, 4, 2, 1)
#: Tasks for each core that compare texts.
WAVES = 4


def clean_turns(turns: DataFrame) -> DataFrame:
    """Turns with a role and a text, citations taken out, cut to MOST_CHARS."""
    text = F.substring(F.trim(F.regexp_replace("text", r"\s*\[\d+\]", "")), 1, MOST_CHARS)
    return turns.where("role is not null and text is not null").withColumn("text", text).where("text <> ''")


def history(turns: DataFrame, n: int = TURNS) -> DataFrame:
    """For each user turn, the n turns before it in order; a bounded frame of the conversation's rows."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-n, -1)
    before = F.collect_list(F.concat(F.col("role"), F.lit(": "), F.col("text"))).over(w)
    return clean_turns(turns).withColumn("history", before).where("role = 'user'")


def _longest(a: str, at: dict[str, list[int]], gram: int, alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int, int]:
    """The longest block of `gram` characters or more in a[alo:ahi] and b[blo:bhi], the first in a and then in b; at: places of b's grams."""
    besti, bestj, best, last, end = alo, blo, 0, {}, bhi - gram + 1
    for i in range(alo, ahi - gram + 1):
        now, places = {}, at.get(a[i : i + gram])
        if places:
            for j in places[bisect_left(places, blo) : bisect_left(places, end)]:
                k = now[j] = last.get(j - 1, 0) + 1
                if k > best:
                    besti, bestj, best = i - k + 1, j - k + 1, k
        last = now
    return besti, bestj, best and best + gram - 1


def ratio(a: str, b: str) -> float:
    """difflib.SequenceMatcher(None, a, b, autojunk=False).ratio().

    The longest block is looked for by its longer substrings first, which have few places; where there is
    none, the parts have none either.
    """
    if not a and not b:
        return 1.0
    known: dict[int, dict[str, list[int]]] = {}
    left, matched = [(0, len(a), 0, len(b), 0)], 0
    while left:
        alo, ahi, blo, bhi, level = left.pop()
        while level < len(GRAMS):
            gram = GRAMS[level]
            if gram not in known:
                at = known[gram] = {}
                for j in range(len(b) - gram + 1):
                    at.setdefault(b[j : j + gram], []).append(j)
            i, j, size = _longest(a, known[gram], gram, alo, ahi, blo, bhi)
            if size:
                matched += size
                if alo < i and blo < j:
                    left.append((alo, i, blo, j, level))
                if i + size < ahi and j + size < bhi:
                    left.append((i + size, ahi, j + size, bhi, level))
                break
            level += 1
    return 2 * matched / (len(a) + len(b))


def _followed(turns: DataFrame) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    pairs = turns.where("role = 'assistant' and text is not null").withColumn("before", F.lag("text").over(w)).where("before is not null")
    # the comparison is the work, by pair and not by conversation; a given number of tasks is not made smaller for few bytes
    return pairs.select("conv_id", "turn", "before", "text").repartition(WAVES * turns.sparkSession.sparkContext.defaultParallelism)


def repetition(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, ratio, alike): how alike an assistant's turn is to the one before.

    ratio: share of characters in matching blocks of the sequence matcher; alike: of those in a longest common subsequence.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            before, text = b.column("before").to_pylist(), b.column("text").to_pylist()
            found = [round(ratio(x, y), 6) for x, y in zip(before, text)]
            alike = np.round(ratios(before, text), 6)
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("turn"), pa.array(found, pa.float64()), pa.array(alike)], names=["conv_id", "turn", "ratio", "alike"])

    return _followed(turns).mapInArrow(run, "conv_id bigint, turn bigint, ratio double, alike double")


def repeats(turns: DataFrame, least: float = REPEAT) -> DataFrame:
    """(conv_id, turn, repeat): whether an assistant's turn repeats the one before, by a ratio of `least`.

    Matching blocks are common subsequences, so only pairs that these leave possible go to the sequence matcher.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            before, text = b.column("before").to_pylist(), b.column("text").to_pylist()
            found = [bool(r >= least and ratio(x, y) >= least) for r, x, y in zip(ratios(before, text, least), before, text)]
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("turn"), pa.array(found, pa.bool_())], names=["conv_id", "turn", "repeat"])

    return _followed(turns).mapInArrow(run, "conv_id bigint, turn bigint, repeat boolean")


def replay(turns: DataFrame, answer: Callable[[str, list], str | None]) -> DataFrame:
    """(conv_id, turn, answer): user turns answered in order; a turn without an answer does not enter the history.

    A conversation's turns stream through one task in order; what is kept is its last TURNS answers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conversation, past = None, []
        for b in batches:
            out = []
            for c, text in zip(b.column("conv_id").to_pylist(), b.column("text").to_pylist()):
                if c != conversation:
                    conversation, past = c, []
                got = answer(text, past)
                out.append(got)
                if got:
                    past = [*past, (text, got)][-TURNS:]
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("turn"), pa.array(out, pa.string())], names=["conv_id", "turn", "answer"])

    asked = turns.where("role = 'user' and text <> ''").select("conv_id", "turn", "text")
    return asked.repartition("conv_id").sortWithinPartitions("conv_id", "turn").mapInArrow(run, "conv_id bigint, turn bigint, answer string")


def conversation_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = history(table(spark, sf_dir, "conversations"))
    return out.select("conv_id", "turn", F.size("history").cast("bigint").alias("n"), F.length(F.array_join("history", "\n")).cast("bigint").alias("chars"), F.sha1(F.array_join("history", "\n").cast("binary")).alias("digest"))


def conversation_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition(table(spark, sf_dir, "conversations"))


def conversation_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deterministic stand-in answers with the first sentence and the number of turns it was told of."""
    return replay(table(spark, sf_dir, "conversations"), lambda text, past: f"{text.split('.')[0]} [{len(past)}]" if len(text) % 5 else None)


def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles and text lengths of pages, scripts, styles, comments and marks taken out."""
    pages = table(spark, sf_dir, "pages").where("html is not null")
    title = F.regexp_extract("html", r"(?s)<title>([^<]*)</title>", 1)
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace("html", r"(?s)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>", " "), r"(?s)<!--.*?-->", " "), r"<[^>]*>", " ")
    text = F.trim(F.regexp_replace(bare, r"[ \t\r\n]+", " "))
    return pages.select("page_id", title.alias("title"), F.length(text).cast("bigint").alias("chars"), F.length(T.readable(text)).cast("bigint").alias("escaped"))


def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = lambda q: F.round(F.percentile("value", q), 6)
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), p(0.5).alias("p50"), p(0.95).alias("p95"), F.max("value").alias("largest"))


def event_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_if(k.isNotNull()).alias("n"), F.sum(k).cast("bigint").alias("total"), F.max(k).alias("largest"))


QUERIES = {
    "conversation_history": conversation_history,
    "conversation_repetition": conversation_repetition,
    "conversation_replay": conversation_replay,
    "page_text": page_text,
    "latency_percentiles": latency_percentiles,
    "event_props": event_props,
}
ORACLES = {
    "conversation_history": r"""with c as (select conv_id, turn, role, substr(trim(regexp_replace(text, '\s*\[\d+\]', '', 'g')), 1, 3000) as text from conversations where role is not null and text is not null),
h as (select conv_id, turn, role, list(role || ': ' || text) over (partition by conv_id order by turn rows between 3 preceding and 1 preceding) as h from c where text <> '')
select conv_id, turn, coalesce(len(h), 0) as n, length(coalesce(array_to_string(h, chr(10)), '')) as chars, sha1(coalesce(array_to_string(h, chr(10)), '')) as digest from h where role = 'user'""",
    "page_text": r"""with b as (select page_id, html, regexp_replace(regexp_replace(regexp_replace(html, '(?s)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g') as t from pages where html is not null),
t as (select page_id, html, trim(regexp_replace(t, '[ \t\r\n]+', ' ', 'g')) as t from b)
select page_id, regexp_extract(html, '(?s)<title>([^<]*)</title>', 1) as title, length(t) as chars,
length(regexp_replace(replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), ' {2,}', chr(10) || chr(10), 'g')) as escaped from t""",
    "latency_percentiles": """select event_type, count(*) as n, round(avg(value), 6) as mean, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95, max(value) as largest from events group by all""",
    "event_props": """select event_type, count(k) as n, cast(sum(k) as bigint) as total, max(k) as largest from (select event_type, cast(json_extract_string(props, '$.k') as int) as k from events) group by all""",
}
