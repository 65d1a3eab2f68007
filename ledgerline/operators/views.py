"""Views of documents and answers: names, listings, look-ups, places of chunks, prompt blocks, payloads, hints."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import table

#: Days of the week from Monday on, the audit's name among meeting kinds, the form of a shown date.
WEEK = "월화수목금토일"
AUDIT = "국정감사"
SHOWN = "%d년 %d월 %d일(%s)"
#: Fixed value: the numbers of a written date.
WRITTEN = r"^(\d{4})\D+(\d+)\D+(\d+)"


def day_of(written: Column) -> Column:
    """The day that the first three numbers of a written date name (the first has four digits); null if there is none."""
    part = lambda i: F.nullif(F.regexp_extract(written, WRITTEN, i), F.lit("")).cast("int")
    return F.try_make_timestamp(part(1), part(2), part(3), F.lit(0), F.lit(0), F.lit(0)).cast("date")


def shown_date(written: Column) -> Column:
    """One form for all written dates, with the day of the week; as it is where it names no day."""
    day = day_of(written)
    weekday = F.substring(F.lit(WEEK), F.weekday(day) + 1, F.lit(1))
    return F.when(day.isNull(), written).otherwise(F.format_string(SHOWN, F.year(day), F.month(day), F.day(day), weekday))


def source_name(date: Column, committee: Column, kind: Column) -> Column:
    """Day and committee, and the kind of an audit."""
    return F.concat_ws(" ", shown_date(date), committee, F.when(kind == AUDIT, kind))


def doc_name(date: Column, committee: Column, kind: Column, meeting: Column, session: Column) -> Column:
    """Day, committee, and the meeting's and session's numbers, which an audit does not have."""
    plain = F.coalesce(kind, F.lit("")) != AUDIT
    return F.concat_ws(" ", source_name(date, committee, kind), F.when(plain, meeting), F.when(plain, session))


def siblings(df: DataFrame, by: str, order: str, name: str) -> DataFrame:
    """df whose names have the row's number in its group, where the group has several rows."""
    n = F.row_number().over(Window.partitionBy(by).orderBy(order))
    several = F.count("*").over(Window.partitionBy(by)) > 1
    return df.withColumn(name, F.when(several, F.concat(F.col(name), F.lit(" #"), n.cast("string"))).otherwise(F.col(name)))


def told_apart(df: DataFrame, by: list[str], name: str, key: str) -> DataFrame:
    """df whose names have the key in brackets, where a group has the name several times; counts are aggregates, not windows."""
    again = df.groupBy(*by, name).agg(F.count("*").alias("n_same"))
    same = F.when(F.col("n_same") > 1, F.concat(F.col(name), F.lit(" ("), F.col(key).cast("string"), F.lit(")"))).otherwise(F.col(name))
    return df.join(again, [*by, name]).withColumn(name, same).drop("n_same")


def years(docs: DataFrame, date: str) -> DataFrame:
    """(year), the latest first."""
    return docs.select(F.year(date).alias("year")).where("year is not null").distinct().orderBy(F.desc("year"))


def meetings(docs: DataFrame, date: str, key: str, name: str) -> DataFrame:
    """(year, day, key, name) of each key's first day; the latest first, then the highest key."""
    first = docs.groupBy(key).agg(F.min_by(F.struct(F.col(date).cast("date").alias("day"), F.col(name).alias("name")), date).alias("d"))
    named = told_apart(first.select(F.year("d.day").alias("year"), "d.day", key, "d.name"), ["year"], "name", key)
    return named.orderBy(F.desc("year"), F.desc("day"), F.desc(key))


def fetch(rows: DataFrame, key: str, wanted: list) -> DataFrame:
    """Rows of a few keys, with their places in the request (ord); the file's statistics leave out what has none of them."""
    kind = rows.schema[key].dataType.simpleString()
    asked = rows.sparkSession.createDataFrame(list(enumerate(wanted)), f"ord int, {key} {kind}")
    return rows.where(F.col(key).isin(list(wanted))).join(F.broadcast(asked), key)


def place(text: Column, part: Column) -> Column:
    """struct(start, end) of a part's first place in a text, from 0; null where it is not there."""
    at = F.locate(part, text) if isinstance(part, str) else F.position(part, text)
    return F.when((at > 0) & (F.length(part) > 0), F.struct((at - 1).cast("bigint").alias("start"), (at - 1 + F.length(part)).cast("bigint").alias("end")))


def marked(text: Column, at: Column, marks: tuple[str, str]) -> Column:
    """A text with a paragraph of its own before and after a place; as it is without one."""
    bold = lambda m: F.lit(f"\n\n**{m}**\n\n")
    start, end = at["start"].cast("int"), at["end"].cast("int")
    cut = F.concat(F.substring(text, F.lit(1), start), bold(marks[0]), F.substring(text, start + 1, end - start), bold(marks[1]), F.substring(text, end + 1, F.length(text)))
    return F.when(at.isNull(), text).otherwise(cut)


def meta_line(fields: dict[str, Column], cut: dict[str, int] | None = None) -> Column:
    """'name: value | ...' of the fields that are not empty; fields in cut are shortened to so many characters."""
    part = lambda name, v: F.when((v.isNotNull()) & (v.cast("string") != ""), F.concat(F.lit(f"{name}: "), T.shortened(v.cast("string"), cut[name]) if name in (cut or {}) else v.cast("string")))
    return F.concat_ws(" | ", *(part(n, v) for n, v in fields.items()))


def doc_block(line: Column, chunk: Column, width: int) -> Column:
    """A document in a prompt: its line, an empty one, and the chunk with wrapped lines."""
    from .answers import wrapped

    return F.concat(line, F.lit("\n\n"), wrapped(chunk, width))


def agenda_items(agenda: Column, proposed: str = "발의") -> Column:
    """Numbered items of an agenda without brackets that end in who proposed them (a fixed word)."""
    bare = F.regexp_replace(agenda, rf"\([^()]*{proposed}\)", "")
    return F.filter(F.transform(F.split(bare, r"(?=(?<!\d)\d+\. )"), lambda x: F.trim(x)), lambda x: x != "")


def scope_target(query: Column, must: str, either: str) -> Column:
    """Whether a question has a word and a match of a pattern."""
    return query.contains(must) & query.rlike(either)


def doc_heads(text: Column) -> Column:
    """map<int, string> of lines '[n] head'."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"^\[\d+\] "))
    pairs = F.transform(lines, lambda x: F.struct(F.regexp_extract(x, r"^\[(\d+)\]", 1).cast("int").alias("key"), F.regexp_extract(x, r"^\[\d+\] (.*)$", 1).alias("value")))
    numbers = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
    last = lambda n: F.element_at(F.filter(pairs, lambda p: p["key"] == n), -1)["value"]
    return F.map_from_arrays(numbers, F.transform(numbers, last))


def no_citation(answer: Column, phrase: str) -> Column:
    """Whether an answer says something beside the phrase and cites nothing."""
    return F.exists(T.sentences(answer), lambda s: ~s.contains(phrase)) & (F.size(T.citations(answer)) == 0)


def speakers_named(answer: Column, contexts: Column) -> Column:
    """Names of speakers of the cited contexts (array<struct<n, names>>) that the answer has, sorted."""
    cited = F.filter(contexts, lambda c: F.array_contains(T.citations(answer), c["n"].cast("int")))
    return F.array_sort(F.array_distinct(F.filter(F.flatten(F.transform(cited, lambda c: c["names"])), lambda n: (n != "") & answer.contains(n))))


def context_payload(contexts: DataFrame) -> DataFrame:
    """What a page gets of a context: chosen columns only."""
    at = place(F.col("doc_text"), F.col("text"))
    none = F.lit(-1).cast("bigint")
    return contexts.select("n", shown_date(F.col("date")).alias("date"), "committee_name", source_name(F.col("date"), F.col("committee_name"), F.col("meeting_name")).alias("name"), "original", "doc_id", F.coalesce(at["start"], none).alias("start"), F.coalesce(at["end"], none).alias("end"), T.readable(F.col("text")).alias("body"))


def chunk_row(sizes: list[int], index_no: Column, chunk_id: Column) -> Column:
    """A chunk's number over several indexes of known sizes, one after the other."""
    before = F.array(*(F.lit(sum(sizes[:i])).cast("bigint") for i in range(len(sizes))))
    return F.element_at(before, index_no + 1) + chunk_id


def cited_split(answer: Column, n: Column) -> Column:
    """struct(cited, uncited): numbers of the n contexts by whether the answer cites them."""
    every = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    cited = F.array_intersect(every, T.citations(answer))
    return F.struct(cited.alias("cited"), F.array_except(every, cited).alias("uncited"))


def paragraphs(answer: Column) -> Column:
    return F.filter(F.transform(F.split(answer, r"\n\s*\n"), lambda p: F.trim(p)), lambda p: p != "")


def pool_docs(pools: DataFrame, docs: DataFrame, speakers: DataFrame) -> DataFrame:
    """Documents of pools (doc_ids) with their speakers, an empty array where there are none."""
    needed = pools.select(F.explode("doc_ids").alias("doc_id")).distinct()
    kind = speakers.schema["speakers"].dataType.simpleString()
    met = docs.join(needed, "doc_id", "left_semi").join(speakers, "doc_id", "left")
    return met.withColumn("speakers", F.coalesce("speakers", F.array().cast(kind)))


def first_pools(pools: DataFrame, n: int, order: str = "order") -> DataFrame:
    """Pools whose place among those of their type is under n."""
    return pools.where(F.col(order) < n)


def hints(statements: DataFrame, contexts: DataFrame, key: str = "qid") -> DataFrame:
    """statements (key, uid, text), contexts (key, n, text) -> (key, uid, n, hint): the sentence most like a statement, the first on ties."""
    from .similarity import partial_ratio

    parts = contexts.select(key, "n", F.posexplode(T.pieces(F.col("text"))).alias("place", "part"))
    listed = parts.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("n", "place", "part"))).alias("parts"))
    kinds = {c: statements.schema[c].dataType.simpleString() for c in (key, "uid")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best = [max(ps, key=lambda p: partial_ratio(t or "", p["part"])) for t, ps in zip(b.column("text").to_pylist(), b.column("parts").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(key), b.column("uid"), pa.array([p["n"] for p in best], pa.int32()), pa.array([p["part"] for p in best])], names=[key, "uid", "n", "hint"])

    return statements.join(listed, key).select(key, "uid", "text", "parts").mapInArrow(run, f"{key} {kinds[key]}, uid {kinds['uid']}, n int, hint string")


def order_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as meetings: year, day and name of the first order, names told apart within a year."""
    orders = table(spark, sf_dir, "orders").withColumn("name", F.concat_ws(" ", F.date_format("o_orderdate", "yyyy-MM-dd"), "o_orderpriority"))
    first = orders.groupBy("o_custkey").agg(F.min(F.struct("o_orderdate", "o_orderkey", "name")).alias("d"))
    named = told_apart(first.select("o_custkey", F.year("d.o_orderdate").cast("bigint").alias("year"), "d.name"), ["year"], "name", "o_custkey")
    return named.select("year", "o_custkey", "name")


def turn_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as documents of a conversation, numbered where there are several."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("conversation "), F.col("conv_id").cast("string")).alias("name"))
    return siblings(turns, "conv_id", "turn", "name")


def sentence_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each document's last piece, where it occurs first."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.try_element_at(T.pieces(F.col("text")), F.lit(-1)).alias("part"))
    return docs.select("doc_id", place(F.col("text"), F.col("part")).alias("at")).select("doc_id", "at.start", "at.end")


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", meta_line({"lang": F.col("lang"), "source": F.col("source"), "text": F.col("text")}, {"text": 30}).alias("line"))


def cited_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of five contexts replies cite."""
    from .answers import replies

    split = cited_split(F.col("answer"), F.lit(5))
    out = replies(spark, sf_dir).select("conv_id", "turn", split.alias("s"), no_citation(F.col("answer"), "cannot answer").alias("bare"))
    flat = lambda c: F.array_join(F.array_sort(F.col(c)).cast("array<string>"), ",")
    return out.select("conv_id", "turn", flat("s.cited").alias("cited"), flat("s.uncited").alias("uncited"), "bare")


QUERIES = {"order_listing": order_listing, "turn_names": turn_names, "sentence_places": sentence_places, "doc_lines": doc_lines, "cited_contexts": cited_contexts}
_P = r"list_filter(list_transform(regexp_split_to_array(regexp_replace({0}, '([.!?])\s+', '\1' || chr(10), 'g'), '\n+'), lambda p: trim(p, ' ' || chr(9) || chr(10) || chr(13))), lambda p: p <> '')"
ORACLES = {
    "order_listing": """with f as (select o_custkey, o_orderdate as d, o_orderkey, strftime(o_orderdate, '%Y-%m-%d') || ' ' || o_orderpriority as name from orders
  qualify row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) = 1),
n as (select year(d) as year, o_custkey, name, count(*) over (partition by year(d), name) as same from f)
select year, o_custkey, case when same > 1 then name || ' (' || o_custkey::varchar || ')' else name end as name from n""",
    "turn_names": """select conv_id, turn, 'conversation ' || conv_id::varchar || case when count(*) over (partition by conv_id) > 1 then ' #' || (row_number() over (partition by conv_id order by turn))::varchar else '' end as name from conversations""",
    "sentence_places": f"""with p as (select doc_id, text, {_P.format('text')}[-1] as part from documents), a as (select doc_id, part, strpos(text, part) as pos from p)
select doc_id, case when pos > 0 and length(part) > 0 then cast(pos - 1 as bigint) end as start, case when pos > 0 and length(part) > 0 then cast(pos - 1 + length(part) as bigint) end as "end" from a""",
    "doc_lines": """select doc_id, concat_ws(' | ', case when lang <> '' then 'lang: ' || lang end, case when source <> '' then 'source: ' || source end,
case when text <> '' then 'text: ' || case when length(text) > 30 then substr(text, 1, 30) || '…' else text end end) as line from documents""",
    "cited_contexts": r"""with r as (select conv_id, turn, case when conv_id % 2 = 0 then a || chr(10) || 'I cannot answer that.' else a end as answer from (
  select conv_id, turn, replace(text, chr(10), ' [1]' || chr(10)) || ' [' || turn::varchar || ']' as a from conversations where role = 'assistant')),
c as (select conv_id, turn, list_filter([1, 2, 3, 4, 5], lambda n: list_contains(list_transform(regexp_extract_all(answer, '\[(\d+)\]', 1), lambda x: x::int), n)) as cited,
  len(regexp_extract_all(answer, '\[(\d+)\]', 1)) = 0 as bare from r)
select conv_id, turn, array_to_string(cited, ',') as cited, array_to_string(list_filter([1, 2, 3, 4, 5], lambda n: not list_contains(cited, n)), ',') as uncited, bare from c""",
}
