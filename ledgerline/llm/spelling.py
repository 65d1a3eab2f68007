"""Spelling variants by anagram hashing.

A word's key is the sum of a power of each of its letters, so anagrams share it, and one added, removed or
exchanged letter changes it by that letter's value, or by the difference of two. Words are joined where
keys differ so: each word gives, for every letter that it has, the key without it (its rest). Words that
share a rest differ by an exchange; a word whose rest is another's key has one letter more. Only letters
whose rest is shared go on to the check of letter order: each place of the letter gives a digest of what
stays in order, and words of one rest meet where place and digest are the same. So anagrams that merely
share a key never become rows of pairs: what meets is near, and at most one word for each letter of the
alphabet meets at a place.

Words are the runs of letters of whole texts. Runs are counted in the tasks before they are summed by
word, so a word that a third of all documents have is no single task's burden; the table of words is sorted
once, and a word's number stands for it in all joins.

Null and empty texts have no words. Repeated rows count each time. Words have a null form if no near word
is frequent enough. An empty table gives no rows. Other columns are not looked at. The check of order takes
time that grows with the square of a word's length, for words that share a rest.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Code points of a word and its occurrences, at least; times that a form is more frequent than its variant.
LENGTH, OCCURRENCES, TIMES = 6, 5, 5
#: Power of a letter's code point that is its value; keys are sums modulo this prime.
POWER, PRIME = 5, (1 << 61) - 1
#: Words of a task's counts that are held before they are passed on.
HELD = 200_000
#: Every so many (document, run) pairs one loses a letter, as in the query.
TYPOS = 199

#: Bytes of Latin-1: letters of words, A-Z in lower case; all others become spaces.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


def runs(text: str) -> list[bytes]:
    """Maximal runs of A-Z, a-z and U+00C0 to U+00FF in Latin-1, A-Z in lower case."""
    return text.encode("latin-1", "replace").translate(_LETTERS).split()


def with_typos(doc_id: int | None, counts: Counter) -> Counter:
    """One of TYPOS runs of a document, by the checksum of `id:run`, loses the code point at checksum modulo length; none without an id."""
    if doc_id is None:
        return counts
    start = zlib.crc32(b"%d:" % doc_id)
    out = Counter()
    for run, n in counts.items():
        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
        if h % TYPOS == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        out[run] += n
    return out


def counted(docs: DataFrame, change: Callable[[int | None, Counter], Counter] | None = None, length: int = LENGTH, least: int = OCCURRENCES) -> DataFrame:
    """(word, n) of whole texts; change: what a document's counts of runs become."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def passed_on() -> pa.RecordBatch:
            words = pa.array([w.decode("latin-1") for w in held], pa.string())
            n = pa.array(held.values(), pa.int64())
            held.clear()
            return pa.RecordBatch.from_arrays([words, n], names=["word", "n"])

        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                if not text:
                    continue
                found = Counter(w for w in runs(text) if len(w) >= length)
                for w, n in (change(doc_id, found) if change else found).items():
                    if len(w) >= length:
                        held[w] += n
                if len(held) > HELD:
                    yield passed_on()
        if held:
            yield passed_on()

    each = docs.select("doc_id", "text").mapInArrow(run, "word string, n bigint")
    return each.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _value(letter: Column) -> Column:
    return F.pmod(F.pow(F.ascii(letter), F.lit(POWER)).cast("bigint"), F.lit(PRIME))


def keyed(words: DataFrame) -> DataFrame:
    """(id, word, n, key), written; ids ascend with the words in code-point order."""
    ordered = words.repartitionByRange("word").sortWithinPartitions("word").withColumn("id", F.monotonically_increasing_id())
    key = F.aggregate(F.split("word", ""), F.lit(0).cast("bigint"), lambda a, c: F.pmod(a + _value(c), F.lit(PRIME)))
    return common.scratch(ordered.select("id", "word", "n", key.alias("key")), "words")


def removals(words: DataFrame) -> DataFrame:
    """(id, word, n, letter, rest): a row for each letter of a word; rest is the key without the letter."""
    each = words.select("id", "word", "n", "key", F.explode(F.array_distinct(F.split("word", ""))).alias("letter"))
    return each.select("id", "word", "n", "letter", F.pmod(F.col("key") - _value(F.col("letter")), F.lit(PRIME)).alias("rest"))


def shared_rests(words: DataFrame) -> DataFrame:
    """(rest, exchanged, is_key): rests that several letters lead to, or that are a word's key."""
    each = removals(words).select("rest", "letter").unionByName(words.select(F.col("key").alias("rest"), F.lit("").alias("letter")))
    letters = F.collect_set("letter")  # at most the alphabet
    found = each.groupBy("rest").agg(letters.alias("letters"))
    is_key = F.array_contains("letters", "")
    return found.select("rest", (F.size("letters") - is_key.cast("int") > 1).alias("exchanged"), is_key.alias("is_key")).where(F.size("letters") > 1)


def near(words: DataFrame) -> DataFrame:
    """words (id, word, n, key) -> (id, n_near, best): number of near words, and the (n, -id) of the most frequent, ties to the smallest word."""
    met = removals(words).join(common.scratch(shared_rests(words), "rests"), "rest")
    places = F.filter(F.sequence(F.lit(1), F.length("word")), lambda i: F.substring(F.col("word"), i, F.lit(1)) == F.col("letter"))
    each = met.select("rest", "exchanged", "is_key", "id", "n", "word", "letter", F.explode(places).alias("at"))
    stays = F.concat(F.substring(F.col("word"), F.lit(1), F.col("at") - 1), F.substring(F.col("word"), F.col("at") + 1, F.length("word")))
    # in a run of one letter, each removal leaves the same
    first = (F.col("at") == 1) | (F.substring(F.col("word"), F.greatest(F.col("at") - 1, F.lit(1)), F.lit(1)) != F.col("letter"))
    each = common.scratch(each.select("rest", "exchanged", (F.col("is_key") & first).alias("is_key"), "id", F.struct("n", (-F.col("id")).alias("id")).alias("as_best"), "at", F.xxhash64(stays).alias("left")), "places")
    # words that are the same but for the letter at one place: one for each letter at most
    groups = each.where("exchanged").groupBy("rest", "at", "left").agg(F.sort_array(F.collect_list("as_best"), asc=False).alias("all")).where(F.size("all") > 1)
    groups = groups.select("all", F.explode("all").alias("own"))
    exchanged = groups.select((-F.col("own.id")).alias("id"), (F.size("all") - 1).cast("bigint").alias("n_near"), F.when(F.col("all")[0] == F.col("own"), F.col("all")[1]).otherwise(F.col("all")[0]).alias("best"))
    shorter = words.select(F.col("key").alias("rest"), F.xxhash64("word").alias("left"), F.col("id").alias("shorter"), F.struct("n", (-F.col("id")).alias("id")).alias("of_shorter"))
    removed = each.where("is_key").join(shorter, ["rest", "left"])
    one = F.lit(1).cast("bigint").alias("n_near")
    links = exchanged.unionByName(removed.select("id", one, F.col("of_shorter").alias("best"))).unionByName(removed.select(F.col("shorter").alias("id"), one, F.col("as_best").alias("best")))
    return links.groupBy("id").agg(F.sum("n_near").alias("n_near"), F.max("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(id, form) -> (id, root): follows forms to the last, twice as far in each round."""
    at = common.scratch(forms.select("id", F.col("form").alias("root")), "roots")
    while True:
        onward = at.select(F.col("id").alias("root"), F.col("root").alias("next"))
        moved = common.scratch(at.join(onward, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        at = moved.select("id", "root")
        if moved.where("moved").isEmpty():
            return at


def variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """words (word, n), distinct -> (word, form, root, n, n_near, form_n)."""
    words = keyed(words)
    linked = common.scratch(words.select("id", "n").join(near(words), "id"), "near")
    form = F.when(F.col("best.n") >= times * F.col("n"), -F.col("best.id"))
    formed = linked.select("id", "n_near", form.alias("form"))
    ends = roots(formed.where("form is not null").select("id", "form"))
    named = words.select(F.col("id").alias("form"), F.col("word").alias("form_word"), F.col("n").alias("form_n"))
    last = words.select(F.col("id").alias("root"), F.col("word").alias("root_word"))
    known = ends.join(last, "root").select("id", "root_word")
    out = words.join(formed, "id", "left").join(named, "form", "left").join(known, "id", "left")
    return out.select("word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), "form_n")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(counted(common.read(spark, sf_dir, "documents"), with_typos))


#: Near words share what is left without one letter, at the same place; a shorter word is what is left.
OP13_SQL = f"""
with recursive runs as (
  select doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run, count(*) as c
  from (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) as r from documents) where length(r) >= {LENGTH} group by all
), digest as (
  select run, c, case when doc_id is not null then xor(4294967295, list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(
    regexp_extract_all(hex(encode(doc_id || ':' || run)), '..'), lambda b: [cast('0x' || b as bigint), 0, 0, 0, 0, 0, 0, 0]))),
    lambda s, b: xor(xor(s, b) >> 1, 3988292384 * (xor(s, b) & 1)))) end as h from runs
), words as (
  select word, cast(sum(c) as bigint) as n from (
    select c, case when h % {TYPOS} = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end as word from digest
  ) where length(word) >= {LENGTH} group by word having sum(c) >= {OCCURRENCES}
), cut as (
  select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) as stays from (select word, n, unnest(range(1, length(word) + 1)) as i from words)
), links as (
  select a.word, b.word as other, b.n from cut a join cut b on a.i = b.i and a.stays = b.stays and a.word <> b.word
  union select c.word, w.word, w.n from cut c join words w on w.word = c.stays
  union select w.word, c.word, c.n from cut c join words w on w.word = c.stays
), best as (select word, count(*) as n_near, arg_min(other, (-n, other)) as form, max(n) as form_n from links group by word
), formed as (
  select w.word, w.n, coalesce(n_near, 0) as n_near, case when form_n >= {TIMES} * w.n then form end as form, case when form_n >= {TIMES} * w.n then form_n end as form_n
  from words w left join best b on b.word = w.word
), walk as (
  select word, word as root from formed union all select walk.word, form from walk join formed f on f.word = walk.root where form is not null
)
select f.word, form, root, f.n, n_near, form_n from formed f
join (select word, root from walk join (select word as root from formed where form is null) using (root)) using (word)"""

QUERIES = {"op13_spelling": op13_spelling}
ORACLES = {"op13_spelling": OP13_SQL}
