"""Secret scans: patterns of known forms, and values in credential contexts judged by their guess cost.

Known forms (assignments to a secret's name, access keys, long hexadecimal runs) are found by pattern. A
value that follows a wider list of names, or the password of a URL, is a secret if it is hard to guess: its
cost, a decimal logarithm of guesses, is that of the cheapest way to cut it into words, dates, repeats,
keyboard walks and brute-force spans (dynamic programming over its places; each span pays for its kind, too).

A word costs the logarithm of its rank by frequency among all words of the corpus, found secrets and
values left out, so a value is no witness for itself. The dictionary is never sent out: values ask for the
words that they might have, and these meet the counts of the corpus by a join.

Whole texts. Null and empty texts have no spans; repeated rows have a row each; null doc_ids are allowed.
Long values are judged whole, in time that grows with their length. Other columns are not looked at.
An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, spelling

#: Kinds of spans in order; `guess` are the values that the guess cost adds.
KINDS = ("assign", "access", "hex", "guess")
#: The known forms, and what a match has at least of them (fixed values).
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LENGTH, ACCESS_LENGTH = 12, 18
#: Credential contexts: a name, a separator and a value of VALUE characters or more; the password in a URL.
VALUE = 8
NAMES = r"pass(?:word|wd|phrase|code)?|pwd|secret|token|api_?key|auth(?:orization)?|credentials?|private_?key|access_?key|login"
CONTEXT = re.compile(rf"""(?<![A-Za-z])(?:{NAMES})["']?\x20*(?:=>|:=|[:=])\x20*(?:(?:bearer|basic)\x20+)?["']?([^\s"'`<>,;]{{{VALUE},}})|://[^\s/:@"']+:([^\s/@"']{{{VALUE},}})@""", re.I | re.A)
#: Texts without this have none of all these.
ANY = rf"""(?i:password|passwd|{NAMES})|AKIA|[0-9a-f]{{16}}|://[^\s/:@"']+:[^\s/@"']{{{VALUE},}}@"""
#: Guesses from which a value is a secret, as a decimal logarithm.
HARD = 10.0
#: Letters of a dictionary word, and occurrences of it at least.
WORD, WORD_LENGTHS = 3, range(3, 17)
#: Periods of a repeat, characters of a keyboard walk at least, days of the dates that are tried and their separators.
PERIODS, WALK, DAYS, SEPARATORS = range(1, 9), 4, 200 * 366, 4
#: Rows of a keyboard, each half a key to the right of the one before (fixed values).
KEYS = ("`1234567890-=", " qwertyuiop[]\\", " asdfghjkl;'", " zxcvbnm,./")
SHIFTED = dict(zip('~!@#$%^&*()_+{}|:"<>?', "`1234567890-=[]\\;',./"))
PLACES = {c: (x, y) for y, row in enumerate(KEYS) for x, c in enumerate(row) if c != " "}
#: Steps to a neighbouring key: along a row, up and down.
STEPS = {(-1, 0), (1, 0), (0, -1), (1, -1), (0, 1), (-1, 1)}
KIND_COST = math.log10(5)
DATE = re.compile(
    r"(?=(?:"
    r"((?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\2(?:0[1-9]|[12]\d|3[01]))"
    r"|((?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\4(?:19|20)\d\d)"
    r"|((?:0[1-9]|1[0-2])([-/._]?)(?:0[1-9]|[12]\d|3[01])\6(?:19|20)\d\d)))",
    re.A,
)
YEAR = re.compile(r"(?=((?:19|20)\d\d))", re.A)
SPAN = "array<struct<start:int,kind:int,end:int>>"


def known_forms(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the known forms, leftmost and without overlaps for each kind."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= ASSIGN_LENGTH]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LENGTH]
    return sorted(out + [(m.start(), 2, m.end()) for m in HEX.finditer(text)])


def credential_values(text: str) -> list[tuple[int, int]]:
    """(start, end) of values in credential contexts."""
    return [m.span(m.lastindex) for m in CONTEXT.finditer(text)]


def words_of(value: str) -> set[str]:
    """What might be a word in a value: parts of its runs of letters."""
    out = set()
    for run in re.findall(r"[^\W\d_]+", value.lower()):
        out.update(run[i : i + n] for n in WORD_LENGTHS for i in range(len(run) - n + 1))
    return out


def letter_cost(c: str) -> float:
    return math.log10(26 if c.isascii() and c.isalpha() else 10 if c.isascii() and c.isdigit() else 33 if c.isascii() else 100)


def case_cost(word: str) -> float:
    """Guesses of where capitals are."""
    high = sum(c.isupper() for c in word)
    if not high:
        return 0.0
    if high == len(word) or (high == 1 and (word[0].isupper() or word[-1].isupper())):
        return math.log10(2)
    return math.log10(sum(math.comb(len(word), k) for k in range(1, min(high, len(word) - high) + 1)) + 1)


def walks(value: str) -> Iterator[tuple[int, int, float]]:
    """Maximal keyboard walks of one character more than a step: where to begin, and the turns."""
    at = [PLACES.get(SHIFTED.get(c, c.lower())) for c in value]
    start, turns, last = 0, 0, None
    for i in range(1, len(value) + 1):
        step = (at[i][0] - at[i - 1][0], at[i][1] - at[i - 1][1]) if i < len(value) and at[i] and at[i - 1] else None
        if step in STEPS:
            turns += step != last
            last = step
            continue
        if i - start >= WALK:
            yield start, i, math.log10(len(PLACES)) + turns * math.log10(len(STEPS)) + math.log10(i - start)
        start, turns, last = i, 0, None


def repeats(value: str, ranks: dict[str, float]) -> Iterator[tuple[int, int, float]]:
    """Maximal repeats of blocks: three times a character, or twice a longer block; the block's cost and the count."""
    for period in PERIODS:
        start = 0
        for i in range(period, len(value) + 1):
            if i < len(value) and value[i] == value[i - period]:
                continue
            times, rest = divmod(i - start, period)
            if times >= (3 if period == 1 else 2):
                block = value[start : start + period]
                if period == 1 or not any(block == block[: period // k] * k for k in range(2, period + 1) if period % k == 0):
                    inner = letter_cost(block) if period == 1 else guess_cost(block, ranks, False)
                    yield start, i - rest, inner + math.log10(times)
            start = i - period + 1
    return


def spans(value: str, ranks: dict[str, float], blocks: bool = True) -> Iterator[tuple[int, int, float]]:
    """(start, end, cost) of what in a value is cheaper than brute force may be. ranks: word -> logarithm of its rank."""
    low = value.lower()
    if len(low) == len(value) and ranks:
        for m in re.finditer(r"[^\W\d_]+", low):
            for i in range(m.start(), m.end()):
                for n in WORD_LENGTHS:
                    if i + n > m.end():
                        break
                    if (rank := ranks.get(low[i : i + n])) is not None:
                        yield i, i + n, rank + case_cost(value[i : i + n])
    for m in DATE.finditer(value):
        for whole, mark in ((1, 2), (3, 4), (5, 6)):
            if m[whole]:
                yield m.start(whole), m.end(whole), math.log10(DAYS) + (math.log10(SEPARATORS) if m[mark] else 0)
    for m in YEAR.finditer(value):
        yield m.start(1), m.end(1), math.log10(200)
    yield from walks(value)
    if blocks:
        yield from repeats(value, ranks)


def guess_cost(value: str, ranks: dict[str, float], blocks: bool = True) -> float:
    """Logarithm of guesses of the cheapest way to cut a value into spans."""
    ending: dict[int, list[tuple[int, float]]] = {}
    for i, j, cost in spans(value, ranks, blocks):
        ending.setdefault(j, []).append((i, cost))
    best, brute = [0.0], math.inf
    for j, c in enumerate(value, 1):
        brute = min(brute, best[-1] + KIND_COST) + letter_cost(c)
        best.append(min([brute, *(best[i] + KIND_COST + cost for i, cost in ending.get(j, ()))]))
    return best[-1]


def _may_have(texts: pa.Array) -> list[bool]:
    return pc.fill_null(pc.match_substring_regex(texts, ANY), False).to_pylist()


def found(docs: DataFrame) -> DataFrame:
    """(row, doc_id, known, places, values): known forms, and values in credential contexts with their places; written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.in_bounds(batches):
            known, places, values = [], [], []
            for text, may in zip(b.column("text"), _may_have(b.column("text"))):
                text = text.as_py() if may else ""
                known.append([{"start": s, "kind": k, "end": e} for s, k, e in known_forms(text)])
                at = credential_values(text)
                places.append([{"start": s, "kind": 3, "end": e} for s, e in at])
                values.append([text[s:e] for s, e in at])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(known, kind), pa.array(places, kind), pa.array(values, pa.list_(pa.string()))], names=["doc_id", "known", "places", "values"])

    each = docs.select("doc_id", "text").mapInArrow(run, f"doc_id bigint, known {SPAN}, places {SPAN}, values array<string>")
    return common.scratch(each.withColumn("row", F.monotonically_increasing_id()), "found")


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of the corpus, without what `found` finds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def passed_on() -> pa.RecordBatch:
            words, n = pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(held.values(), pa.int64())
            held.clear()
            return pa.RecordBatch.from_arrays([words, n], names=["word", "n"])

        for b in common.in_bounds(batches):
            for text, may in zip(b.column("text").to_pylist(), _may_have(b.column("text"))):
                if may:
                    at = 0
                    kept = []
                    for s, e in sorted([(s, e) for s, _, e in known_forms(text)] + credential_values(text)):
                        kept.append(text[at:s])
                        at = max(at, e)
                    text = " ".join([*kept, text[at:]])
                held.update(w for w in spelling.runs(text or "") if len(w) in WORD_LENGTHS)
                if len(held) > spelling.HELD:
                    yield passed_on()
        if held:
            yield passed_on()

    each = docs.select("text").mapInArrow(run, "word string, n bigint")
    return each.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= WORD)


def ranked(counts: DataFrame) -> DataFrame:
    """(n, rank): logarithm of the number of words that occur n times or more; a row for each count that there is."""
    by = counts.groupBy("n").agg(F.count("*").alias("words"))  # few rows: m different counts need m * m / 2 occurrences
    return by.select("n", F.log10(F.sum("words").over(Window.orderBy(F.desc("n")))).alias("rank"))


def costs(values: DataFrame, docs: DataFrame) -> DataFrame:
    """values (value), distinct -> (value, cost), by the words of docs."""
    values = common.scratch(values.withColumn("id", F.monotonically_increasing_id()), "values")

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.in_bounds(batches, "value", 1 << 18):
            rows = [(i, w) for i, v in zip(b.column("id").to_pylist(), b.column("value").to_pylist()) for w in words_of(v)]
            for k in range(0, len(rows), 1 << 16):
                i, w = zip(*rows[k : k + (1 << 16)])
                yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(w)], names=["id", "word"])

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.in_bounds(batches, "value", 1 << 20):
            known = [{} if w is None else {x["word"]: x["rank"] for x in w} for w in b.column("words").to_pylist()]
            cost = [guess_cost(v, k) for v, k in zip(b.column("value").to_pylist(), known)]
            yield pa.RecordBatch.from_arrays([b.column("value"), pa.array(cost, pa.float64())], names=["value", "cost"])

    wanted = common.scratch(values.mapInArrow(asked, "id bigint, word string"), "asked")
    counts = common.scratch(word_counts(docs), "counts")
    known = wanted.join(counts, "word").join(ranked(counts), "n")
    lists = known.groupBy("id").agg(F.collect_list(F.struct("word", "rank")).alias("words"))  # bounded by the value's length
    return values.join(lists, "id", "left").select("value", "words").mapInArrow(judged, "value string, cost double")


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")


def scan(docs: DataFrame, hard: float = HARD) -> DataFrame:
    """(doc_id, known, guessed): the spans of each row of docs, as arrays of (start, kind, end)."""
    rows = found(docs)
    each = rows.where(F.size("values") > 0).select("row", F.explode(F.arrays_zip("places", "values")).alias("v")).select("row", "v.places", F.col("v.values").alias("value"))
    judged = common.scratch(costs(each.select("value").distinct(), docs).where(F.col("cost") >= hard), "hard")
    hits = each.join(judged.select("value"), "value").groupBy("row").agg(F.collect_list("places").alias("guessed"))
    return rows.select("row", "doc_id", "known").join(hits, "row", "left").select("doc_id", "known", F.coalesce("guessed", F.array().cast(SPAN)).alias("guessed"))


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(common.read(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("known", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{KINDS[k]}")
    return out.select(
        "doc_id", count(0), count(1), count(2), F.sha2(_joined(F.col("known")), 256).alias("base_sha256"),
        _joined(F.concat("known", "guessed")).alias("spans"), F.size("guessed").cast("bigint").alias("n_guess"),
    )


QUERIES = {"op12_secrets": op12_secrets}
#: SQL has no dynamic programming over a value; tests hold the query against every way to cut it.
ORACLES: dict[str, str] = {}
