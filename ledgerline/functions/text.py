"""Scalar text functions as Column expressions; all stay inside the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tokens of the default tokenizer.
TOKEN = r"[\p{L}\p{N}]+"
#: Fixed value: the form of a citation.
CITATION = r"\[(\d+)\]"


def tokens(text) -> Column:
    """Lower-cased runs of letters and digits, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def collapsed(text) -> Column:
    """White space runs (all of Unicode's) as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def squeezed(text) -> Column:
    """Without white space."""
    return F.regexp_replace(text, r"(?U)\s+", "")


def content_key(cluster, text, digits: int = 10) -> Column:
    """A document key: the cluster and the first digits of the text's SHA-1."""
    return F.concat(cluster, F.lit("-"), F.substring(F.sha1(text.cast("binary") if isinstance(text, Column) else F.col(text).cast("binary")), 1, digits))


def person_name(name: Column, titles: list[str]) -> Column:
    """A name without a bracket at its end and without a title beside it.

    With white space left, the first part is the name if the last ends with a title or is one character.
    """
    bare = F.trim(F.regexp_replace(name, r"(?U)\s*[(（][^)）]*[)）]$", ""))
    parts = F.split(bare, r"(?U)\s+")
    last = F.element_at(parts, -1)
    titled = F.length(last) == 1
    for t in titles:
        titled = titled | last.endswith(t)
    return F.when(bare.contains(" "), F.when(titled, parts[0]).otherwise(last)).otherwise(bare)


def full_year(y4: Column, y2: Column) -> Column:
    """Four digits as they are; two digits up to 30 are 20YY, others 19YY."""
    return F.when(F.coalesce(y4, F.lit("")) != "", y4).otherwise(F.concat(F.when(y2.cast("int") <= 30, "20").otherwise("19"), y2))


def date_keys(year: Column, month: Column, day: Column) -> Column:
    """Keys of each given precision, coarse first; a day without a month is dropped."""
    has = lambda c: c.isNotNull() & (c.cast("string") != "")
    two = lambda c: F.lpad(c.cast("int").cast("string"), 2, "0")
    y = year.cast("string")
    month_key = F.when(has(month), F.concat(y, F.lit("-"), two(month)))
    day_key = F.when(has(month) & has(day), F.concat(y, F.lit("-"), two(month), F.lit("-"), two(day)))
    return F.filter(F.array(y, month_key, day_key), lambda k: k.isNotNull())


def committee_base(name: Column) -> Column:
    return F.substring_index(name, "-", 1)


def plain_base(name: str) -> str:
    """The same for one name."""
    return name.partition("-")[0]


def alternation(values) -> str:
    """A pattern that tries longer values first, so that they win at one place."""
    return "|".join(re.escape(v) for v in sorted(set(values), key=lambda v: (-len(v), v)))


def joined_metadata(*fields: Column) -> Column:
    """Fields that are not empty, joined by spaces."""
    return F.concat_ws(" ", *(F.nullif(f, F.lit("")) for f in fields))


def quoted(quote: Column, text: Column) -> Column:
    """A non-empty quote that is in the text, white space made equal."""
    return (collapsed(quote) != "") & collapsed(text).contains(collapsed(quote))


def found(quote: Column, text: Column, probability: Column, least: float) -> Column:
    """Quoted word for word, or judged to be with a probability of `least` or more."""
    return quoted(quote, text) | F.coalesce(probability >= least, F.lit(False))


def pieces(text: Column) -> Column:
    """Text cut after . ! ? with white space, and at line ends; trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, r"(?U)(?<=[.!?])\s+|\n+"), lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", "")), lambda p: p != "")


def sentences(text: Column) -> Column:
    """Sentences: a piece of citations only belongs to the one before, a list mark to the one after."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("mark"))

    def step(state, piece):
        only_citations = F.regexp_replace(F.regexp_replace(piece, CITATION, ""), r"(?U)^\s+|\s+$", "") == ""
        is_mark = piece.rlike(r"^(?:\d+[.)]|[-*•·])$")
        size = F.size(state["out"])
        glued = F.concat(F.slice(state["out"], F.lit(1), F.greatest(size - 1, F.lit(0))), F.array(F.concat(F.element_at(state["out"], -1), F.lit(" "), piece)))
        grown = F.concat(state["out"], F.array(F.concat(state["mark"], piece)))
        return (
            F.when((size > 0) & only_citations, F.struct(glued.alias("out"), state["mark"].alias("mark")))
            .when(is_mark, F.struct(state["out"].alias("out"), F.concat(state["mark"], piece, F.lit(" ")).alias("mark")))
            .otherwise(F.struct(grown.alias("out"), F.lit("").alias("mark")))
        )

    return F.aggregate(pieces(text), start, step, lambda s: s["out"])


def has_parts(sentence: Column, parts: list[str]) -> Column:
    """All parts are in the sentence, white space aside; false without parts or with an empty one."""
    flat = [re.sub(r"\s+", "", p) for p in parts]
    if not flat or not all(flat):
        return F.lit(False)
    out = F.lit(True)
    for p in flat:
        out = out & squeezed(sentence).contains(p)
    return out


def refusal(answer: Column, phrase: str, fillers: list[str], parts: list[str]) -> Column:
    """struct(kind, refused, rest): kind is full, partial or null; rest is the answer without refusing sentences."""
    key = re.sub(r"\s+", "", phrase)
    refuses = lambda s: squeezed(s).contains(key) | has_parts(s, parts)
    filler = lambda s: F.lit(False) if not fillers else sum((s.contains(f).cast("int") for f in fillers), F.lit(0)) > 0
    all_of = sentences(answer)
    refused = F.filter(all_of, refuses)
    rest = F.filter(all_of, lambda s: ~F.array_contains(refused, s))
    content = F.filter(rest, lambda s: ~filler(s))
    none = F.size(refused) == 0
    kind = F.when(none, F.lit(None).cast("string")).when(F.size(content) > 0, "partial").otherwise("full")
    return F.struct(kind.alias("kind"), refused.alias("refused"), F.when(none, answer).otherwise(F.array_join(rest, "\n")).alias("rest"))


def unlisted_refusal(answer: Column, phrase: str, parts: list[str]) -> Column:
    """A sentence refuses in other words than the phrase."""
    key = re.sub(r"\s+", "", phrase)
    return F.exists(sentences(answer), lambda s: ~squeezed(s).contains(key) & has_parts(s, parts))


def citations(text: Column) -> Column:
    """Cited numbers in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(CITATION), F.lit(1)), lambda n: n.cast("int"))


def citation_check(answer: Column, k: Column, fillers: list[str]) -> Column:
    """struct(n_sentences, invalid, uncited, filler) of an answer with k contexts."""
    filler = lambda s: F.lit(False) if not fillers else sum((s.contains(f).cast("int") for f in fillers), F.lit(0)) > 0
    all_of = sentences(answer)
    body = F.filter(all_of, lambda s: ~filler(s))
    invalid = F.array_sort(F.array_distinct(F.filter(citations(answer), lambda n: (n < 1) | (n > k))))
    uncited = F.size(F.filter(body, lambda s: ~s.rlike(CITATION)))
    return F.struct(F.size(body).alias("n_sentences"), invalid.alias("invalid"), uncited.alias("uncited"), (F.size(all_of) - F.size(body)).alias("filler"))


def split_thought(raw: Column, opening: str = "<think>", closing: str = "</think>") -> Column:
    """struct(thought, answer): a leading reasoning block apart; an unfinished one leaves no answer."""
    starts = F.ltrim(raw).startswith(opening)
    body = F.substring_index(F.ltrim(raw), opening, -1)
    closed = raw.contains(closing)
    thought = F.when(starts & closed, F.trim(F.substring_index(body, closing, 1))).when(starts, F.trim(body)).otherwise("")
    answer = F.when(starts & ~closed, "").when(starts, F.trim(F.regexp_replace(raw, "(?s)^.*?" + re.escape(closing), ""))).otherwise(raw)
    return F.struct(thought.alias("thought"), answer.alias("answer"))


def first_line(raw: Column, most: int) -> Column:
    """The first line that is not empty, trimmed; null if there is none or it is longer than most."""
    lines = F.filter(F.transform(F.split(raw, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    line = F.try_element_at(lines, F.lit(1))
    return F.when(F.length(line) <= most, line)


def json_object(text: Column) -> Column:
    """The JSON object in a text, code fences aside, as a string; null if it is none."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```[A-Za-z]*\s*", ""), r"\s*```$", ""))
    return F.when(bare.startswith("{") & F.get_json_object(bare, "$").isNotNull(), bare)


def pause_seconds(text: Column) -> Column:
    """Seconds of '1d2h3m4.5s'; absent parts are zero."""
    part = lambda unit: F.coalesce(F.nullif(F.regexp_extract(text, rf"([0-9.]+){unit}(?![a-z])", 1), F.lit("")).cast("double"), F.lit(0.0))
    return part("d") * 86400 + part("h") * 3600 + part("m") * 60 + part("s")


def strip_lone_bullet(text: Column, bullet: str = "- ") -> Column:
    """Without the bullet where exactly one line starts with one."""
    pattern = "(?m)^" + re.escape(bullet)
    return F.when(F.regexp_count(text, F.lit(pattern)) == 1, F.regexp_replace(text, pattern, "")).otherwise(text)


def forwarded_ip(header: Column, fallback: Column) -> Column:
    """The last entry of a forwarded-for list that is not empty."""
    parts = F.filter(F.transform(F.split(header, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.coalesce(F.try_element_at(parts, F.lit(-1)), fallback)


def replace_words(text: Column, words: dict[str, str]) -> Column:
    """Words replaced one after the other."""
    if "" in words:
        raise ValueError("an empty word")
    for old, new in words.items():
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def readable(html: Column) -> Column:
    """Escaped for HTML, paragraphs at double spaces."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        html = F.replace(html, F.lit(a), F.lit(b))
    return F.regexp_replace(html, r" {2,}", "\n\n")


def shortened(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def doc_date(text: Column) -> Column:
    """An ISO date from digits before year, month and day marks (fixed characters, two scripts), spaces aside."""
    pattern = r"^(\d{4})[년年](\d{1,2})[월月](\d{1,2})[일日]"
    flat = squeezed(F.coalesce(text, F.lit("")))
    part = lambda i: F.regexp_extract(flat, pattern, i)
    return F.when(flat.rlike(pattern), F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0")))
