"""Incremental text transducers: fed in pieces, with the same output however a text is cut.

They hold back only what more text could still change. As batch functions they are a feed and a finish;
over a stream they are keyed state.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


class WordReplacer:
    """Replaces words as text arrives; holds back what may be the beginning of a word. finish() gives the rest."""

    def __init__(self, words: dict[str, str]):
        if "" in words:
            raise ValueError("an empty word")
        self.words, self.held = dict(words), ""
        self.pattern = re.compile("|".join(re.escape(w) for w in sorted(words, key=len, reverse=True))) if words else None

    def feed(self, piece: str) -> str:
        self.held += piece
        if self.pattern is None:
            out, self.held = self.held, ""
            return out
        out, at = [], 0
        while True:
            # the first place from which a word may still begin or grow
            wait = min((i for i in range(at, len(self.held)) if any(w != self.held[i:] and w.startswith(self.held[i:]) for w in self.words)), default=len(self.held))
            m = self.pattern.search(self.held, at)
            if m is None or m.start() >= wait:
                out.append(self.held[at:wait])
                self.held = self.held[wait:]
                return "".join(out)
            out += [self.held[at : m.start()], self.words[m.group()]]
            at = m.end()

    def finish(self) -> str:
        out = self.pattern.sub(lambda m: self.words[m.group()], self.held) if self.pattern else self.held
        self.held = ""
        return out


class LeadMover:
    """Moves a leading "date name at" of a sentence into brackets before the sentence's end.

    A sentence that opens with a date, a short name and the locative particle loses that lead; "(date
    name)" comes before its first citation, full stop or line end. Digits around a point are a number.
    The decision for a sentence needs the text up to the particle, so what is given out follows whole
    sentences: a sentence is held until its end mark, or the finish, has come.
    """

    #: The particle and the word dropped from names' ends (fixed values of the source language).
    AT, MEETING = "에서", " 회의"
    LEAD = re.compile(r"(?P<mark>(?:\s|\[\d+\])*)(?P<date>\d{4}년\s*\d{1,2}월\s*\d{1,2}일)(?:에)?\s+(?P<name>[^.,\n\[\]()]+?)에서(?:는)?,?\s+(?P<rest>\S[\s\S]*)")
    END = re.compile(r"\n|(?<!\d)\.|\.(?!\d)")
    INSERT = re.compile(r"[ \t]*(?:\[\d|\n)|(?<!\d)\.|\.(?!\d)")

    def __init__(self, most: int = 40):
        self.most, self.held = most, ""

    def _sentence(self, text: str) -> str:
        m = self.LEAD.fullmatch(text)
        if not m or len(m["name"]) > self.most:
            return text
        bracket = f"({m['date']} {m['name'].removesuffix(self.MEETING)})"
        rest = m["rest"]
        at = self.INSERT.search(rest)
        place = at.start() if at else len(rest)
        return f"{m['mark']}{rest[:place]}{bracket}{rest[place:]}"

    def _cut(self, final: bool) -> int | None:
        """Where the first held sentence ends; a point at the end may still be followed by a digit."""
        for m in self.END.finditer(self.held):
            if m.group() == "." and m.end() == len(self.held) and not final and self.held[m.start() - 1 : m.start()].isdigit():
                return None
            return m.end()
        return None

    def _pump(self, final: bool) -> str:
        out = []
        while (cut := self._cut(final)) is not None:
            out.append(self._sentence(self.held[:cut]))
            self.held = self.held[cut:]
        if final and self.held:
            out.append(self._sentence(self.held))
            self.held = ""
        return "".join(out)

    def feed(self, piece: str) -> str:
        self.held += piece
        return self._pump(False)

    def finish(self) -> str:
        return self._pump(True)


def whole(make, text: str) -> str:
    """A text through a new transducer at once."""
    t = make()
    return t.feed(text) + t.finish()


def transduced(df: DataFrame, make, text: str = "text") -> DataFrame:
    """df with its text column sent through a transducer of its own for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = df_columns.index(text)
        for b in batches:
            done = pa.array([None if t is None else whole(make, t) for t in b.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([done if i == at else c for i, c in enumerate(b.columns)], names=df_columns)

    df_columns = df.columns
    return df.mapInArrow(run, df.schema)
