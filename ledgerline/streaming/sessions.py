"""Text transducers over streams: pieces of many texts, each text a session with its held characters as state.

What a transducer holds back (the beginning of a word, a sentence without its end) is the whole of a
session's state, so it stays as small as the transducer keeps it, whatever the text's length. A piece that
is marked as the last one ends its session; a session that gets no piece for a while is ended by a timer,
which gives out what was held. The joined output of a session is that of its whole text at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Seconds without a piece after which a session ends.
IDLE = 60.0
OUT = "session string, seq bigint, text string, ended boolean"
#: The state store that timers need.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Transducing(StatefulProcessor):
    def __init__(self, make: Callable, idle: float):
        self.make, self.idle = make, int(1000 * idle)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "held string")

    def _wait(self, until: int | None) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if until is not None:
            self.handle.registerTimer(until)

    def _rows(self, key, out: list[tuple]) -> pd.DataFrame:
        seq, text, ended = zip(*out) if out else ((), (), ())
        return pd.DataFrame({"session": [key[0]] * len(out), "seq": pd.array(seq, "Int64"), "text": list(text), "ended": list(ended)})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        t = self.make()
        if self.held.exists():
            t.held = self.held.get()[0]
        out, ended = [], False
        for seq, text, last in pd.concat(list(rows)).sort_values("seq")[["seq", "text", "last"]].itertuples(index=False):
            given, ended = t.feed(text or ""), bool(last)
            out.append((seq, given + t.finish() if ended else given, ended))
        if ended:
            self.held.clear()
            self._wait(None)
        else:
            self.held.update((t.held,))
            self._wait(timerValues.getCurrentProcessingTimeInMs() + self.idle)
        yield self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        t = self.make()
        if self.held.exists():
            t.held = self.held.get()[0]
        self.held.clear()
        yield self._rows(key, [(None, t.finish(), True)])

    def close(self) -> None:
        pass


def with_timers(spark: SparkSession) -> None:
    """Sets the state store that `transduced_stream` needs; queries that are running keep theirs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def transduced_stream(pieces: DataFrame, make: Callable, idle: float = IDLE) -> DataFrame:
    """A stream (session, seq, text, last) -> (session, seq, text, ended): what each piece lets through.

    Pieces of a session come in the order of seq, within a micro-batch in any; a null text is an empty one. A row
    without seq is what a timer gave out; a piece after that begins the session anew.
    """
    return pieces.select("session", "seq", "text", "last").groupBy("session").transformWithStateInPandas(Transducing(make, idle), OUT, "Append", "ProcessingTime")
