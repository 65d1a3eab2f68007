"""Usage limits and other keyed state over event time, in batch and in Structured Streaming.

A request passes if its key has had fewer than PER_HOUR accepted ones in the trailing hour (half-open:
one exactly an hour old is out) and fewer than PER_DAY on its day. Refused requests are not counted, so
decisions depend on earlier ones and run in the order of events of a key, on that key's state only: one
key's events are one task. A limit over all keys a day is a cut in time, found round by round.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.scratch import scratch
from ..sources.tables import table

PER_HOUR, PER_DAY, HOUR = 50, 100, 3_600_000_000


class Limiter:
    """The state of one key: accepted times of the trailing hour, the day and its count (microseconds)."""

    def __init__(self, per_hour: int = PER_HOUR, per_day: int = PER_DAY, state=None):
        self.per_hour, self.per_day = per_hour, per_day
        times, self.day, self.today = state or ([], -1, 0)
        self.times = deque(times)

    def check(self, now: int) -> bool:
        while self.times and self.times[0] <= now - HOUR:
            self.times.popleft()
        day = now // (24 * HOUR)
        if day != self.day:
            self.day, self.today = day, 0
        if self.today >= self.per_day or len(self.times) >= self.per_hour:
            return False
        self.times.append(now)
        self.today += 1
        return True

    def state(self) -> tuple:
        return list(self.times), self.day, self.today


class UsageLimit:
    """Online: a limit over all keys a day comes first, then the key's own; refused requests count nowhere."""

    def __init__(self, per_hour: int = PER_HOUR, per_day: int = PER_DAY, all_day: int = 500):
        self.per_hour, self.per_day, self.all_day = per_hour, per_day, all_day
        self.keys: dict[str, Limiter] = {}
        self.day, self.today = -1, 0

    def check(self, key: str, now: int) -> bool:
        day = now // (24 * HOUR)
        if day != self.day:
            self.day, self.today = day, 0
            self.keys = {k: x for k, x in self.keys.items() if x.times and x.times[-1] > now - HOUR}
        if self.today >= self.all_day or not self.keys.setdefault(key, Limiter(self.per_hour, self.per_day)).check(now):
            return False
        self.today += 1
        return True


class Breaker:
    """A circuit breaker: after a failure, calls are skipped until `pause` has gone by."""

    def __init__(self, pause: float = 3600.0):
        self.pause, self.until = pause, float("-inf")

    def call(self, now: float, work):
        if now < self.until:
            return None
        try:
            return work()
        except Exception:  # noqa: BLE001 any failure of the outside service opens the breaker
            self.until = now + self.pause
            return None


class MonthlySwitch:
    """Off after a matching message, on again when the month changes."""

    def __init__(self, pattern: str):
        self.pattern, self.off = pattern, None

    def message(self, text: str, month: str) -> None:
        if self.pattern in text:
            self.off = month

    def on(self, month: str) -> bool:
        if self.off is not None and self.off != month:
            self.off = None
        return self.off is None


OUT = "user_id bigint, event_id bigint, us bigint, accepted boolean"
STATE = "times array<bigint>, day bigint, today bigint"
#: Refusals: over the limit of a day over all keys, or over the key's own.
ALL, OWN = "day", "key"


def _decided(events: DataFrame, per_hour: int, per_day: int, cuts: dict[int, tuple[int, int]], states: DataFrame | None = None, rest: tuple[int, int] | None = None) -> DataFrame:
    """Events with accepted and reason, and for each key a row of its last state (event_id null).

    cuts: day -> (us, event_id) of the last event that the limit over all keys lets through; rest: of days without one. A key's events
    stream through one task in order, its former state before them; what is held is the state, not the rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        user, limiter, out = None, None, []

        def last() -> tuple:
            times, day, today = limiter.state()
            return user, None, None, None, None, times, day, today

        for b in batches:
            for u, e, t, *state in zip(*(b.column(c).to_pylist() for c in ("user_id", "event_id", "us", "times", "day", "today"))):
                if u != user or limiter is None:
                    if limiter is not None:
                        out.append(last())
                    user, limiter = u, Limiter(per_hour, per_day)
                if t is None:
                    limiter = Limiter(per_hour, per_day, state)
                    continue
                cut = cuts.get(t // (24 * HOUR), rest)
                reason = ALL if cut is not None and (t, e) > cut else None if limiter.check(t) else OWN
                out.append((u, e, t, reason is None, reason, None, None, None))
            yield batch(out)
            out = []
        if limiter is not None:
            yield batch([last()])

    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.list_(pa.int64()), pa.int64(), pa.int64())
    names = ("user_id", "event_id", "us", "accepted", "reason", "times", "day", "today")
    batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 8, kinds)], names=names)
    every = events.select("user_id", "event_id", "us", F.lit(None).cast("array<bigint>").alias("times"), F.lit(None).cast("bigint").alias("day"), F.lit(None).cast("bigint").alias("today"))
    if states is not None:
        none = F.lit(None).cast("bigint")
        every = every.unionByName(states.select("user_id", none.alias("event_id"), none.alias("us"), "times", "day", "today"))
    dealt = every.repartition("user_id").sortWithinPartitions("user_id", F.asc_nulls_first("us"), "event_id")
    return dealt.mapInArrow(run, f"{OUT}, reason string, {STATE}")


def limited(events: DataFrame, per_hour: int = PER_HOUR, per_day: int = PER_DAY) -> DataFrame:
    """events (user_id, event_id, us) -> the same with accepted; batch, each key by itself."""
    return _decided(events, per_hour, per_day, {}).where("us is not null").select("user_id", "event_id", "us", "accepted")


def _cuts(decided: DataFrame, all_day: int, before: dict[int, int]) -> dict[int, tuple[int, int]]:
    """day -> the event with which a day's accepted ones reach the limit, for days that reach it; before: what days had already.

    Counts by second give the second in which the limit is reached, and only its events are put in order.
    """
    ok = decided.where("accepted").select("us", "event_id", F.floor(F.col("us") / (24 * HOUR)).alias("d"), F.floor(F.col("us") / 1_000_000).alias("second"))
    least = F.lit(all_day)
    for day, n in before.items():
        least = F.when(F.col("d") == day, F.lit(all_day - n)).otherwise(least)
    by = ok.groupBy("d", "second").count().withColumn("upto", F.sum("count").over(Window.partitionBy("d").orderBy("second"))).withColumn("least", least)
    reached = by.where((F.col("upto") >= F.col("least")) & (F.col("upto") - F.col("count") < F.col("least"))).select("d", "second", (F.col("least") - F.col("upto") + F.col("count")).alias("nth"))
    placed = ok.join(reached, ["d", "second"]).withColumn("at", F.row_number().over(Window.partitionBy("d").orderBy("us", "event_id")))
    found = {r.d: (r.us, r.event_id) for r in placed.where("at = nth").select("d", "us", "event_id").collect()}  # one row a day
    return found | {day: (-1, -1) for day, n in before.items() if n >= all_day}


def limited_all(events: DataFrame, per_hour: int = PER_HOUR, per_day: int = PER_DAY, all_day: int = 500, states: DataFrame | None = None, before: dict[int, int] | None = None) -> DataFrame:
    """events (user_id, event_id, us) -> with accepted and reason, by a limit over all keys a day and each key's own; written.

    On a day, events pass until the accepted ones reach the limit, and none after that, so the limit is a
    cut in time. What is cut counts for no key, which may change what keys may do in the hour after midnight;
    so keys are decided by the cuts that are known, the cuts follow from the decisions, and both are
    repeated until the cuts stay. The cut of a day is right once those of all days before it are, and most
    days do not depend on the one before, so there are few rounds.

    states, before: the keys' states and the days' accepted numbers after earlier events. Rows with a null
    event_id are the states after these ones.
    """
    cuts = {day: (-1, -1) for day, n in (before or {}).items() if n >= all_day}
    while True:
        out = scratch(_decided(events, per_hour, per_day, cuts, states, None if all_day > 0 else (-1, -1)), "limits")
        found = _cuts(out, all_day, before or {})
        if found == cuts:
            return out
        cuts = found


def limit_batches(folder: str, write: Callable[[DataFrame, int], None], per_hour: int = PER_HOUR, per_day: int = PER_DAY, all_day: int = 500) -> Callable[[DataFrame, int], None]:
    """The same over a stream, for foreachBatch: micro-batches in order of time, each begun with the state that the one before left.

    States and counts of days are tables under folder, by the number of the batch, so a batch that is run
    again starts from the same state. write gets the decided events of each batch.
    """

    def step(events: DataFrame, number: int) -> None:
        spark = events.sparkSession
        states, before = None, {}
        if number:
            states = spark.read.parquet(f"{folder}/states-{number - 1}")
            before = {r.d: r.n for r in spark.read.parquet(f"{folder}/days-{number - 1}").collect()}  # days that are not over
        out = limited_all(events, per_hour, per_day, all_day, states, before)
        out.where("us is null").select("user_id", "times", "day", "today").write.mode("overwrite").parquet(f"{folder}/states-{number}")
        counts = out.where("accepted").groupBy(F.floor(F.col("us") / (24 * HOUR)).alias("d")).agg(F.count("*").alias("n"))
        known = spark.createDataFrame(list(before.items()), "d bigint, n bigint")
        days = counts.unionByName(known).groupBy("d").agg(F.sum("n").alias("n"))
        latest = days.agg(F.max("d")).first()[0]
        days.where(F.col("d") == latest).coalesce(1).write.mode("overwrite").parquet(f"{folder}/days-{number}")
        write(out.where("us is not null").select("user_id", "event_id", "us", "accepted", "reason"), number)

    return step


def limited_stream(events: DataFrame, per_hour: int = PER_HOUR, per_day: int = PER_DAY) -> DataFrame:
    """The same over a stream (user_id, event_id, us): state by key, one micro-batch's events in order."""

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        limiter = Limiter(per_hour, per_day, state.get if state.exists else None)
        rows = pd.concat(list(frames)).sort_values(["us", "event_id"])
        rows["accepted"] = [limiter.check(int(t)) for t in rows["us"]]
        state.update(limiter.state())
        yield rows[["user_id", "event_id", "us", "accepted"]]

    return events.groupBy("user_id").applyInPandasWithState(step, OUT, "times array<bigint>, day bigint, today bigint", "append", GroupStateTimeout.NoTimeout)


def event_times(events: DataFrame) -> DataFrame:
    return events.where("ts is not null and user_id is not null").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))


def usage_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user in the trailing hour and on the same day, all counted."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    hour = F.expr("count(*) over (partition by user_id order by ts range between interval '59:59.999999' minute to second preceding and current row)")
    day = F.count("*").over(Window.partitionBy("user_id", F.to_date("ts")))
    return e.select("event_id", "user_id", hour.alias("in_hour"), day.alias("in_day"))


def usage_limit_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = limited(event_times(table(spark, sf_dir, "events")), 3, 8)
    return out.select("user_id", "event_id", "accepted")


def usage_limit_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The limits of usage_limit_exact under one of 150 accepted events a day."""
    out = limited_all(event_times(table(spark, sf_dir, "events")), 3, 8, 150)
    return out.where("us is not null").select("user_id", "event_id", "accepted", "reason")


def windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by type in tumbling hours, as the streaming variant counts them."""
    return hourly(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))).select("hour", "event_type", "n", "total")


def hourly(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Batch or stream: counts in tumbling hours, events later than the watermark left out of a stream."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    grouped = events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return grouped.select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("hour"), "event_type", "n", "total")


QUERIES = {"usage_window": usage_window, "usage_limit_exact": usage_limit_exact, "usage_limit_all": usage_limit_all, "windowed_counts": windowed_counts}
ORACLES = {
    "usage_window": """select event_id, user_id, count(*) over (partition by user_id order by ts range between interval '3599.999999 seconds' preceding and current row) as in_hour,
count(*) over (partition by user_id, cast(ts as date)) as in_day from events""",
    "windowed_counts": "select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') as hour, event_type, count(*) as n, round(sum(value), 4) as total from events group by all",
}
