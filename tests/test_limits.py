"""The limit of a day over all keys against one event after another."""

import random

import pytest

from ledgerline.streaming import limits

DAY = 24 * limits.HOUR


def draw(seed, n=600, days=3, users=9):
    rng = random.Random(seed)
    # many around midnight, where one day's refusals decide on the next one; ties in time
    at = lambda: rng.choice((rng.randrange(days * DAY), rng.randrange(1, days) * DAY + rng.randrange(-limits.HOUR, limits.HOUR)))
    return [(rng.randrange(users) if rng.random() < 0.7 else 0, i, at() // 60_000_000 * 60_000_000) for i in range(n)]


def in_turn(events, per_hour, per_day, all_day):
    limit, out = limits.UsageLimit(per_hour, per_day, all_day), {}
    for user, event, us in sorted(events, key=lambda e: (e[2], e[1])):
        full = limit.day == us // DAY and limit.today >= all_day
        ok = limit.check(user, us)
        out[event] = (ok, None if ok else limits.ALL if full or all_day <= 0 else limits.OWN)
    return out


def frame(spark, events):
    return spark.createDataFrame(events, "user_id bigint, event_id bigint, us bigint").repartition(3)


@pytest.mark.parametrize(("seed", "per_hour", "per_day", "all_day"), [(1, 3, 8, 20), (2, 2, 30, 45), (3, 5, 9, 1), (4, 3, 8, 10_000), (5, 3, 8, 0)])
def test_limit_over_all_keys(spark, seed, per_hour, per_day, all_day):
    events = draw(seed)
    out = limits.limited_all(frame(spark, events), per_hour, per_day, all_day).where("us is not null").collect()
    assert {r.event_id: (r.accepted, r.reason) for r in out} == in_turn(events, per_hour, per_day, all_day)
    if 1 < all_day < 100:
        assert {r.reason for r in out} == {None, limits.ALL, limits.OWN}


def test_no_events(spark):
    assert limits.limited_all(frame(spark, draw(1)).where("false")).count() == 0


def test_micro_batches(spark, tmp_path):
    """Batches in order of time, cut anywhere, give what all events give at once; a batch that is run again gives the same."""
    events = sorted(draw(7, 400), key=lambda e: (e[2], e[1]))
    got = {}
    step = limits.limit_batches(str(tmp_path), lambda df, _: got.update({r.event_id: (r.accepted, r.reason) for r in df.collect()}), 3, 8, 20)
    for number, (a, b) in enumerate(((0, 150), (150, 151), (151, 330), (330, 400))):
        step(frame(spark, events[a:b]), number)
        if number == 2:
            step(frame(spark, events[a:b]), number)
    assert got == in_turn(events, 3, 8, 20)


def test_stream(spark, tmp_path):
    events = sorted(draw(8, 200), key=lambda e: (e[2], e[1]))
    got = {}
    step = limits.limit_batches(str(tmp_path / "state"), lambda df, _: got.update({r.event_id: (r.accepted, r.reason) for r in df.collect()}), 3, 8, 20)
    for k, (a, b) in enumerate(((0, 90), (90, 200))):
        frame(spark, events[a:b]).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
        stream = spark.readStream.schema("user_id bigint, event_id bigint, us bigint").option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        stream.writeStream.foreachBatch(step).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination(90)
    assert got == in_turn(events, 3, 8, 20)
