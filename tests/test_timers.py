"""Timers on event time: the stream's output is the batch operators', in whatever order events come; late events and forgotten keys."""

import random

import pytest
from pyspark.sql import functions as F

from loomspark.operators import logs
from loomspark.plans import proxies
from loomspark.streaming import logs as streams
from loomspark.streaming import timers

HOUR = 3_600_000_000
EVENT = "service string, us long, event_id long, status string"
STEPS = {"open": ["acked", "closed"], "acked": ["closed"], "closed": ["open"]}


@pytest.fixture
def run(spark, tmp_path):
    """Puts batches of rows into a folder one by one, runs the stream over them, gives what it wrote."""

    def over(batches, made):
        # a batch far ahead lets the watermark pass all, an empty one after it lets the timers fire
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            stream = spark.readStream.schema(EVENT).parquet(f"{tmp_path}/in")
            streams.run_available(made(stream), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
        return [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()]

    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "true")
    return over


def some_events(rng):
    at, rows = dict.fromkeys("abc", 1000 * HOUR), []
    for i in range(60):
        s = rng.choice("abc")
        at[s] += rng.choice([0, 1, 2, 9]) * HOUR
        rows.append((s, at[s], i, rng.choice(list(STEPS))))
    return rows


FAR = [("end", 10_000 * HOUR, 900, "open")]


def test_absences_and_steps_equal_the_batch(spark, run):
    rng = random.Random(1)
    rows = some_events(rng)
    batch = spark.createDataFrame(rows, EVENT)
    want = {tuple(r) for r in logs.absences(batch, "service", 5 * HOUR).collect()}
    rng.shuffle(rows)
    got = run([rows, FAR], lambda s: timers.absences(s, "service", 5 * HOUR, "2000 hours"))
    assert {r for r in got if r[2] is not None} == want and len(want) > 3
    last = {s: max(r[1] for r in rows if r[0] == s) for s in "abc"}
    assert {r[:2] for r in got if r[2] is None} >= set(last.items())  # all three have been silent since


def test_steps_in_whatever_order_they_come(spark, run):
    rng = random.Random(2)
    rows = some_events(rng)
    batch = logs.checked_transitions(spark.createDataFrame(rows, EVENT), "service", "status", STEPS).where("before is not null")
    want = sorted((r.service, r.us, str(r.event_id), r.status, r.before, r.allowed) for r in batch.collect())
    rng.shuffle(rows)
    got = run([rows[:30], rows[30:], FAR], lambda s: timers.machine(s, "service", "status", STEPS, ["open"], "2000 hours"))
    assert sorted(r for r in got if r[4] is not None) == want
    assert {r[5] == (r[3] == "open") for r in got if r[4] is None} == {True}


def test_late_events_are_dropped_and_silent_keys_forgotten(spark, run):
    batches = [[("a", 1 * HOUR, 1, "open"), ("b", 1 * HOUR, 2, "open")], [("b", 100 * HOUR, 3, "acked")], [("a", 2 * HOUR, 4, "closed"), ("a", 101 * HOUR, 5, "acked")], FAR]
    got = run(batches, lambda s: timers.machine(s, "service", "status", STEPS, ["open"], "1 hour", ttl_us=50 * HOUR))
    told = {r[2]: r[4] for r in got}
    assert "4" not in told  # came 98 hours after the watermark's time
    assert told["3"] is None and told["5"] is None  # both keys had been forgotten


def test_stream_of_the_events_table(spark, data, run, tmp_path):
    """The registered tables' events: gaps as ``absences`` finds them in batch."""
    events = proxies.events(spark, data).select(F.col("service").cast("string").alias("service"), "us", "event_id", F.col("fingerprint").alias("status")).where("service < '2'")
    rows = [tuple(r) for r in events.collect()]
    gap = 24 * HOUR
    want = {tuple(r) for r in logs.absences(spark.createDataFrame(rows, EVENT), "service", gap).collect()}
    got = run([rows, [("end", max(r[1] for r in rows) + 10_000 * HOUR, -1, "x")]], lambda s: timers.absences(s, "service", gap, "1000 hours"))
    assert {r for r in got if r[2] is not None} == want
