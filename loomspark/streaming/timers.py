"""Stateful streams with event-time timers: heartbeats that stop, and state machines of jobs and incidents.

Events of a key may come in any order within the watermark. They wait in the key's state until the watermark has passed them and
are then folded in order of time and id, so the output doesn't depend on how they arrived, and is what the batch operators
``logs.absences`` and ``logs.checked_transitions`` give of the same events. A key has one timer for what waits and one for what is
to happen if nothing comes. Later events than the watermark allows are dropped, as Spark does. With ``ttl_us`` a key of
which nothing was heard for so long is forgotten; its next event is then its first.

State lies in RocksDB (``stateful`` sets that), so a key's waiting events needn't fit in memory. Sessions run in UTC.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..sources.tables import ship

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stateful(spark: SparkSession) -> SparkSession:
    """The session with the state store that timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return ship(spark)


class InOrder(StatefulProcessor):
    """Folds a key's events (us, id, state) in order once the watermark has passed them."""

    columns: list[str] = []

    def __init__(self, ttl_us: int | None = None):
        self.ttl_us = ttl_us

    def init(self, handle):
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "us long, id string, nth int", "state string")
        self.kept = handle.getValueState("kept", "us long, state string, told boolean")

    def close(self):
        pass

    def fold(self, key, last, us, id_, state):
        """What one event after ``last`` (us, state, told; or None) tells: rows of ``columns``."""
        raise NotImplementedError

    def silence(self, key, last, until_us):
        """(rows, the time to look again or None) when all up to ``until_us`` is known and ``last`` was the last."""
        return [], None

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802  Spark's name
        first, seen = None, {}
        for f in rows:
            for us, id_, state in zip(f["us"].tolist(), f["id"].tolist(), f["state"].tolist(), strict=True):
                at = (int(us), str(id_))
                nth = seen.get(at, 0)
                while self.waiting.containsKey((*at, nth)):  # events that repeat are as many
                    nth += 1
                seen[at] = nth + 1
                self.waiting.updateValue((*at, nth), (state,))
                first = at[0] if first is None else min(first, at[0])
        if first is not None:
            self.handle.registerTimer(first // 1000 + 1)
        yield self._frame([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802
        # a timer fires when the watermark has come to its millisecond: what is earlier is complete
        until = timerValues.getCurrentWatermarkInMs() * 1000
        last = tuple(self.kept.get()) if self.kept.exists() else None
        due, ahead, out = [], None, []
        for at, value in self.waiting.iterator():
            if at[0] < until:
                due.append((tuple(at), value[0]))
            else:
                ahead = at[0] if ahead is None else min(ahead, at[0])
        for at, state in sorted(due, key=lambda x: (x[0][0], len(x[0][1]), x[0][1], x[0][2])):
            if last is not None and self.ttl_us is not None and at[0] - last[0] > self.ttl_us:
                last = None
            out += self.fold(key, last, at[0], at[1], state)
            last = (at[0], state, False)
            self.waiting.removeKey(at)
        again = None
        if last is not None:
            told, again = self.silence(key, last, until)
            if told:
                out, last = out + told, (*last[:2], True)
            if self.ttl_us is not None:
                over = last[0] + self.ttl_us
                if over < until:
                    last = None
                else:
                    again = over if again is None else min(again, over)
        if last is None:
            self.kept.clear()
        else:
            self.kept.update(last)
        for t in (ahead, again):
            if t is not None:
                self.handle.registerTimer(t // 1000 + 1)
        yield self._frame(out)

    def _frame(self, rows):
        return pd.DataFrame(rows, columns=self.columns)


class Gaps(InOrder):
    """Gaps of more than ``gap_us``: with their end once the key is heard again, and without one as soon as they are that long."""

    columns = ["key", "from_us", "to_us"]

    def __init__(self, gap_us: int, ttl_us: int | None = None):
        super().__init__(ttl_us)
        self.gap_us = gap_us

    def fold(self, key, last, us, id_, state):
        return [(key[0], last[0], us)] if last is not None and us - last[0] > self.gap_us else []

    def silence(self, key, last, until_us):
        if last[2]:
            return [], None
        due = last[0] + self.gap_us + 1
        return ([(key[0], last[0], None)], None) if due < until_us else ([], due)

    def _frame(self, rows):
        f = super()._frame(rows)
        return f.astype({"from_us": "int64", "to_us": "Int64"})


class Machine(InOrder):
    """Each event with the state before it and whether the step is allowed (``steps``: state, the states that may follow)."""

    columns = ["key", "us", "id", "state", "before", "allowed"]

    def __init__(self, steps: dict[str, list[str]], start: list[str], ttl_us: int | None = None):
        super().__init__(ttl_us)
        self.steps, self.start = steps, start

    def fold(self, key, last, us, id_, state):
        before = last[1] if last is not None else None
        follow = self.start if before is None else self.steps.get(before, [])
        return [(key[0], us, id_, state, before, state in follow)]


def _keyed(events: DataFrame, key: str, state: str | None, late: str) -> DataFrame:
    """events (key, us, event_id, ...) as the processors take them."""
    rows = events.where(F.col(key).isNotNull() & F.col("us").isNotNull())
    told = F.lit(None).cast("string") if state is None else F.col(state).cast("string")
    return rows.select(F.col(key).alias("key"), F.timestamp_micros("us").alias("ts"), "us", F.col("event_id").cast("string").alias("id"), told.alias("state")).withWatermark("ts", late)


def absences(events: DataFrame, key: str, gap_us: int, late: str = "1 day", ttl_us: int | None = None) -> DataFrame:
    """key, from_us, to_us of the stream's gaps; to_us is null while the key is still silent."""
    stateful(events.sparkSession)
    kind = dict(events.dtypes)[key]
    rows = _keyed(events, key, None, late).groupBy("key")
    return rows.transformWithStateInPandas(Gaps(gap_us, ttl_us), f"key {kind}, from_us long, to_us long", "Append", "EventTime")


def machine(events: DataFrame, key: str, state: str, steps: dict[str, list[str]], start: list[str], late: str = "1 day", ttl_us: int | None = None) -> DataFrame:
    """key, us, id, state, before, allowed of the stream's events, in each key's order."""
    stateful(events.sparkSession)
    kind = dict(events.dtypes)[key]
    rows = _keyed(events, key, state, late).groupBy("key")
    return rows.transformWithStateInPandas(Machine(steps, start, ttl_us), f"key {kind}, us long, id string, state string, before string, allowed boolean", "Append", "EventTime")
