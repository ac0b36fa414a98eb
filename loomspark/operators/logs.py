"""Log intelligence in batch: templates, rates, baselines, bursts, novelty, absence, incidents.

Event times are epoch microseconds (``us``), so that buckets are exact integers.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import mask
from ..sources.tables import ship

MINUTE = 60_000_000
HOUR = 60 * MINUTE


def rollup(events: DataFrame, fingerprint: str = "fingerprint", sample: str = "event_id") -> DataFrame:
    """First and last time, count and first event of each fingerprint."""
    return events.groupBy(fingerprint).agg(F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.count(F.lit(1)).alias("occurrences"), F.min_by(sample, F.struct("us", sample)).alias("sample_event_id"))


def templates(lines: DataFrame, text: str) -> DataFrame:
    return lines.groupBy(mask(F.col(text)).alias("template")).agg(F.count(F.lit(1)).alias("occurrences"))


def sliding_rate(events: DataFrame, keys: list[str], width: int = HOUR, slide: int = 15 * MINUTE) -> DataFrame:
    """Events in each window that holds any; windows start at multiples of ``slide``."""
    last = F.expr(f"us - pmod(us, {slide})")
    # partial counts by slide first, so a row is copied into windows only once a slide and key
    slots = events.groupBy(*keys, last.alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    spread = slots.select(*keys, F.explode(F.transform(F.sequence(F.lit(0), F.lit(width // slide - 1)), lambda i: F.col("slot") - i.cast("long") * F.lit(slide))).alias("start_us"), "n")
    return spread.groupBy(*keys, "start_us").agg(F.sum("n").alias("events"))


def daily(events: DataFrame, keys: list[str]) -> DataFrame:
    return events.groupBy(*keys, F.floor(F.col("us") / F.lit(24 * HOUR)).cast("long").alias("day")).agg(F.count(F.lit(1)).alias("events"))


def ewma(series: DataFrame, keys: list[str], order: str, value: str, alpha: float = 0.3) -> DataFrame:
    """Each point with the exponentially weighted mean of the points before it (null for the first).

    Points are dealt by key and sorted, and each partition is one pass that holds the mean of the series at hand alone: linear in
    the points and in no memory of theirs, however long a series is. Null values count as missing points; they keep the mean.
    """
    rows = series.select(*keys, order, F.col(value).cast("double").alias(value))
    schema = T.StructType([*rows.schema.fields, T.StructField("baseline", T.DoubleType())])
    n = len(keys)
    ship(series.sparkSession)

    def run(batches):
        last, mean = None, None
        for b in batches:
            out = []
            for *key, x in zip(*(b.column(i).to_pylist() for i in (*range(n), n + 1)), strict=True):
                if key != last:
                    last, mean = key, None
                out.append(mean)
                if x is not None:
                    mean = x if mean is None else mean * (1 - alpha) + x * alpha
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.float64())], names=schema.names)

    means = rows.repartition(*keys).sortWithinPartitions(*keys, order).mapInArrow(run, schema)
    return means.withColumn("baseline", F.round("baseline", 6))


#: Fixed order of severities.
SEVERITIES = ["debug", "info", "warn", "error", "fatal"]


def at_least(severity, least: str):
    """Whether a severity is ``least`` or graver; unknown ones aren't."""
    return F.lower(severity).isin(SEVERITIES[SEVERITIES.index(least) :])


def bursts(baselines: DataFrame, value: str, multiple: float = 1.5) -> DataFrame:
    return baselines.where(F.col(value) > multiple * F.col("baseline"))


def error_bursts(events: DataFrame, keys: list[str], severity: str, multiple: float = 1.5) -> DataFrame:
    """Days on which the events of severity error or graver exceed a multiple of their baseline."""
    return bursts(ewma(daily(events.where(at_least(F.col(severity), "error")), keys), keys, "day", "events"), "events", multiple)


def grave_novelties(events: DataFrame, keys: list[str], severity: str, since_us: int) -> DataFrame:
    """Keys never seen before ``since_us``, at whatever severity, that come at warn or graver from then on."""
    first = novel(events, keys, since_us)
    grave = events.where(at_least(F.col(severity), "warn")).groupBy(*keys).agg(F.min("us").alias("grave_us"))
    return first.join(grave, keys)


def novel(events: DataFrame, keys: list[str], since_us: int) -> DataFrame:
    """Keys first seen at or after ``since_us``."""
    return events.groupBy(*keys).agg(F.min("us").alias("first_us")).where(F.col("first_us") >= since_us)


#: Time that one task sees of a key at once, so that a key with a third of all events is many tasks' work.
CHUNK = 24 * HOUR


def with_previous(events: DataFrame, key: str, columns: list[str], order: tuple[str, ...] = ("us", "event_id"), chunk: int = CHUNK) -> DataFrame:
    """events with ``previous`` (a struct of columns) of the event before of the same key, null for the first, and ``_chunk``.

    Events are ordered within chunks of time; a chunk's first event takes what the chunk before ended with, which a table
    of one row a key and chunk tells.
    """
    cut = events.withColumn("_chunk", F.floor(F.col(order[0]) / F.lit(chunk)).cast("long"))
    inner = Window.partitionBy(key, "_chunk").orderBy(*order)
    ends = cut.groupBy(key, "_chunk").agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_last"))
    before = ends.select(F.col(key).alias("_k"), F.col("_chunk").alias("_c"), F.lag("_last").over(Window.partitionBy(key).orderBy("_chunk")).alias("_before"))
    rows = cut.withColumn("_own", F.lag(F.struct(*columns)).over(inner))
    joined = rows.join(before, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_chunk") == F.col("_c")), "left")
    return joined.withColumn("previous", F.coalesce("_own", "_before")).drop("_own", "_before", "_k", "_c")


def absences(events: DataFrame, key: str, gap_us: int) -> DataFrame:
    """Gaps of more than ``gap_us`` between consecutive events of a key."""
    rows = with_previous(events, key, ["us"])
    return rows.where(F.col("us") - F.col("previous.us") > gap_us).select(key, F.col("previous.us").alias("from_us"), F.col("us").alias("to_us"))


def incidents(events: DataFrame, key: str, gap_us: int) -> DataFrame:
    """Runs of events of a key without a gap of more than ``gap_us``: number, start, end and size."""
    rows = with_previous(events, key, ["us"]).withColumn("_new", F.when(F.col("previous").isNull() | (F.col("us") - F.col("previous.us") > gap_us), 1).otherwise(0))
    inner = Window.partitionBy(key, "_chunk").orderBy("us", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    numbered = rows.withColumn("_n", F.sum("_new").over(inner))
    parts = numbered.groupBy(key, "_chunk", "_n").agg(F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.count(F.lit(1)).alias("events"), F.max("_new").alias("_new"))
    # a run that goes over the end of a chunk is put together: its parts are few
    counts = parts.groupBy(key, "_chunk").agg(F.max("_n").alias("_m"))
    earlier = counts.select(F.col(key).alias("_k"), F.col("_chunk").alias("_c"), F.coalesce(F.sum("_m").over(Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_e"))
    joined = parts.join(earlier, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_chunk") == F.col("_c")))
    return joined.withColumn("incident", F.col("_n") + F.col("_e")).groupBy(key, "incident").agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.sum("events").alias("events"))


def transitions(events: DataFrame, key: str, state: str) -> DataFrame:
    """Consecutive states of a key, counted."""
    rows = with_previous(events, key, [state]).where("previous is not null")
    return rows.groupBy(F.col(f"previous.{state}").alias("before"), F.col(state).alias("after")).agg(F.count(F.lit(1)).alias("n"))


#: The states of incidents and of jobs, and what may follow each.
INCIDENT_STEPS = {"open": ["investigating", "mitigated", "resolved"], "investigating": ["mitigated", "resolved"], "mitigated": ["investigating", "resolved"], "resolved": []}
JOB_STEPS = {"queued": ["running", "failed"], "running": ["succeeded", "failed"], "succeeded": [], "failed": []}


def allowed_step(before, after, steps: dict[str, list[str]]):
    """Whether ``after`` may follow ``before``; a first state must be the first one listed."""
    first = next(iter(steps))
    out = F.when(before.isNull(), after == F.lit(first))
    for state, following in steps.items():
        out = out.when(before == F.lit(state), after.isin(following) if following else F.lit(False))
    return F.coalesce(out.otherwise(F.lit(False)), F.lit(False))


def checked_transitions(events: DataFrame, key: str, state: str, steps: dict[str, list[str]], order: tuple[str, ...] = ("us", "event_id")) -> DataFrame:
    """events with the state before and whether the step to this one is allowed."""
    rows = with_previous(events, key, [state], order).withColumn("before", F.col(f"previous.{state}")).drop("previous", "_chunk")
    return rows.withColumn("allowed", allowed_step(F.col("before"), F.col(state), steps))


def in_range(events: DataFrame, from_us: int, to_us: int, **equal) -> DataFrame:
    """Events of from <= time < to whose columns have the given values; on archived logs the day prunes partitions."""
    out = events.where((F.col("us") >= from_us) & (F.col("us") < to_us))
    for c, v in equal.items():
        out = out.where(F.col(c) == v)
    return out


def as_of(events: DataFrame, markers: DataFrame, key: str, chunk: int = CHUNK) -> DataFrame:
    """events with the last marker of the same key at or before them (null if none). markers: key, us, marker_id.

    Both are ordered within chunks of time; where a chunk has no marker yet, the last one of the chunks before counts.
    """
    e = events.select(key, "us", "event_id", F.lit(None).cast("long").alias("marker_id"), F.lit(1).alias("_o"))
    m = markers.select(key, "us", F.lit(None).cast("long").alias("event_id"), "marker_id", F.lit(0).alias("_o"))
    cut = e.unionByName(m).withColumn("_chunk", F.floor(F.col("us") / F.lit(chunk)).cast("long"))
    inner = Window.partitionBy(key, "_chunk").orderBy("us", "_o", "marker_id").rowsBetween(Window.unboundedPreceding, 0)
    ends = cut.groupBy(key, "_chunk").agg(F.max_by("marker_id", F.when(F.col("marker_id").isNotNull(), F.struct("us", "marker_id"))).alias("_last"))
    outer = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = ends.select(F.col(key).alias("_k"), F.col("_chunk").alias("_c"), F.last("_last", ignorenulls=True).over(outer).alias("_before"))
    rows = cut.withColumn("marker_id", F.last("marker_id", ignorenulls=True).over(inner))
    joined = rows.where("_o = 1").join(before, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_chunk") == F.col("_c")), "left")
    return joined.select("event_id", key, "us", F.coalesce("marker_id", "_before").alias("marker_id"))


def split_retention(events: DataFrame, now_us: int, days: int = 30) -> DataFrame:
    return events.withColumn("tier", F.when(F.col("us") >= now_us - days * 24 * HOUR, "hot").otherwise("archive"))


def token_templates(lines: DataFrame, text: str) -> DataFrame:
    """Templates by number of tokens and first token: a place where the lines of a group differ is ``{*}``.

    Digits are masked first. Each group is reduced to the least and greatest token of each place, by partial aggregation,
    so a group of any size is a few rows.
    """
    tokens = F.split(mask(F.col(text)), "[ /]")
    parts = lines.where(F.col(text).isNotNull()).select(F.size(tokens).alias("n"), F.element_at(tokens, 1).alias("first"), F.posexplode(tokens).alias("pos", "token"))
    places = parts.groupBy("n", "first", "pos").agg(F.min("token").alias("a"), F.max("token").alias("b"), F.count(F.lit(1)).alias("c"))
    token = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise("{*}")
    whole = places.groupBy("n", "first").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", token.alias("t")))), lambda x: x["t"]), " ").alias("template"), F.max("c").alias("occurrences"))
    return whole.select("template", "n", "occurrences")


WILD = "{*}"


def _clustered(rows: list[tuple[list[str], int]], least: float) -> list[tuple[list[str], int]]:
    """Templates of (tokens, count) of one length and first token: each joins the template that it has most tokens in common
    with, if these are ``least`` of all, and makes wildcards of the others."""
    out: list[list] = []
    for tokens, n in sorted(rows, key=lambda r: (-r[1], r[0])):
        best, at = 0.0, None
        for k, (template, _) in enumerate(out):
            share = sum(a == b or a == WILD for a, b in zip(template, tokens, strict=True)) / len(tokens)
            if share > best:
                best, at = share, k
        if at is not None and best >= least:
            template, m = out[at]
            out[at] = [[a if a == b else WILD for a, b in zip(template, tokens, strict=True)], m + n]
        else:
            out.append([list(tokens), n])
    return [(t, n) for t, n in out]


def mined_templates(lines: DataFrame, text: str, least: float = 0.5, parts: int = 16) -> DataFrame:
    """template, occurrences: lines clustered by number of tokens, first token and likeness of the rest.

    Digits are masked and equal lines counted first, so a group is its different shapes. Shapes are clustered in ``parts``
    by hash, then the parts' templates together; a group of very many shapes is no one task's.
    """
    masked = lines.where(F.col(text).isNotNull()).select(F.split(F.trim(mask(F.col(text))), "\\s+").alias("tokens"))
    shapes = masked.groupBy("tokens").agg(F.count(F.lit(1)).alias("n"))
    keyed = lambda rows: rows.withColumn("size", F.size("tokens")).withColumn("first", F.element_at("tokens", 1))

    def cluster(frame):
        found = _clustered([(list(t), int(n)) for t, n in zip(frame["tokens"], frame["n"], strict=True)], least)
        return frame.__class__({"tokens": [t for t, _ in found], "n": [n for _, n in found]})

    ship(lines.sparkSession)
    schema = "tokens array<string>, n long"
    some = keyed(shapes).withColumn("part", F.pmod(F.xxhash64("tokens"), F.lit(parts))).groupBy("size", "first", "part").applyInPandas(cluster, schema)
    whole = keyed(some).groupBy("size", "first").applyInPandas(cluster, schema)
    return whole.groupBy(F.array_join("tokens", " ").alias("template")).agg(F.sum("n").alias("occurrences"))
