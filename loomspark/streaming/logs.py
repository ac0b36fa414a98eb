"""Streaming twins of the log operators; with availableNow they give what the batch operators give."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import mask
from ..sources.stores import KeyedTable


def with_time(events: DataFrame, column: str = "ts", late: str = "1 day") -> DataFrame:
    """Event time as TIMESTAMP (sessions run in UTC) with a watermark."""
    return events.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, late)


def sliding_rate(events: DataFrame, keys: list[str], width: str = "1 hour", slide: str = "15 minutes") -> DataFrame:
    w = F.window("ts", width, slide)
    return events.groupBy(*keys, w.alias("w")).agg(F.count(F.lit(1)).alias("events")).select(*keys, F.unix_micros("w.start").alias("start_us"), "events")


def template_counts(events: DataFrame, text: str, width: str = "1 day") -> DataFrame:
    return events.groupBy(mask(F.col(text)).alias("template"), F.window("ts", width).alias("w")).agg(F.count(F.lit(1)).alias("occurrences")).select("template", F.unix_micros("w.start").alias("start_us"), "occurrences")


def sessions(events: DataFrame, key: str, gap: str = "6 hours") -> DataFrame:
    """Incidents: runs of events of a key with gaps below ``gap``."""
    w = F.session_window("ts", gap)
    return events.groupBy(key, w.alias("w")).agg(F.count(F.lit(1)).alias("events")).select(key, F.unix_micros("w.start").alias("start_us"), "events")


def first_seen(events: DataFrame, keys: list[str]) -> DataFrame:
    return events.dropDuplicatesWithinWatermark(keys)


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Writes what is there now as Parquet and ends."""
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()


BUCKETS = 32


def states_table(spark: SparkSession, path: str, stream: DataFrame, key: str, order: list[str], state: str) -> KeyedTable:
    """Where ``run_states`` keeps the last state of each key."""
    kinds = ", ".join(f"`{c}` {stream.schema[c].dataType.simpleString()}" for c in (key, *order, state))
    return KeyedTable(spark, path, f"_bucket int, {kinds}", [key], "_bucket")


def run_states(stream: DataFrame, key: str, order: list[str], state: str, path: str, checkpoint: str) -> KeyedTable:
    """Folds a stream into the last state of each key, until all that is there is read.

    The fold itself is in the stream's state store. A batch brings the keys that changed, and only their buckets of the
    table are written; a batch that runs again writes the same rows.
    """
    table = states_table(stream.sparkSession, path, stream, key, order, state)
    last = stream.groupBy(key).agg(F.max(F.struct(*order, state)).alias("_x")).select(F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int").alias("_bucket"), key, "_x.*")
    q = last.writeStream.outputMode("update").foreachBatch(lambda batch, n: table.upsert(batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return table


def status_events(lines: DataFrame, schema: str, key: str, column: str = "value") -> DataFrame:
    """Status messages of a stream of JSON lines; malformed ones, and those without their key, are ignored."""
    return lines.select(F.from_json(F.col(column), schema, {"mode": "PERMISSIVE"}).alias("e")).where(F.col(f"e.{key}").isNotNull()).select("e.*")


def relay(spark: SparkSession, path: str, schema: str, run_id: str, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a listener to a run gets: its state now (of ``known``: run_id, seq, ...), then a stream of later events, oldest
    state first and none twice: an event that the state covers already isn't relayed."""
    now = known.where(F.col("run_id") == run_id).orderBy(F.desc("seq")).limit(1)
    last = now.first()
    events = spark.readStream.schema(schema).parquet(path).where((F.col("run_id") == run_id) & (F.col("seq") > (last["seq"] if last else -1)))
    return now, events
