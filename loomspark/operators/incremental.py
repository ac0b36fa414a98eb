"""Incremental state: diffs by content hash, upserts, run state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff(present: DataFrame, stored: DataFrame, key: str = "path", digest: str = "content_hash") -> DataFrame:
    """key, change: added, changed, deleted or unchanged."""
    a = present.select(key, F.col(digest).alias("_new"))
    b = stored.select(F.col(key), F.col(digest).alias("_old"))
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "deleted").when(F.col("_new") != F.col("_old"), "changed").otherwise("unchanged")
    return a.join(b, key, "full_outer").select(key, change.alias("change"))


def upsert(stored: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The newest row by ``version`` of each key, as one aggregation with partial maxima."""
    columns = stored.columns
    rest = [c for c in columns if c not in keys and c != version]
    both = stored.unionByName(new.select(*columns))
    newest = both.groupBy(*keys).agg(F.max(F.struct(version, *rest)).alias("_r"))
    return newest.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in columns if c not in keys]).select(*columns)


def latest(runs: DataFrame, key: str, finished: str, tie: str) -> DataFrame:
    """The last finished run of each key, which an unfinished one is only where none has finished; an aggregation with partial maxima."""
    last = runs.groupBy(key).agg(F.max_by(F.struct(*runs.columns), F.struct(F.col(finished).isNotNull().alias("_f"), F.col(finished).alias("_t"), F.col(tie).alias("_i"))).alias("_r"))
    return last.select("_r.*")


def fold_states(events: DataFrame, key: str, order: list[str], state: str) -> DataFrame:
    """The last state of each key and the number of its events."""
    return events.groupBy(key).agg(F.max_by(state, F.struct(*order)).alias(state), F.count(F.lit(1)).alias("n_events"))


def mode_of(requested: str, has_success: bool) -> str:
    """full if asked for or if no run has succeeded; any other request is incremental."""
    return "full" if requested == "full" or not has_success else "incremental"


def mismatches(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that only one side has, with the side."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


#: Buckets of keys that have a digest each.
LEAVES = 4096


def digests(rows: DataFrame, key: str, leaves: int = LEAVES) -> DataFrame:
    """bucket, n, a, b: of each bucket of keys the number of rows and two sums of their hashes, which no order of rows changes.

    Summed within the tasks first, so a task sends at most a row for each bucket.
    """
    whole = [F.col(f"`{c}`") for c in sorted(rows.columns)]
    total = lambda seed: F.sum(F.xxhash64(F.lit(seed), *[F.struct(c.isNull(), c) for c in whole]).cast("decimal(20,0)"))
    bucket = F.pmod(F.xxhash64(F.col(key)), F.lit(leaves)).cast("int")
    return rows.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), total("a").alias("a"), total("b").alias("b"))


def differing(left: DataFrame, right: DataFrame, key: str, leaves: int = LEAVES) -> DataFrame:
    """bucket: those of which the two sides' digests differ."""
    a = digests(left, key, leaves).withColumn("side", F.lit(1))
    b = digests(right, key, leaves).withColumn("side", F.lit(-1))
    same = a.unionByName(b).groupBy("bucket").agg(*[F.sum(F.col(c) * F.col("side")).alias(c) for c in ("n", "a", "b")])
    return same.where("n <> 0 or a <> 0 or b <> 0").select("bucket")


def tree_mismatches(left: DataFrame, right: DataFrame, key: str, leaves: int = LEAVES) -> DataFrame:
    """What ``mismatches`` gives, comparing rows only in those buckets of keys whose digests differ: where the sides agree, nothing
    but the digests is shuffled. Rows with their columns in common order; two different buckets look the same by a chance of 2 ** -120 or so."""
    found = differing(left, right, key, leaves)
    of = F.pmod(F.xxhash64(F.col(key)), F.lit(leaves)).cast("int")
    some = lambda df: df.withColumn("bucket", of).join(F.broadcast(found), "bucket", "left_semi").select(*left.columns)  # noqa: E731  at most ``leaves`` rows
    return mismatches(some(left), some(right))


def embed_once(rows: DataFrame, text: str, embed) -> DataFrame:
    """Embeds each distinct content once. ``embed``: text column to vector column."""
    keyed = rows.withColumn("_h", F.sha2(F.col(text), 256))
    once = keyed.groupBy("_h").agg(F.first(text).alias("_t")).select("_h", embed(F.col("_t")).alias("embedding"))
    return keyed.join(once, "_h").drop("_h")


def insert_ignore(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """stored and those rows of ``new`` whose key it doesn't have; stored rows never change."""
    return stored.unionByName(new.dropDuplicates(keys).join(stored.select(*keys), keys, "left_anti").select(*stored.columns))


def delete_keys(stored: DataFrame, gone: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """What stays, and the deleted rows (none: there was nothing to delete)."""
    return stored.join(gone, keys, "left_anti"), stored.join(gone, keys, "left_semi")


def pending(available: DataFrame, applied: DataFrame, name: str = "name") -> DataFrame:
    """Migrations (``.sql`` names, dot files aside) not applied yet, in name order."""
    todo = available.where(F.col(name).endswith(".sql") & ~F.col(name).startswith("."))
    return todo.join(applied, name, "left_anti").orderBy(name)


def all_healthy(checks: DataFrame, group: str, ok: str) -> DataFrame:
    """A group is healthy if each of its checks is."""
    return checks.groupBy(group).agg(F.every(ok).alias("healthy"), F.count_if(~F.col(ok)).alias("failed"))


def run_statistics(changes: DataFrame, symbols: DataFrame, chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Of each run: files_indexed (added and changed), files_deleted, symbol_count and chunks_embedded of the files indexed.

    changes: keys, path, change; symbols and chunks: keys, path.
    """
    fresh = changes.where(F.col("change").isin("added", "changed"))
    files = changes.groupBy(*keys).agg(F.count_if(F.col("change").isin("added", "changed")).alias("files_indexed"), F.count_if(F.col("change") == "deleted").alias("files_deleted"))
    on = [*keys, "path"]
    count = lambda rows, name: rows.join(fresh.select(*on), on, "left_semi").groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    out = files.join(count(symbols, "symbol_count"), keys, "left").join(count(chunks, "chunks_embedded"), keys, "left")
    return out.na.fill(0, ["symbol_count", "chunks_embedded"])


def runs_of(events: DataFrame, key: str, order: list[str], status: str = "status", at: str = "at", error: str = "error") -> DataFrame:
    """Runs (or jobs) folded from their events: last status, when it first ran, when it ended and the error it ended with."""
    end = F.col(status).isin("succeeded", "failed")
    return events.groupBy(key).agg(
        F.max_by(status, F.struct(*order)).alias(status),
        F.min(F.when(F.col(status) == "running", F.col(at))).alias("started_at"),
        F.max(F.when(end, F.col(at))).alias("finished_at"),
        F.max_by(F.when(F.col(status) == "failed", F.col(error)), F.struct(*order)).alias(error),
    )


def ripple(changed: DataFrame, imports: DataFrame, modules: DataFrame) -> DataFrame:
    """Unchanged files that import a changed one and are resolved again. changed: path; imports: path, module; modules: module, path."""
    hit = modules.join(changed, "path", "left_semi").select("module").distinct()
    return imports.join(hit, "module", "left_semi").select("path").distinct().join(changed, "path", "left_anti")


def insert_where(new: DataFrame, owners: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows whose owner exists, to be inserted, and the others, refused."""
    return new.join(owners, keys, "left_semi"), new.join(owners, keys, "left_anti")


def propagated(rows: DataFrame, key: str, column: str, updates: DataFrame, value: str, states: dict[str, str], fallback: str) -> DataFrame:
    """rows whose ``column`` follows the last update of their key, by ``states``; rows without one stay as they are."""
    named = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in states.items() for x in kv]), F.col(value)), F.lit(fallback))
    patch = updates.select(F.col(key).alias("_k"), named.alias("_v"))
    return rows.join(patch, rows[key] == patch["_k"], "left").withColumn(column, F.coalesce("_v", column)).drop("_k", "_v")


def rotated(sessions: DataFrame, used: DataFrame, key: str, now) -> DataFrame:
    """Sessions after those of ``used`` (key, new_key) were exchanged: the old ones are revoked, new ones take their owner."""
    both = sessions.join(used, key, "left")
    live = F.col("revoked_at").isNull() & (F.col("expires_at") > now)
    kept = both.withColumn("revoked_at", F.when(F.col("new_key").isNotNull() & live, now).otherwise(F.col("revoked_at"))).drop("new_key")
    fresh = both.where(F.col("new_key").isNotNull() & live).withColumn(key, F.col("new_key")).drop("new_key")
    return kept.unionByName(fresh.withColumn("revoked_at", F.lit(None).cast(sessions.schema["revoked_at"].dataType)))
