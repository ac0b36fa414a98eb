"""Index runs as jobs: enqueued under an id, run beside each other within limits, told by status events.

Events (run_id, seq, status, at, error, stats) are appended to a table; ``incremental.runs_of`` folds them. Work that a
run does goes to Spark under the run's own job group, which is cancelled when its time is over.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor, wait

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import delta, graph, incremental
from ..sources.facts import FactStore
from ..sources.graphs import GraphStore
from ..sources.tables import durable
from . import index

#: Runs at a time, and seconds that one may take.
MOST_RUNS, MOST_SECONDS = 10, 1800
EVENT = "run_id string, seq long, status string, at double, error string, stats string"


class Runner:
    """Runs functions (run_id -> statistics) in the background."""

    def __init__(self, spark: SparkSession, events: str, most: int = MOST_RUNS, seconds: float = MOST_SECONDS):
        self.spark, self.path, self.seconds = spark, events, seconds
        self._pool = ThreadPoolExecutor(most)
        self._lock, self._seq = threading.Lock(), 0

    def tell(self, run_id: str, status: str, error: str | None = None, stats: dict | None = None) -> None:
        with self._lock:
            self._seq += 1
            row = (run_id, self._seq, status, time.time(), error, None if stats is None else json.dumps(stats))
            self.spark.createDataFrame([row], EVENT).coalesce(1).write.mode("append").parquet(self.path)

    def enqueue(self, work: Callable[[str], dict]) -> tuple[str, Future]:
        """The run's id at once; the future ends with the run."""
        run_id = uuid.uuid4().hex
        self.tell(run_id, "queued")
        return run_id, self._pool.submit(self._run, run_id, work)

    def _run(self, run_id: str, work: Callable[[str], dict]) -> str:
        self.tell(run_id, "running")
        done: dict = {}

        def body():
            self.spark.sparkContext.setJobGroup(run_id, f"index run {run_id}", interruptOnCancel=True)
            try:
                done["stats"] = work(run_id)
            except Exception as e:  # noqa: BLE001  whatever it is, the run's last event tells it
                done["error"] = str(e) or type(e).__name__

        thread = threading.Thread(target=body, daemon=True)
        thread.start()
        thread.join(self.seconds)
        if thread.is_alive():
            self.spark.sparkContext.cancelJobGroup(run_id)
            done = {"error": f"took over {self.seconds} seconds"}
        status = "failed" if "error" in done else "succeeded"
        self.tell(run_id, status, done.get("error"), done.get("stats"))
        return status

    def events(self) -> DataFrame:
        return self.spark.read.schema(EVENT).parquet(self.path)

    def states(self) -> DataFrame:
        """Each run's status, start, end and error."""
        return incremental.runs_of(self.events(), "run_id", ["seq"])

    def close(self, futures: list[Future] = ()) -> None:
        wait(futures)
        self._pool.shutdown()


def _facts(store: GraphStore) -> FactStore:
    return FactStore(store.spark, f"{store.root}/facts", index.FACTS.replace("path string, ", ""))


def _scanned(store: GraphStore, files: DataFrame) -> tuple[index.Index, int]:
    """The facts of files, read from where they are kept, and how many contents had to be scanned."""
    kept = _facts(store)
    n = kept.add(files, index.facts)
    return index.Index(kept.of(files).select(*[f.name for f in T.StructType.fromDDL(index.FACTS)])), n


def _edges(edges: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """edges and DEFINES, from each file to its symbols."""
    defines = graph.defines(symbols, files).select("repo_id", "type", F.col("path").alias("src_path"), F.lit("").alias("src_fqn"), F.col("path").alias("dst_path"), "dst_fqn")
    return edges.unionByName(defines, allowMissingColumns=True)


def index_into(store: GraphStore, files: DataFrame, before: index.Index | None = None) -> tuple[index.Index, dict]:
    """Indexes files in full, or on top of what the store has, and writes what changed to the store; the run's statistics.

    An incremental run scans contents that were never scanned, and derives edges of changed files and affected names only.
    """
    started = time.monotonic()
    key = ["repo_id", "path"]
    repos = [r[0] for r in files.select("repo_id").distinct().collect()]  # names of partitions
    if before is None:
        now, scanned = _scanned(store, files)
        nodes = durable(now.nodes, "nodes")
        edges = delta.edges_of(now.exploded("calls"), now.exploded("inherits"), nodes)
        store.rewrite(repos, lambda old: _edges(edges, nodes, now.files), lambda old: now.imports, lambda old: nodes, lambda old: now.files)
        indexed, deleted, derived = files.count(), 0, None
    else:
        had = store.tables["File"].rows()
        repos = sorted({*repos, *(r[0] for r in had.select("repo_id").distinct().collect())})
        side = lambda df: df.select(F.struct(*key).alias("key"), "content_hash")
        changes = durable(incremental.diff(side(files), side(had), "key").where("change <> 'unchanged'").select("key.*", "change"), "changes")
        counts = {r["change"]: r["n"] for r in changes.groupBy("change").agg(F.count(F.lit(1)).alias("n")).collect()}  # some kinds
        fresh, scanned = _scanned(store, files.join(changes.where("change <> 'deleted'").select(*key), key, "left_semi"))
        changed, new = changes.select(*key), durable(fresh.nodes, "nodes")
        symbols = store.tables["Symbol"].rows(repos)
        after = symbols.join(changed, key, "left_anti").unionByName(new.select(*symbols.columns))
        names = durable(delta.affected_names(symbols.join(changed, key, "left_semi"), new), "names")
        stored = store.edges(repos).where(F.col("type") != "DEFINES")
        edges = durable(delta.derived(stored, changed, names, after, fresh.exploded("calls"), fresh.exploded("inherits")), "edges")
        derived = edges.count()
        if counts:
            repos = [r[0] for r in changed.select("repo_id").distinct().collect()]
            kept = lambda old, side="path": old.join(changed.withColumnRenamed("path", side), ["repo_id", side], "left_anti")

            def merged(old: DataFrame) -> DataFrame:
                stay = kept(old, "src_path").where(F.col("type") == "DEFINES").select(*delta.EDGE).unionByName(delta.untouched(old.where(F.col("type") != "DEFINES"), changed, names))
                return stay.unionByName(_edges(edges, new, fresh.files))

            store.rewrite(repos, merged, lambda old: kept(old).unionByName(fresh.imports), lambda old: kept(old).unionByName(new.select(*old.columns)), lambda old: kept(old).unionByName(fresh.files.select(*old.columns)))
        now = index.Index(_facts(store).of(files).select(*[f.name for f in T.StructType.fromDDL(index.FACTS)]))
        indexed, deleted = counts.get("added", 0) + counts.get("changed", 0), counts.get("deleted", 0)
    stats = {"mode": "full" if before is None else "incremental", "files_indexed": indexed, "files_deleted": deleted, "contents_scanned": scanned, "edges_derived": derived, **store.stats(repos)}
    return now, stats | {"duration_ms": int((time.monotonic() - started) * 1000)}
