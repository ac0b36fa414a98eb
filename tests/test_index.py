import gzip
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomspark.operators import chunks, graph, incremental, logs, traverse
from loomspark.plans import index
from loomspark.sources import files as sources
from loomspark.streaming import logs as streaming

HULL = "def seal(plank):\n    return plank\n\n\nclass Hull:\n    def launch(self):\n        seal(self)\n        return steer(self)\n"
CREW = "import ferry.hull\n\n\ndef muster(n):\n    return seal(n)\n\n\ndef steer(ship):\n    return ship.heading()\n"
DOCK = "from ferry.hull import Hull\n\n\nclass Barge(Hull):\n    def board(self, n):\n        return seal(n)\n"
ROUTE = "import ferry.crew\nimport ferry.dock\n\n\ndef plan(barge):\n    muster(3)\n    barge.board(4)\n    return barge.launch()\n"
ROWS = "repo_id string, path string, language string, content binary, content_hash string"


def tree(spark, **named):
    rows = [("r", p.replace("__", "/") + ".py", "python", t.encode()) for p, t in named.items()]
    return spark.createDataFrame(rows, "repo_id string, path string, language string, content binary").withColumn("content_hash", F.sha2("content", 256))


def stats(ix):
    return ix.stats().first().asDict()


def edges(ix):
    return {tuple(r) for r in ix.calls.collect()}


def ident(path, fqn):
    return f"r\x1f{path}\x1f{fqn}"


def impact_of(spark, ix, path, fqn, depth=3):
    roots = spark.createDataFrame([(ident(path, fqn),)], "root string")
    paths = ix.nodes.select(F.concat_ws("\x1f", "repo_id", "path", "fqn").alias("id"), "path")
    return traverse.impact(ix.call_edges(), roots, paths, depth).first()


def test_a_diamond_of_calls(spark):
    ix = index.full(tree(spark, ferry__hull=HULL, ferry__crew=CREW, ferry__dock=DOCK, ferry__route=ROUTE))
    assert stats(ix) == {"files": 4, "symbols": 12, "calls": 7, "unresolved_calls": 1}
    assert {(r.src_fqn, r.dst_fqn, r.confidence) for r in ix.calls.collect()} == {
        ("Hull.launch", "seal", 1.0), ("Hull.launch", "steer", 1.0), ("muster", "seal", 1.0), ("Barge.board", "seal", 1.0),
        ("plan", "muster", 1.0), ("plan", "Barge.board", 1.0), ("plan", "Hull.launch", 1.0),
    }
    assert [(r.src_fqn, r.type, r.dst_path, r.dst_fqn) for r in ix.inheritance.collect()] == [("Barge", "INHERITS", "ferry/hull.py", "Hull")]
    assert {(r.path, r.module) for r in ix.imports.collect()} == {("ferry/crew.py", "ferry.hull"), ("ferry/dock.py", "ferry.hull"), ("ferry/route.py", "ferry.crew"), ("ferry/route.py", "ferry.dock")}
    r = impact_of(spark, ix, "ferry/hull.py", "seal")  # plan is reached by three ways and counts once
    assert (r.dependent_count, r.cross_file_count, r.risk_score) == (4, 3, 0.14)
    assert impact_of(spark, ix, "ferry/hull.py", "seal", 1).dependent_count == 3
    roots = spark.createDataFrame([(ident("ferry/hull.py", "Hull.launch"),)], "root string")
    found = {(r.node.split("\x1f")[2], r.direction, r.depth) for r in traverse.neighborhood(ix.call_edges(), roots, 2).collect()}
    assert found == {("seal", "callee", 1), ("steer", "callee", 1), ("plan", "caller", 1)}


def test_rename_move_and_removal_equal_a_full_run(spark):
    ix = index.full(tree(spark, ferry__hull=HULL, ferry__crew=CREW, ferry__dock=DOCK, ferry__route=ROUTE))
    steps = [
        # muster is called gather now, its caller isn't changed
        (dict(ferry__hull=HULL, ferry__crew=CREW.replace("muster", "gather"), ferry__dock=DOCK, ferry__route=ROUTE), {("ferry/crew.py", "changed")}, {"files": 4, "symbols": 12, "calls": 6, "unresolved_calls": 2}),
        # dock.py moves as it is
        (dict(ferry__hull=HULL, ferry__crew=CREW.replace("muster", "gather"), quay=DOCK, ferry__route=ROUTE), {("ferry/dock.py", "deleted"), ("quay.py", "added")}, {"files": 4, "symbols": 12, "calls": 6, "unresolved_calls": 2}),
        # the callee of most goes
        (dict(ferry__crew=CREW.replace("muster", "gather"), quay=DOCK, ferry__route=ROUTE), {("ferry/hull.py", "deleted")}, {"files": 3, "symbols": 8, "calls": 1, "unresolved_calls": 5}),
    ]
    for named, expected, counts in steps:
        files = tree(spark, **named)
        ix, changes = index.incremental(ix, files)
        assert {(r.path, r.change) for r in changes.collect()} == expected
        assert stats(ix) == counts
        again = index.full(files)
        assert edges(ix) == edges(again) and {tuple(r) for r in ix.inheritance.collect()} == {tuple(r) for r in again.inheritance.collect()}


def test_resolution_cases(spark):
    sym = spark.createDataFrame([("r", p, f, n, k) for p, f, n, k in [("a", "f", "f", "function"), ("b", "f", "f", "function"), ("c", "f", "f", "method"), ("a", "g", "g", "function"), ("a", "K", "K", "class"), ("b", "K", "K", "class"), ("a", "<module>", "a", "module")]], "repo_id string, path string, fqn string, name string, kind string")
    refs = spark.createDataFrame([("r", "a", "g", "f"), ("r", "a", "g", "f"), ("r", "a", "g", "g"), ("r", "a", "<module>", "K"), ("r", "a", "<module>", "f"), ("r", "x", "gone", "f")], "repo_id string, path string, caller_fqn string, callee_name string")
    got = graph.resolve_calls(refs, sym).collect()
    assert len([r for r in got if r.src_fqn == "g"]) == 3 and {round(r.confidence, 6) for r in got} == {round(1 / 3, 6)}
    assert {(r.caller_fqn, r.callee_name) for r in graph.unresolved_calls(refs, sym).collect()} == {("g", "g"), ("<module>", "K")}
    inh = spark.createDataFrame([("r", "c", "D", "K", "inherits"), ("r", "c", "E", "K<T>", "implements")], "repo_id string, path string, subclass_fqn string, base_name string, kind string")
    found = {(r.src_fqn, r.type, r.dst_path, r.dst_name) for r in graph.resolve_inheritance(inh, sym).collect()}
    assert found == {("D", "INHERITS", "a", None), ("D", "INHERITS", "b", None), ("E", "IMPLEMENTS", None, "K<T>")}


def test_cycles_depth_and_empty_repo(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "d")], "src string, dst string")
    root = spark.createDataFrame([("a",)], "root string")
    assert {r.node for r in traverse.reach(e, root, 2, reverse=True).collect()} == {"a", "b"}
    assert {r.node for r in traverse.reach(e, root, 0).collect()} == {"b"}
    assert {(r.node, r.depth) for r in traverse.reach(e, root, 99).collect()} == {("b", 1), ("a", 2), ("c", 2), ("d", 3)}
    ix = index.full(spark.createDataFrame([], ROWS))
    assert set(stats(ix).values()) == {0}


BUOY = '''"""Tides."""
import math
TIDE = 2

class Buoy:
    colour = "red"

    class Light:
        period = 3

        def flash(self):
            return self.period

    def drift(self, hours):
        total = 0
        for h in range(hours):
            total += h
        return total

def anchor(buoy):
    return buoy.drift(TIDE)
'''


def test_chunks(spark):
    long = "def much():\n" + "    step()\n" * 240
    texts = {"sea/buoy.py": BUOY, "none.py": "", "plain.py": "\n".join(f"x{i}()" for i in range(100)), "long.py": long}
    files = spark.createDataFrame([("r", p, "python", t) for p, t in texts.items()], "repo_id string, path string, language string, text string")
    ix = index.full(files.withColumn("content", F.encode("text", "UTF-8")).withColumn("content_hash", F.sha2("content", 256)))
    got = chunks.chunks(files, ix.symbols).collect()
    own = {(r.fqn, r.kind): (r.start_line, r.end_line) for r in got if r.path == "sea/buoy.py"}
    assert own == {
        (None, "module"): (1, 2), ("Buoy", "class"): (5, 7), ("Buoy.Light", "class"): (8, 10), ("Buoy.Light.flash", "method"): (11, 12),
        ("Buoy.drift", "method"): (14, 18), ("anchor", "function"): (20, 21),
    }
    lines = BUOY.split("\n")
    for r in got:
        if r.path == "sea/buoy.py":
            assert r.text == f"sea/buoy.py:{r.start_line}-{r.end_line} {r.kind} {r.fqn or ''}".rstrip() + "\n" + "\n".join(lines[r.start_line - 1 : r.end_line])
    assert {(r.start_line, r.end_line) for r in got if r.path == "plain.py"} == {(1, 80)}
    assert sorted((r.start_line, r.end_line) for r in got if r.path == "long.py") == [(1, 120), (101, 220), (201, 241)]
    assert not [r for r in got if r.path == "none.py"] and len({r.id for r in got}) == len(got)


@pytest.mark.parametrize("n, expected", [(0, 0), (1, 1), (120, 1), (121, 2), (220, 2), (221, 3), (401, 4)])
def test_windows(spark, n, expected):
    w = spark.range(1).select(chunks.windows(F.lit(1), F.lit(n)).alias("w")).first().w
    assert len(w) == expected
    if n == 401:
        assert [(x.first, x.last) for x in w] == [(1, 120), (101, 220), (201, 320), (301, 401)]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6)), max_size=12))
def test_reach_grows_with_depth(spark, pairs):
    e = spark.createDataFrame(pairs or [(0, 1)], "src int, dst int")
    root = spark.createDataFrame([(0,)], "root int")
    last: set = set()
    for depth in (1, 2, 3):
        now = {r.node for r in traverse.reach(e, root, depth).collect()}
        assert last <= now
        last = now


def test_modes():
    assert incremental.mode_of("full", True) == incremental.mode_of("auto", False) == "full"
    assert incremental.mode_of("auto", True) == incremental.mode_of("whatever", True) == "incremental"


def test_scan_tree_and_snapshot(spark, tmp_path):
    for p in ("a.py", "node_modules/x.js", "src/b.min.js", "src/c.ts", "src/d.toml", "yarn.lock"):
        (tmp_path / "t" / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "t" / p).write_text("x = 1\n")
    files = sources.scan_tree(spark, str(tmp_path / "t"), "r")
    assert {(r.path, r.language) for r in files.collect()} == {("a.py", "python"), ("src/c.ts", "typescript")}
    sources.write_snapshot(files, str(tmp_path / "s"), "sha")
    assert spark.read.parquet(str(tmp_path / "s")).where("repo_id = 'r' and commit_sha = 'sha'").count() == 2


def test_log_source_and_archive(spark, tmp_path):
    with gzip.open(tmp_path / "l.json.gz", "wt") as f:
        f.write(json.dumps({"ts": "2024-01-02T03:04:05Z", "service": "a", "message": "x 1", "attributes": {"token": "s"}}) + "\nnot json\n{}\n")
    e = sources.read_logs(spark, str(tmp_path / "l.json.gz"))
    assert [(r.service, r.message) for r in e.collect()] == [("a", "x 1")]
    sources.archive_logs(e, str(tmp_path / "arch"))
    assert spark.read.parquet(str(tmp_path / "arch")).where("day = '2024-01-02'").count() == 1


def test_streams_equal_batch(spark, data, tmp_path):
    from loomspark.plans import proxies

    raw = spark.read.parquet(f"{data}/events.parquet")
    last = raw.selectExpr("max(ts) as t").first().t
    raw.write.parquet(str(tmp_path / "in"))
    late = spark.createDataFrame([(-1, last.replace(year=last.year + 1), 1, "view", 0.0, "{}")], raw.schema)  # moves the watermark past all
    late.write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: streaming.with_time(spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    batch = proxies.events(spark, data)
    streaming.run_available(streaming.sliding_rate(stream(), ["event_type"]), str(tmp_path / "o1"), str(tmp_path / "c1"))
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "o1")).collect()}
    want = {tuple(r) for r in logs.sliding_rate(batch, ["fingerprint"]).collect()}
    assert got == want
    streaming.run_available(streaming.sessions(stream(), "user_id"), str(tmp_path / "o2"), str(tmp_path / "c2"))
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "o2")).collect()}
    want = {(r.service, r.start_us, r.events) for r in logs.incidents(batch, "service", 6 * logs.HOUR - 1).collect()}
    assert got == want
    streaming.run_available(streaming.first_seen(stream(), ["event_type"]).select("event_type"), str(tmp_path / "o3"), str(tmp_path / "c3"))
    assert spark.read.parquet(str(tmp_path / "o3")).distinct().count() == batch.select("fingerprint").distinct().count()


def test_stream_of_states_equals_fold(spark, data, tmp_path):
    raw = spark.read.parquet(f"{data}/events.parquet")
    raw.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    table = streaming.run_states(stream, "user_id", ["ts", "event_id"], "event_type", str(tmp_path / "s"), str(tmp_path / "c"))
    got = {(r.user_id, r.event_type) for r in table.rows().collect()}
    assert got == {(r.user_id, r.event_type) for r in incremental.fold_states(raw, "user_id", ["ts", "event_id"], "event_type").collect()}


def test_status_messages_ignore_malformed_ones(spark):
    lines = spark.createDataFrame([('{"job_id": "a", "status": "running"}',), ("{broken",), ('{"status": "lost"}',), (None,), ("[]",)], "value string")
    got = streaming.status_events(lines, "job_id string, status string", "job_id").collect()
    assert [(r.job_id, r.status) for r in got] == [("a", "running")]


def test_tree_scan_leaves_out_generated_and_hidden_files(spark, tmp_path):
    root = tmp_path / "t"
    for p, text in {"a.py": "x = 1\n", "gen/b.py": "# Code generated by tool. DO NOT EDIT.\n", "docs/c.py": "y\n", "keep/docs.py": "z\n", "lib/old_1.py": "w\n", ".scanignore": "# ours\n/docs\nold_*.py\n", "node_modules/m/i.js": "1\n"}.items():
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text(text)
    assert {r.path for r in sources.scan_tree(spark, str(root), "r").collect()} == {"a.py", "keep/docs.py"}
    (tmp_path / "none").mkdir()
    assert sources.scan_tree(spark, str(tmp_path / "none"), "r").count() == 0


def test_keyed_table_versions_conflicts_and_odd_partitions(spark, tmp_path):
    from loomspark.sources.stores import Conflict, KeyedTable

    make = lambda: KeyedTable(spark, str(tmp_path / "k"), "p string, id int, v string", ["p", "id"], "p")
    t = make()
    assert t.rows().count() == 0 and t.count("a") == 0
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b/ü", 1, "z"), (None, 3, "n")], "p string, id int, v string")
    t.upsert(rows)
    t.upsert(rows.where("false"))
    assert sorted(map(str, make().rows().collect())) == sorted(map(str, rows.collect()))  # opening again changes nothing
    t.upsert(spark.createDataFrame([("a", 2, "new"), ("a", 2, "new")], "p string, id int, v string"))
    assert {(r.id, r.v) for r in t.rows(["a"]).collect()} == {(1, "x"), (2, "new")}
    version, parts = t._state()
    other = make()
    other.purge("b/ü")
    with pytest.raises(Conflict):
        t._commit(version + 1, parts)
    t.delete(spark.createDataFrame([("a", 1)], "p string, id int"))
    assert {(r.p, r.id) for r in t.rows().collect()} == {("a", 2), (None, 3)}
