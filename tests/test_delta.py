"""Edges kept up to date equal those of a full run, whatever was added, renamed, moved and deleted; contents are scanned once."""

import random

import pytest
from pyspark.sql import functions as F

from loomspark.operators import delta, traverse
from loomspark.plans import runs
from loomspark.sources.graphs import GraphStore

from .test_index import CREW, DOCK, HULL, ROUTE, tree

NAMES = ["seal", "muster", "plan", "Hull", "Barge"]


def source(rng):
    """A file of functions and classes that call and extend each other by few names, so that most names have several candidates."""
    out = []
    for _ in range(rng.randrange(1, 4)):
        name, other = rng.choice(NAMES), rng.choice([*NAMES, "nowhere"])
        if name[0].isupper():
            out.append(f"class {name}({other if other[0].isupper() else ''}):\n    def {rng.choice(NAMES).lower()}(self):\n        return {rng.choice(NAMES)}(self)\n")
        else:
            out.append(f"def {name}(n):\n    return {other}(n)\n")
    return f"import {rng.choice(NAMES)}\n\n\n" + "\n\n".join(out)


def stored(store):
    return {name: sorted((tuple(r) for r in t.rows().collect()), key=repr) for name, t in store.tables.items()}


@pytest.mark.parametrize("seed", [1])
def test_random_steps_equal_a_full_run(spark, tmp_path, seed):
    rng = random.Random(seed)
    named = {f"f{i}": source(rng) for i in range(5)}
    store, seen = GraphStore(spark, str(tmp_path / "kept")), set()
    now = None
    for step in range(4):
        if step:
            for _ in range(2):
                kind, at = rng.choice(["add", "change", "move", "delete", "same again"]), rng.choice(sorted(named))
                if kind == "add":
                    named[f"g{step}{rng.randrange(9)}"] = source(rng)
                elif kind == "change":
                    named[at] = source(rng)
                elif kind == "move":
                    named[f"m{step}{rng.randrange(9)}"] = named.pop(at)
                elif kind == "same again":
                    named[f"s{step}{rng.randrange(9)}"] = named[at]
                elif len(named) > 1:
                    named.pop(at)
        files = tree(spark, **named)
        now, stats = runs.index_into(store, files, now)
        assert stats["contents_scanned"] == len(set(named.values()) - seen)
        seen |= set(named.values())
    fresh = GraphStore(spark, str(tmp_path / "fresh"))
    _, again = runs.index_into(fresh, files)
    assert stored(store) == stored(fresh)
    assert {k: stats[k] for k in ("files", "symbols", "calls", "unresolved_calls")} == {k: again[k] for k in ("files", "symbols", "calls", "unresolved_calls")}
    assert {r[0] for r in stored(store)["Edge"]} == {"r"}


def test_a_base_that_appears_replaces_the_name(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "g"))
    child = "class A(Base):\n    pass\n"
    now, _ = runs.index_into(store, tree(spark, a=child))
    _, stats = runs.index_into(store, tree(spark, a=child, b="class Base:\n    pass\n"), now)
    rows = store.edges(["r"]).where("type = 'INHERITS'").select("src_path", "dst_path", "dst_name").collect()
    assert [tuple(r) for r in rows] == [("a.py", "b.py", None)] and stats["contents_scanned"] == 1 and stats["edges_derived"] == 1


def test_only_touched_edges_are_derived_again(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "g"))
    named = dict(ferry__hull=HULL, ferry__crew=CREW, ferry__dock=DOCK, ferry__route=ROUTE)
    now, _ = runs.index_into(store, tree(spark, **named))
    _, stats = runs.index_into(store, tree(spark, **named), now)
    assert (stats["contents_scanned"], stats["edges_derived"], stats["files_indexed"]) == (0, 0, 0)
    # muster is called gather: of crew.py's own edges three, of all others only that of route.py's call of muster
    _, stats = runs.index_into(store, tree(spark, **{**named, "ferry__crew": CREW.replace("muster", "gather")}), now)
    edges = {tuple(r) for r in store.edges(["r"]).where("type <> 'DEFINES'").select("type", "src_path", "src_fqn", "via").collect()}
    assert ("CALLS_UNRESOLVED", "ferry/route.py", "plan", "muster") in edges and stats["contents_scanned"] == 1
    of_crew = {e for e in edges if e[1] == "ferry/crew.py"}
    assert stats["edges_derived"] == len(of_crew) + 1


def test_index_plans_scan_no_file_again(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "g"))
    now, _ = runs.index_into(store, tree(spark, a=HULL))
    now, _ = runs.index_into(store, tree(spark, a=HULL, b=CREW), now)
    assert "MapInPandas" not in now.calls._jdf.queryExecution().toString()


def test_affected_names(spark):
    row = "repo_id string, path string, fqn string, name string, kind string"
    old = spark.createDataFrame([("r", "a", "f", "f", "function"), ("r", "a", "g", "g", "function"), ("r", "a", "K", "K", "class"), ("r", "a", "v", "v", "variable")], row)
    new = spark.createDataFrame([("r", "a", "f", "f", "function"), ("r", "b", "g", "g", "function"), ("r", "a", "K", "K", "interface")], row)
    assert {r.name for r in delta.affected_names(old, new).collect()} == {"g", "K"}


def test_best_paths_equal_all_paths(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(8), rng.randrange(8), rng.choice([0.1, 0.5, 0.9, 1.0])) for _ in range(30)]
    df = spark.createDataFrame(edges, "src int, dst int, weight double")
    roots = spark.createDataFrame([(0,), (3,)], "root int")
    for depth, least in ((1, 0.0), (3, 0.0), (4, 0.2)):
        want = {}
        for root in (0, 3):
            front = {root: 1.0}
            for _ in range(depth):
                further = {}
                for s, t, w in edges:
                    if t in front and front[t] * w >= least:
                        further[s] = max(further.get(s, 0.0), front[t] * w)
                for k, v in further.items():
                    want[root, k] = max(want.get((root, k), 0.0), v)
                front = further
        got = {(r.root, r.node): r.strength for r in traverse.best_paths(df, roots, depth, least).collect()}
        assert {k: round(v, 9) for k, v in got.items()} == {k: round(v, 9) for k, v in want.items()}
