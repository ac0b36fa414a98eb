import os
import subprocess
import tarfile

import pytest
from pyspark.sql import functions as F

from loomspark.functions import scalars as S
from loomspark.operators import vectors
from loomspark.plans import runs
from loomspark.sources import acquire, migrations
from loomspark.streaming import logs as streaming


def test_addresses_and_tokens():
    assert [acquire.is_address(x) for x in ("https://h/r.git", "git@h:o/r.git", "ssh://h/r", "/tmp/r", "C:/r", "rel/r")] == [True, True, True, False, False, False]
    assert acquire.authorised("https://h/r", "t") == "https://oauth2:t@h/r" and acquire.authorised("https://a:b@h/r", "t") == "https://oauth2:t@h/r"
    assert acquire.authorised("git@h:r", "t") == "git@h:r" and acquire.authorised("https://h/r", None) == "https://h/r"


def test_local_trees_and_snapshots(spark, tmp_path):
    tree = tmp_path / "w"
    for p in ("a.py", "d/b.py", "node_modules/x.js", ".git2/c"):
        (tree / p).parent.mkdir(parents=True, exist_ok=True)
        (tree / p).write_text(p)
    assert acquire.acquire(str(tree), "").commit_sha == "local-working-tree"
    git = lambda *a: subprocess.run(["git", "-C", str(tree), "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", "a.py")
    git("commit", "-qm", "one")
    got = acquire.acquire(str(tree), "")
    assert got.path == str(tree) and len(got.commit_sha) == 40
    with pytest.raises(FileNotFoundError):
        acquire.acquire(str(tmp_path / "gone"), "")
    name = acquire.archive(spark, str(tree), str(tmp_path / "s"), "r", got.commit_sha)
    with tarfile.open(name) as tar:
        assert sorted(tar.getnames()) == [".git2/c", "a.py", "d/b.py"] and tar.extractfile("d/b.py").read() == b"d/b.py"
    os.chmod(tmp_path / "s", 0o755)
    assert acquire.archive(spark, str(tree), "nosuchscheme://x", "r", "c") is None


def test_migrations_apply_once_in_order(spark, tmp_path):
    folder = tmp_path / "m"
    folder.mkdir()
    (folder / "0002_more.sql").write_text("CREATE OR REPLACE TEMP VIEW mig_b AS SELECT n + 1 AS n FROM mig_a;\n")
    (folder / "0001_first.sql").write_text("-- the first\nCREATE OR REPLACE TEMP VIEW mig_a AS SELECT 1 AS n;\n-- done\n")
    (folder / ".0000_draft.sql").write_text("broken")
    (folder / "notes.txt").write_text("no")
    state = str(tmp_path / "state")
    assert migrations.apply(spark, str(folder), state) == ["0001_first.sql", "0002_more.sql"]
    assert spark.table("mig_b").first().n == 2
    assert migrations.apply(spark, str(folder), state) == []
    (folder / "0003_bad.sql").write_text("SELECT FROM WHERE;\n")
    for _ in range(2):  # what failed isn't recorded
        with pytest.raises(Exception):
            migrations.apply(spark, str(folder), state)


def test_bytes_become_text_as_in_python(spark):
    cases = [b"plain", "é日😀".encode(), b"a\xffb", b"\xe6\x97", b"\xf0\x9f\x98", b"\xc0\x80", b"\xed\xa0\x80", b"x\x80\x80y", b""]
    df = spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate(cases)], "i int, c binary")
    got = {r.i: r.t for r in df.select("i", S.utf8(F.col("c")).alias("t")).collect()}
    for i, c in enumerate(cases):
        assert got[i].replace("\ufffd", "") == c.decode("utf-8", "replace").replace("\ufffd", "") and ("\ufffd" in got[i]) == ("\ufffd" in c.decode("utf-8", "replace"))


def test_vectors_and_chunks_must_match(spark, tmp_path):
    store = vectors.VectorStore(spark, str(tmp_path / "v"), "repo_id string, id string, path string, embedding array<double>")
    chunks = spark.createDataFrame([("r", "1", "a"), ("r", "2", "b")], "repo_id string, id string, path string")
    v = lambda *ids: spark.createDataFrame([(i, [1.0, float(i)]) for i in ids], "id string, embedding array<double>")
    for bad in (v("1"), v("1", "3"), v("1", "2", "3")):
        with pytest.raises(ValueError):
            store.upsert(chunks, bad)
    assert store.count("r") == 0
    store.upsert(chunks, v("1", "2"))
    assert [r.id for r in store.search("r", [0.0, 1.0], 1).collect()] == ["2"] and store.search("r", [0.0, 1.0], 5, ["a"]).count() == 1
    store.delete_paths("r", [])
    store.delete_paths("other", ["a"])
    assert store.count("r") == 2 and store.search("other", [1.0, 0.0]).count() == 0


def test_listeners_get_the_state_and_then_what_follows(spark, tmp_path):
    runner = runs.Runner(spark, str(tmp_path / "e"))
    for status in ("queued", "running"):
        runner.tell("a", status)
    runner.tell("b", "queued")
    now, later = streaming.relay(spark, str(tmp_path / "e"), runs.EVENT, "a", runner.events())
    assert [r.status for r in now.collect()] == ["running"]
    runner.tell("a", "succeeded", stats={"n": 1})
    streaming.run_available(later, str(tmp_path / "o"), str(tmp_path / "c"))
    assert [r.status for r in spark.read.parquet(str(tmp_path / "o")).collect()] == ["succeeded"]
    none, stream = streaming.relay(spark, str(tmp_path / "e"), runs.EVENT, "nobody", runner.events())
    assert none.count() == 0


def test_mined_templates(spark):
    from loomspark.operators import logs

    lines = [f"Connection to db{i} timed out after {i}ms" for i in range(30)]
    lines += [f"user {n} logged in" for n in ("ann", "bob", "cy", "dee")] + ["user ann logged out"] * 3
    lines += ["disk full", "disk full", "Connection refused", None, "  "]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    for parts in (1, 16):
        got = {r.template: r.occurrences for r in logs.mined_templates(df, "line", 0.6, parts).collect()}
        assert got["Connection to db{*} timed out after {*}ms"] == 30 and got["disk full"] == 2 and got["Connection refused"] == 1
        assert sum(got.values()) == len(lines) - 1
        users = {t: n for t, n in got.items() if t.startswith("user")}
        assert sum(users.values()) == 7 and len(users) < 5
    strict = {r.template for r in logs.mined_templates(df, "line", 1.0).collect()}
    assert {"user ann logged in", "user bob logged in", "user ann logged out"} <= strict
    assert logs.mined_templates(df.where("false"), "line").count() == 0
