import time

import pytest
from pyspark.sql import functions as F

from loomspark.operators import models
from loomspark.plans import index, runs
from loomspark.sources.graphs import GraphStore

from .test_index import CREW, DOCK, HULL, ROUTE, tree


def test_runs_are_told_by_events(spark, tmp_path):
    runner = runs.Runner(spark, str(tmp_path / "events"), most=2, seconds=5)

    def fails(run_id):
        raise ValueError("no such commit")

    def slow(run_id):
        time.sleep(30)
        return {}

    quick, a = runner.enqueue(lambda run_id: {"rows": spark.range(10).count()})
    broken, b = runner.enqueue(fails)
    late, c = runner.enqueue(slow)
    runner.close([a, b, c])
    got = {r.run_id: r for r in runner.states().collect()}
    assert {k: got[k].status for k in (quick, broken, late)} == {quick: "succeeded", broken: "failed", late: "failed"}
    assert got[quick].error is None and got[broken].error == "no such commit" and "5 seconds" in got[late].error
    assert all(r.started_at <= r.finished_at for r in got.values())
    order = [r.status for r in runner.events().where(F.col("run_id") == quick).orderBy("seq").collect()]
    assert order == ["queued", "running", "succeeded"]


def test_index_runs_write_the_graph(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "g"))
    files = tree(spark, ferry__hull=HULL, ferry__crew=CREW, ferry__dock=DOCK, ferry__route=ROUTE)
    now, stats = runs.index_into(store, files)
    assert {k: stats[k] for k in ("mode", "files_indexed", "files_deleted", "files", "symbols", "calls", "unresolved_calls")} == {"mode": "full", "files_indexed": 4, "files_deleted": 0, "files": 4, "symbols": 12, "calls": 7, "unresolved_calls": 1}
    assert {(r.label, r.n) for r in store.counts().collect()} == {("File", 4), ("Symbol", 12), ("Edge", 8), ("Import", 4)}
    files = tree(spark, ferry__crew=CREW.replace("muster", "gather"), quay=DOCK, ferry__route=ROUTE)
    again, stats = runs.index_into(store, files, now)
    assert (stats["mode"], stats["files_indexed"], stats["files_deleted"], stats["calls"]) == ("incremental", 2, 2, 1)
    fresh = index.full(files)
    keys = ["repo_id", "src_path", "src_fqn", "dst_path", "dst_fqn"]
    stored = {tuple(r) for r in store.tables["Edge"].rows().where("type = 'CALLS'").select(*keys).collect()}
    assert stored == {tuple(r) for r in fresh.calls.select(*keys).collect()}
    assert {tuple(r) for r in store.tables["Symbol"].rows().select("path", "fqn").collect()} == {tuple(r) for r in fresh.nodes.select("path", "fqn").collect()}


def good(path, payload):
    return 200, {"message": {"content": f"{payload['model']}: {payload['messages'][0]['content']}"}, "prompt_eval_count": 11, "eval_count": 3}


def test_tiers_and_token_use():
    p = models.HttpModels(good, {"standard": "big", "fast": "small", "reasoning": ""})
    assert [p.model_for(t) for t in ("fast", "reasoning", "standard", "other")] == ["small", "big", "big", "big"]
    a = p.chat([{"role": "user", "content": "hi"}], "fast")
    assert a.text == "small: hi" and a.total_tokens == 14


@pytest.mark.parametrize("statuses, tries, slept", [([503] * 5, 3, [0.5, 1.0]), ([400], 1, []), ([404, 200], 1, []), ([429, 500, 503], 3, [0.5, 1.0]), ([None] * 4, 3, [0.5, 1.0])])
def test_retries_stop_at_three_and_at_our_own_mistakes(statuses, tries, slept):
    seen, waited = [], []

    def transport(path, payload):
        seen.append(path)
        return statuses[len(seen) - 1], {}

    with pytest.raises(models.ProviderError):
        models.request(transport, "/api/chat", {}, sleep=waited.append)
    assert len(seen) == tries and waited == slept


def test_a_late_answer_counts_and_a_useless_one_is_an_error():
    replies = iter([(429, None), (200, {"message": {"content": "ok"}})])
    p = models.HttpModels(lambda path, payload: next(replies), {"standard": "m"}, sleep=lambda s: None)
    assert p.chat([]).text == "ok"
    with pytest.raises(models.ProviderError):
        models.HttpModels(lambda path, payload: (200, {"no": 1}), {"standard": "m"}).chat([])


def test_rows_are_answered_in_the_tasks(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "id int, prompt string")
    got = {r.id: r for r in models.answered(rows, models.HttpModels(good, {"standard": "m"})).collect()}
    assert got[1].answer == "m: a" and got[1].completion_tokens == 3 and got[2].answer == "m: " and got[1].error is None
    bad = models.answered(rows, models.HttpModels(lambda p, q: (403, None), {"standard": "m"})).collect()
    assert all(r.answer is None and "403" in r.error for r in bad)
