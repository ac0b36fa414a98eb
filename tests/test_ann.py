"""The inverted file against exact search: recall, filters, pruned cells, odd vectors."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark.operators import ann
from loomspark.plans import registry


def recall(found, exact):
    a, b = ({(r.query, r.id) for r in df.collect()} for df in (found, exact))
    return len(a & b) / len(b)


def test_recall_of_the_query(spark, data):
    q = registry.queries()
    assert recall(q["ann_topk"](spark, data), q["cosine_batch"](spark, data)) >= 0.9


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 16))[rng.integers(0, 40, 3000)] * 3 + rng.normal(size=(3000, 16))
    x[7] = 0
    x[1000:2000] = x[1000] + rng.normal(size=(1000, 16)) / 1000  # a third of all in one place
    rows = [(i, i % 3, v.tolist()) for i, v in enumerate(x)] + [(5000, 0, None)]
    return spark.createDataFrame(rows, "id long, part int, embedding array<double>")


def test_recall_cells_and_filters(spark, clustered, tmp_path):
    ix = ann.AnnIndex.build(clustered, str(tmp_path / "ix"), cells=32, pieces=4)
    asked = clustered.where("id % 100 = 3 and not id between 1000 and 1999")  # there, all are as near as can be told
    exact = ann.exact(clustered, asked, 10)
    assert recall(ix.search(asked, 10, probes=6), exact) >= 0.9
    few, cells = ix.candidates(asked.select(F.col("id").alias("query"), F.col("embedding").alias("q")).limit(1), 2, 50, None)
    plan = few._jdf.queryExecution().toString()
    assert len(cells) == 2 and re.search(r"PartitionFilters: \[[^\]]*cell#\d+ IN \(" + ",".join(map(str, cells)), plan)
    some = ix.search(asked, 10, probes=6, where=F.col("part") == 1)
    assert recall(some, ann.exact(clustered.where("part = 1"), asked, 10)) >= 0.9
    assert {r[0] % 3 for r in some.select("id").collect()} == {1}
    assert spark.read.parquet(f"{tmp_path}/ix/codes").count() == 3000  # all but the null are indexed


def test_all_cells_and_candidates_give_the_exact_result(spark, clustered, tmp_path, monkeypatch):
    monkeypatch.setattr(ann, "MOST_QUERIES", 8)  # the queries go in several rounds
    ix = ann.AnnIndex.build(clustered, str(tmp_path / "ix"), cells=8, pieces=8)
    asked = clustered.where("id % 300 = 7")
    got = sorted(tuple(r) for r in ix.search(asked, 5, probes=8, refine=3000).collect())
    monkeypatch.setattr(ann, "MOST_QUERIES", 4096)
    assert got == sorted(tuple(r) for r in ann.exact(clustered, asked, 5).collect())


def test_vectors_that_cannot_be_cut(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0])], "id long, embedding array<double>")
    with pytest.raises(ValueError, match="pieces"):
        ann.AnnIndex.build(df, str(tmp_path / "a"), pieces=2)
    with pytest.raises(ValueError, match="no vectors"):
        ann.AnnIndex.build(df.where("id = 0"), str(tmp_path / "b"))


def test_a_refine_of_all_makes_no_pairs(spark, monkeypatch, tmp_path):
    """Filtered and whole, in all cells and in some: what an exact search gives, though few rows go on and none of them is broadcast."""
    rng = np.random.default_rng(7)
    rows = spark.createDataFrame([(i, i % 3, rng.normal(size=16).tolist()) for i in range(600)], "id long, label int, embedding array<double>").repartition(3)
    ix = ann.AnnIndex.build(rows, f"file://{tmp_path}/ix", cells=12)
    monkeypatch.setattr(ann, "HELD", 2000)  # tasks drop candidates, and pass some on early
    asked = rows.where("id % 20 = 0")
    want = {tuple(r) for r in ann.exact(rows.where("label = 1"), asked, 5).collect()}
    got = ix.search(asked, 5, probes=ann.MOST_CELLS, refine=600, where=F.col("label") == 1)
    assert {tuple(r) for r in got.collect()} == want
    assert len(ix._scored_at_once(asked.select(F.col("id").alias("query"), F.col("embedding").alias("q")), 5, 12, None).collect()) < 600 * 30 / 4
    some = {(r.query, r.id) for r in ix.search(asked, 5, probes=6, refine=600).collect()}
    codes = {(r.query, r.id) for r in ix.search(asked, 5, probes=6, refine=599).collect()}
    assert some == codes
    few, _ = ix.candidates(asked.select(F.col("id").alias("query"), F.col("embedding").alias("q")), 12, 50, None)
    assert few.count() == 30 * 50
