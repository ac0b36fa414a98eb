import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark.operators import embedding, embedding_store
from loomspark.operators.embedding_store import EmbeddingStore

SCHEMA = "id long, text string, digest string"
ROWS = [(5, "settle an invoice", "a"), (2, "settle an invoice", "b"), (None, "settle an invoice", "c"), (1, "parse a log line", "d"), (3, "", "e"), (4, None, "f"), (3, "", "e")]


@pytest.fixture
def store(spark, tmp_path):
    return EmbeddingStore(spark, f"file://{tmp_path}/o'store", "m", embedding.provider("words", dimension=32), buckets=4)


def test_a_content_is_embedded_once(spark, store):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    assert store.add(rows) == 3 and store.add(rows) == 0
    more = rows.unionByName(spark.createDataFrame([(9, "a new text", "x"), (8, "a new text", "y")], SCHEMA))
    assert [r.text for r in store.missing(more).collect()] == ["a new text"]
    assert store.add(more) == 1 and store.vectors().count() == 4
    assert store.add(rows.limit(0)) == 0 and store.attached(rows).count() == 3
    want = dict(zip(["parse a log line", "a new text", ""], store.provider.embed(["parse a log line", "a new text", ""]), strict=True))
    got = {r.digest: r.embedding for r in store.vectors().collect()}
    for text, v in want.items():
        assert np.array_equal(got[spark.range(1).select(F.sha2(F.lit(text), 256)).first()[0]], v)


def test_another_session_finds_it_and_another_model_does_not(spark, store):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    store.add(rows)
    root = store.at.rsplit("/", 1)[0]
    spark.sql(f"DROP TABLE {store.name}")  # what another session's catalog knows of it
    again = EmbeddingStore(spark, root, "m", store.provider, buckets=4)
    assert again.add(rows) == 0 and again.vectors().count() == 3
    assert EmbeddingStore(spark, root, "n", store.provider, buckets=4).missing(rows).count() == 3
    assert EmbeddingStore(spark, root, "m", embedding.provider("words", dimension=16), buckets=4).missing(rows).count() == 3


def test_a_content_written_twice_is_read_once(spark, store):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    store.add(rows)
    store.vectors().repartition(4, "digest").write.insertInto(store.name)
    assert spark.table(store.name).count() == 6 and store.vectors().count() == 3
    assert store.search(rows, "invoice", 10).where("score > 0").count() == 3


def test_search_equals_brute_force(spark, store, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    store.add(docs)
    p = store.provider
    q = p.embed(["the data of a license"])[0]
    local = docs.collect()
    score = {}
    for r in local:
        v = p.embed([r.text])[0]
        n = np.linalg.norm(v) * np.linalg.norm(q)
        score[r.doc_id] = round(float(v @ q / n), 5) if n else 0.0
    want = sorted(score.items(), key=lambda x: (-x[1], x[0]))
    for k in (1, 7, 40):
        got = [(r.doc_id, r.score) for r in store.search(docs, "the data of a license", k, "doc_id").collect()]
        assert [g[0] for g in got] == [w[0] for w in want[:k]] and np.allclose([g[1] for g in got], [w[1] for w in want[:k]])


def test_ties_and_odd_rows(spark, store):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    store.add(rows)
    got = [r.id for r in store.search(rows, "settle invoice", 4).collect()]
    assert got == [2, 5, None, 1]  # copies by id, null last
    assert store.search(rows.limit(0), "settle", 3).count() == 0
    assert [r.score for r in store.search(rows, "", 2).collect()] == [0.0, 0.0]


def test_stored_vectors_are_not_shuffled(spark, store):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    store.add(rows)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = store.attached(rows)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert exchanges and "Bucketed: true" in plan
    tree = plan.splitlines()
    scan = next(i for i, line in enumerate(tree) if "FileScan parquet" in line)
    join = next(i for i, line in enumerate(tree) if "Join" in line)
    assert join < scan and not any("Exchange" in line for line in tree[join:scan])
