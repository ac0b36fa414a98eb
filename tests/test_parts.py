"""Texts become Python objects a part of Spark's batch at a time, so that a worker's memory doesn't grow with the batch."""

import numpy as np
from pyspark.sql import functions as F

from loomspark.llm import decontaminate
from loomspark.operators import embedding


class Watched:
    """Gives each text the greatest number of bytes and of texts that the interpreter's lists held at the call."""

    dimension = 2

    def embed(self, texts):
        import sys

        held = sys._getframe(2).f_locals["texts"]  # of the part being embedded
        return np.array([[len(held), sum(len(t or "") for t in held)]] * len(texts), float)


def test_embedding_takes_parts_of_a_batch(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 5 > 0, F.repeat(F.lit("word "), (F.col("id") % 700).cast("int"))).alias("text")).coalesce(1)
    got = embedding.embedded(rows, Watched()).collect()
    assert [r.id for r in got] == list(range(3000)) and [r.text for r in got] == [r.text for r in rows.collect()]
    assert max(r.embedding[0] for r in got) <= embedding.PART_ROWS and max(r.embedding[1] for r in got) <= embedding.PART_BYTES
    assert embedding.embedded(rows.limit(0), Watched()).count() == 0


def test_decontamination_passes_parts_of_a_batch_on(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "PART_BYTES", 500)
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("a b c d")).when(F.col("id") % 3 == 1, F.repeat(F.lit("x y "), 200)).alias("text")).coalesce(1)
    items = spark.createDataFrame([("i", "B c")], "item_id string, text string")
    got = decontaminate.report(decontaminate.find(docs, items)).orderBy("doc_id").collect()
    assert [(r.doc_id, r.n_words, r.n_hit) for r in got] == [(i, (4, 400, 0)[i % 3], (2, 0, 0)[i % 3]) for i in range(300)]
    assert [r.doc_id for r in decontaminate.decontaminated(docs, items).orderBy("doc_id").collect()] == [i for i in range(300) if i % 3]
