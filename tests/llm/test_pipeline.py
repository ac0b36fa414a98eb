import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomspark.llm import common, sentencepiece_stream, toxicity_kn

from .test_llm_ops import DOC, brute_groups, brute_hits, key_of


def brute(rows, toxic, items):
    """What the stages keep of rows (doc_id, text), one after the other, by plain Python; ids at the end."""
    rows = [r for r in rows if not toxic(r[1])]
    count = collections.Counter(k for _, t in rows for k in {key_of(x) for x in (t or "").split("\n")} if k)
    rows = [(i, t if t is None else "\n".join(x for x in t.split("\n") if count[key_of(x)] < 10)) for i, t in rows]
    group = {i: c for i, _, c in brute_groups(rows, 5, 80)}
    rows = [(i, t) for i, t in rows if group[i] == i]
    out = {}
    v = sentencepiece_stream.Vocabulary(sentencepiece_stream.read_model())
    for i, t in rows:
        words = [x.decode() for x in common.folded_words(t)]
        hit, _ = brute_hits(words, items)
        if not (hit and 20 * len(hit) >= len(words)):
            out[i] = None if t is None else np.frombuffer(v.encode(t), "<i4").tolist()
    return out


def test_stage_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "sentencepiece"]


def test_pipeline_equals_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    bench = spark.read.parquet(f"{data}/benchmark.parquet").collect()
    model = toxicity_kn.train(docs, toxicity_kn.learn_rows(spark.read.parquet(f"{data}/labels.parquet")))
    items = [(r.item_id, [x.decode() for x in common.folded_words(r.text)]) for r in bench]
    want = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], lambda t: toxicity_kn.scored(model, [t])[0] >= 0.5, items)
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, data).collect()}
    assert got == want and 0 < len(got) < docs.count()


@pytest.mark.parametrize("k", range(4))
def test_stages_keep_the_columns_and_take_odd_rows(spark, data, k):
    rows = [(1, None, "en", "s", None), (2, "", None, None, 0), (None, "some words", "en", "s", 3), (3, "some words", "en", "s", 10), (3, "some words", "en", "s", 10)]
    docs = spark.createDataFrame(rows, DOC).withColumn("spans", F.lit(1)).withColumn("_key", F.lit("x"))
    out = corpus_pipeline.STAGES[k][1](spark, docs, data)
    assert out.columns == docs.columns
    got = out.collect()
    assert {r.doc_id for r in got} >= {1, 2, 3} and len(got) >= 4
    assert corpus_pipeline.STAGES[k][1](spark, docs.where("false"), data).count() == 0


def test_last_stage_takes_odd_rows(spark, data):
    rows = [(1, None, "en", "s", None), (2, "", None, None, 0), (None, "some words", "en", "s", 3), (3, "some words", "en", "s", 10), (3, "some words", "en", "s", 10)]
    docs = spark.createDataFrame(rows, DOC).withColumn("ids", F.lit(1)).withColumn("n_pieces", F.lit("x"))
    out = corpus_pipeline.sentencepiece(spark, docs, data)
    assert out.columns == ["doc_id", "lang", "source", "n_pieces", "ids"]
    got = {(r.doc_id, r.n_pieces, None if r.ids is None else len(r.ids)) for r in out.collect()}
    n = len(np.frombuffer(sentencepiece_stream.Vocabulary(sentencepiece_stream.read_model()).encode("some words"), "<i4"))
    assert out.count() == 5 and got == {(1, 0, None), (2, 0, 0), (None, n, n), (3, n, n)}
    assert corpus_pipeline.sentencepiece(spark, docs.where("false"), data).count() == 0


@pytest.mark.parametrize("k", range(5))
def test_stages_take_very_long_texts(spark, data, k):
    rng = np.random.default_rng(k)
    prose = " ".join(rng.choice([f"word{i}" for i in range(3000)], 150_000))
    lines = "\n".join(f"line {i} of many" for i in range(40_000))
    docs = spark.createDataFrame([(1, prose, "en", "s", 0), (2, lines, "en", "s", 0), (3, "q" * 300_000, "en", "s", 0), (4, "short one", "en", "s", 9)], DOC)
    got = {r.doc_id for r in corpus_pipeline.STAGES[k][1](spark, docs, data).collect()}
    assert got == {1, 2, 3, 4}


def test_near_duplicates_of_rows_without_ids(spark, data):
    words = [f"w{i}" for i in range(60)]
    text, close, other, third = " ".join(words), " ".join([*words, "end"]), "quite another text without an id", "a text that has one id and a copy without"
    rows = [(None, text), (None, text), (None, close), (None, other), (None, None), (None, " "), (7, third), (None, third), (8, "eight"), (9, "eight")]
    docs = spark.createDataFrame([(i, t, "en", "s", k) for k, (i, t) in enumerate(rows)], DOC)
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, data).collect()]
    group = [x for x in got if x[1] in (text, close)]
    assert len(group) == 1 and sorted(set(got) - set(group), key=str) == sorted([(None, other), (None, None), (None, " "), (7, third), (8, "eight")], key=str) and len(got) == 6
