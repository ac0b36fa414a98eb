"""The segmented lexical index against scores counted by hand, over updates, removals and merges."""

import collections
import math
import random
import re

from pyspark.sql import functions as F

from loomspark.operators import embedding, postings


def tokens_of(text):
    out, whole = [], []
    for x in re.findall("[A-Za-z0-9_]+", text or ""):
        parts = re.sub("[^A-Za-z0-9]+", " ", re.sub("([a-z0-9])([A-Z])", r"\1 \2", x)).lower().split()
        out += parts
        whole += [x.lower()] if re.search("[a-z0-9][A-Z]|_", x) else []
    return out + whole


def by_hand(docs, words):
    counts = {i: collections.Counter(tokens_of(t)) for i, t in docs.items()}
    n, mean = len(docs), sum(sum(c.values()) for c in counts.values()) / max(1, len(docs))
    out = {}
    for i, c in counts.items():
        s = 0.0
        for w in words:
            df = sum(w in x for x in counts.values())
            if c[w]:
                s += math.log(1 + (n - df + 0.5) / (df + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean))
        if any(c[w] for w in words):
            out[i] = round(s, 6)
    return out


def best(scores, k):
    return sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k]


def near(got, want):
    assert [i for i, _ in got] == [i for i, _ in want] and all(abs(a - b) < 2e-6 for (_, a), (_, b) in zip(got, want, strict=True))


def test_counted_tokens(spark):
    df = spark.createDataFrame([(["b", "a", "b", "b", ""],), ([],), (["x"],)], "t array<string>")
    got = [[tuple(p) for p in r[0]] for r in df.select(postings.counted(F.col("t"))).collect()]
    assert got == [[("", 1), ("a", 1), ("b", 3)], [], [("x", 1)]]


def test_updates_and_merges_equal_counting_by_hand(spark, tmp_path):
    rng = random.Random(3)
    vocabulary = ["getUserById", "user", "id", "snake_case", "tide", "moor", "keel", "x9"]
    text = lambda: " ".join(rng.choices(vocabulary, [1, 3, 3, 1, 6, 2, 1, 1], k=rng.randrange(0, 30)))
    frame = lambda d: spark.createDataFrame([(i, t) for i, t in d.items()], "id long, text string")
    ix, live = postings.LexicalIndex(spark, str(tmp_path / "ix")), {}
    words = ["tide", "user", "KEEL", "absent"]
    assert ix.topk(words, 3).count() == 0 and ix.segments() == []
    steps = [{i: text() for i in range(60)} | {60: None, 61: ""}, {i: text() for i in range(50, 90)}, [3, 55, 1000], {i: text() for i in (3, 4, 5)}]
    for k, step in enumerate(steps):
        old = {s[2] for s in ix.segments()}
        if isinstance(step, dict):
            ix.add(frame(step))
            live |= step
        else:
            ix.remove(spark.createDataFrame([(i,) for i in step], "id long"))
            live = {i: t for i, t in live.items() if i not in step}
        assert old < {s[2] for s in ix.segments()} and len(ix.segments()) == k + 1  # a change makes a new segment and touches no other
        want = by_hand(live, ["tide", "user", "keel"])
        near([tuple(r) for r in ix.topk(words, 7).collect()], best(want, 7))
    near(sorted(tuple(r) for r in ix.scores(words).collect()), sorted(want.items()))
    assert ix.merge(9) is None
    assert ix.merge(3) is None and ix.merge(3, ratio=100) and len(ix.segments()) == 2
    near([tuple(r) for r in ix.topk(words, 7).collect()], best(want, 7))
    got = {(r.id, r.token): (r.tf, r.len) for r in ix.live_postings().collect()}
    assert got == {(i, w): (n, len(tokens_of(t))) for i, t in live.items() for w, n in collections.Counter(tokens_of(t)).items()}
    again = postings.LexicalIndex(spark, str(tmp_path / "ix"))  # opened again
    near([tuple(r) for r in again.topk(["keel"], 1).collect()], best(by_hand(live, ["keel"]), 1))


def test_blocks_below_the_threshold_are_skipped(spark, tmp_path):
    """A frequent word's postings that can't reach the ten best stay unread, and the result is the same."""
    rng = random.Random(4)
    docs = {i: "tide " * (1 + (i % 50 == 0) * rng.randrange(5, 60)) + "and more words of no use " * rng.randrange(1, 4) + "keel" * (i % 400 == 0) for i in range(4000)}
    ix = postings.LexicalIndex(spark, str(tmp_path / "ix"))
    ix.add(spark.createDataFrame(list(docs.items()), "id long, text string").repartition(3))
    near([tuple(r) for r in ix.topk(["tide", "keel"], 10).collect()], best(by_hand(docs, ["tide", "keel"]), 10))
    near([tuple(r) for r in ix.topk(["tide"], 10).collect()], best(by_hand(docs, ["tide"]), 10))
    told = {r.token: r for r in ix.skipped(["tide"], 10).collect()}
    assert told["tide"].blocks >= 4000 // postings.BLOCK and told["tide"].read <= told["tide"].blocks // 3
    every = ix.skipped(["tide"], 10_000).collect()  # no ten thousand documents have it: nothing can be skipped
    assert every[0].read == every[0].blocks


def test_tokens_of_odd_texts_are_cut_without_a_step_for_each(spark, tmp_path, monkeypatch):
    """What is stored equals counting by hand, a part of a batch at a time, and no interpreted function goes over tokens."""
    rng = random.Random(5)
    texts = [None, "", "_", "__a", "aB", "a_B", "Ab", "éaÉb a", "日本getUserById", "z9Z", "x" * 5000, " "] + ["".join(rng.choices("abzABZ09_ -é日\n\0", k=rng.randrange(0, 40))) for _ in range(3000)]
    monkeypatch.setattr(embedding, "PART_BYTES", 1000)
    plans, write = [], postings.LexicalIndex._write
    monkeypatch.setattr(postings.LexicalIndex, "_write", lambda self, rows, removed: plans.append(rows._jdf.queryExecution().optimizedPlan().toString()) or write(self, rows, removed))
    ix = postings.LexicalIndex(spark, str(tmp_path / "ix"))
    ix.add(spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(1))
    got = {r.id: (r.len, [tuple(p) for p in r.posts]) for r in ix.live_docs().collect()}
    assert got == {i: (len(tokens_of(t)), sorted(collections.Counter(tokens_of(t)).items())) for i, t in enumerate(texts)}
    assert len(plans) == 1 and "lambda" not in plans[0]
