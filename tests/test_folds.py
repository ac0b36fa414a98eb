"""Folds over long series and many spans: equal to brute force, and linear."""

import random
import time

from pyspark.sql import functions as F

from loomspark.operators import incremental, logs, retrieval


def test_ewma_of_long_series(spark):
    """Forty thousand points are no more than some passes over ten thousand; nulls keep the mean."""
    took = []
    for n in (10_000, 40_000):
        series = spark.range(n).select((F.col("id") % 2).alias("k"), F.col("id").alias("t"), ((F.col("id") * 7919) % 101).alias("x"))
        start = time.perf_counter()
        got = logs.ewma(series, ["k"], "t", "x").orderBy("t").collect()
        took.append(time.perf_counter() - start)
    mean = {}
    for r in got:
        m = mean.get(r.k)
        assert (r.baseline is None and m is None) or abs(r.baseline - m) < 1e-6
        mean[r.k] = r.x if m is None else m * 0.7 + r.x * 0.3
    assert took[1] < 4 * took[0] + 5
    odd = spark.createDataFrame([(None, 1, 2.0), (None, 2, None), (None, 3, 4.0), ("a", 1, None), ("a", 2, 5.0)], "k string, t int, x double")
    assert {(r.k, r.t): r.baseline for r in logs.ewma(odd, ["k"], "t", "x").collect()} == {(None, 1): None, (None, 2): 2.0, (None, 3): 2.0, ("a", 1): None, ("a", 2): None}


def test_overlaps_equal_all_pairs(spark):
    rng = random.Random(8)
    value = lambda n: rng.choice([None] + list(range(n)) * 3)
    rows = [(i, value(3), value(12), value(14), value(40)) for i in range(400)]
    hits = spark.createDataFrame(rows, "id int, path int, first int, last int, rank int")
    covers = lambda b, h: None not in (*b, *h[1:]) and b[1] == h[1] and b[2] <= h[2] and b[3] >= h[3] and b[4] < h[4]
    want = {h[0] for h in rows if not any(covers(b, h) for b in rows)}
    assert {r.id for r in retrieval.without_overlaps(hits, "path", "first", "last", "rank").collect()} == want


def test_overlaps_of_one_large_file(spark):
    """Thirty thousand hits of one file, nested and side by side; all pairs would be nearly a thousand million."""
    hits = spark.range(30_000).select(F.lit("f").alias("path"), (F.col("id") % 1000 * 20).alias("first"), (F.col("id") % 1000 * 20 + 19 - F.floor(F.col("id") / 1000) % 7).alias("last"), F.col("id").alias("rank"))
    assert retrieval.without_overlaps(hits, "path", "first", "last", "rank").count() == 1000


def test_digests_tell_where_two_sides_differ(spark):
    row = "path string, content_hash string"
    rng = random.Random(2)
    left = [(rng.choice([None, *map(str, range(300))]), rng.choice(["a", "b", None])) for _ in range(500)]
    right = left[5:] + [("7", "c"), ("7", "c"), (None, "a")]
    a, b = spark.createDataFrame(left, row), spark.createDataFrame(right[::-1], row)
    told = lambda df: sorted(map(repr, df.collect()))
    assert told(incremental.tree_mismatches(a, b, "path", 64)) == told(incremental.mismatches(a, b)) != []
    assert incremental.differing(a, b, "path", 64).count() <= 8
    assert incremental.differing(a, spark.createDataFrame(left[::-1], row), "path", 64).count() == 0
    assert incremental.tree_mismatches(a, a, "path").count() == 0
