"""The trigram index against comparing every name with every query."""

import random

import pytest

from loomspark.operators import grams


def cut(text):
    p = f"  {text.lower()} "
    return {p[i : i + 3] for i in range(len(p) - 2)}


def test_index_equals_all_pairs_and_compares_few(spark, tmp_path):
    rng = random.Random(9)
    parts = ["get", "set", "user", "name", "id", "by", "Order", "Line", "list", "x", "é"]
    names = ["".join(rng.choices(parts, k=rng.randrange(1, 5))) for _ in range(300)] + [""]
    asked = [n[:k] + n[k + 1 :] for n in rng.sample(names, 30) for k in [rng.randrange(len(n) + 1)]] + ["nothing like it", ""]
    ix = grams.GramIndex.build(spark.createDataFrame([(n,) for n in [*names, None]], "name string"), str(tmp_path / "ix"))
    queries = spark.createDataFrame([(q,) for q in [*asked, None]], "query string")
    for least in (0.3, 0.6, 1.0):
        score = lambda a, b: round(len(cut(a) & cut(b)) / len(cut(a) | cut(b)), 5)
        want = {(q, n, score(q, n)) for q in asked for n in names if score(q, n) >= least}
        assert {tuple(r) for r in ix.search(queries, least).collect()} == want
    n = ix.compared(queries, 0.6).count()
    assert n < len(set(asked)) * len(set(names)) / 4
    with pytest.raises(ValueError):
        ix.search(queries, 0.0)
