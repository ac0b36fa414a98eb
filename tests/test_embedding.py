import numpy as np
import pytest

from loomspark.operators import embedding


def test_provider_port():
    p = embedding.provider("hash", dimension=32)
    assert np.allclose(np.linalg.norm(p.embed(["some text", "more"]), axis=1), 1) and not p.embed([""]).any()
    assert embedding.checked(p, []).shape == (0, 32)
    with pytest.raises(ValueError):
        embedding.provider("other")

    class Wrong(embedding.HashProvider):
        def embed(self, texts):
            return np.zeros((len(texts), 3))

    with pytest.raises(ValueError):
        embedding.checked(Wrong(8), ["x"])


def test_search_finds_the_text(spark):
    p = embedding.provider("hash")
    rows = spark.createDataFrame([(1, "settle an invoice"), (2, "parse a log line"), (3, ""), (4, None)], "id int, text string")
    got = embedding.search(embedding.embedded(rows, p), "invoice settle", p, 2).collect()
    assert got[0].id == 1 and len(got) == 2
