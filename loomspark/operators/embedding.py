"""Embeddings behind a port: a provider embeds batches of texts; the engine checks dimension and count.

The provider that comes with the engine hashes character trigrams and words; it is deterministic and needs no model, and
its quality isn't that of a neural one.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import ship
from . import retrieval

BATCH = 32
#: Of a batch from Spark, rows and bytes of text that are embedded at a time.
PART_ROWS, PART_BYTES = 1024, 1 << 20


class Provider(Protocol):
    dimension: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashProvider:
    """Counts of hashed words and trigrams with hashed signs, scaled to length 1; an empty text is a zero vector."""

    def __init__(self, dimension: int = 256):
        self.dimension = dimension

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension))
        for i, text in enumerate(texts):
            for word in (text or "").lower().split():
                padded = f" {word} "
                for part in [word, *(padded[k : k + 3] for k in range(len(padded) - 2))]:
                    h = zlib.crc32(part.encode())
                    out[i, h % self.dimension] += 1.0 if h >> 31 else -1.0
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1)


class WordProvider:
    """Counts of words (lower-cased, cut at spaces), hashed by md5: the first eight hexadecimal digits give the place, the ninth the sign.

    Not scaled, so all values are whole and a cosine doesn't depend on the order of sums. Words are hashed once a batch.
    """

    def __init__(self, dimension: int = 256):
        self.dimension = dimension

    def embed(self, texts: list[str]) -> np.ndarray:
        words = [[w for w in re.sub("[A-Z]+", lambda m: m[0].lower(), text or "").split(" ") if w] for text in texts]
        every = sorted({w for ws in words for w in ws})
        at = {w: i for i, w in enumerate(every)}
        digests = [hashlib.md5(w.encode("utf-8", "replace"), usedforsecurity=False).hexdigest() for w in every]
        place = np.array([int(h[:8], 16) % self.dimension for h in digests], np.int64)
        sign = np.array([1.0 if h[8] in "01234567" else -1.0 for h in digests])
        out = np.zeros((len(texts), self.dimension))
        for row, ws in zip(out, words, strict=True):
            if ws:
                i = np.fromiter(map(at.__getitem__, ws), np.int64, len(ws))
                row += np.bincount(place[i], sign[i], self.dimension)
        return out


PROVIDERS = {"hash": HashProvider, "words": WordProvider}


def provider(name: str, **settings) -> Provider:
    if name not in PROVIDERS:
        raise ValueError(f"unknown embedding provider {name!r}")
    return PROVIDERS[name](**settings)


def checked(p: Provider, texts: list[str]) -> np.ndarray:
    """Vectors of ``texts``; none for none, an error if the provider gives another number or dimension."""
    if not texts:
        return np.zeros((0, p.dimension))
    out = np.asarray(p.embed(texts))
    if out.shape != (len(texts), p.dimension):
        raise ValueError(f"expected {(len(texts), p.dimension)} values, got {out.shape}")
    return out


def _parts(lengths: list[int]):
    """(start, number) of runs of rows of PART_ROWS and, but for one row that is longer alone, PART_BYTES at most."""
    start = held = 0
    for i, x in enumerate(lengths):
        if i > start and (i - start >= PART_ROWS or held + x > PART_BYTES):
            yield start, i - start
            start, held = i, 0
        held += x
    if len(lengths) > start:
        yield start, len(lengths) - start


def embedded(rows: DataFrame, p: Provider, text: str = "text", column: str = "embedding") -> DataFrame:
    """rows with a vector column; texts go to the provider in batches inside the tasks, a few MB as Python objects at a time."""
    at = rows.columns
    ship(rows.sparkSession)

    n = at.index(text)

    def run(batches):
        for b in batches:
            for lo, size in _parts(pc.fill_null(pc.binary_length(b.column(n)), 0).to_pylist()):
                part = b.slice(lo, size)
                texts = part.column(n).to_pylist()
                x = np.concatenate([checked(p, texts[i : i + BATCH]) for i in range(0, size, BATCH)]).astype(np.float64)
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(size + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, vectors], names=[*at, column])

    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in at)
    return rows.mapInArrow(run, f"{fields}, `{column}` array<double>")


def search(chunks: DataFrame, query: str, p: Provider, k: int = 10, id_col: str = "id") -> DataFrame:
    """The chunks nearest to a query text, with their score. ``chunks`` has the vectors of the same provider."""
    return retrieval.cosine_topk(chunks, list(checked(p, [query])[0]), k, id_col)


def retrieval_text(path, kind, fqn, body):
    """What of a chunk is embedded: where it is, then its text."""
    return F.concat_ws("\n", F.concat_ws(" ", path, kind, fqn), body)
