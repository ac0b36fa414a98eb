"""Vectors kept by content: a text is embedded once by a model, wherever and however often it stands, and never again.

A store is one bucketed table of digest and vector for each model, in a folder that all executors share; a session that opens
the folder finds what others wrote. Rows hold no vectors: their text's digest names one. So copies cost nothing, a
look-up shuffles digests and never stored vectors, and no key is as hot as its copies are many: rows are reduced to
contents within the tasks first, and only the contents of hits are joined with rows again.

Defined results: null is the empty text; rows may repeat, have null ids and any other columns; no rows give no hits. Equal
scores are ordered by the smallest id, null ids last. If two runs add a content at the same time, both write it and
one is read. A run that fails adds what it committed or nothing; the next one embeds the rest.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embedding, retrieval

#: Files that a full store has for each run that adds to it; part of the folder's name, as the files' places depend on it.
BUCKETS = 64


def digest_of(text: str) -> Column:
    return F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")), 256)


def contents(rows: DataFrame, text: str = "text") -> DataFrame:
    """digest, text: each distinct content once."""
    return rows.select(digest_of(text).alias("digest"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).groupBy("digest").agg(F.first("text").alias("text"))


class EmbeddingStore:
    """The vectors of ``model``, which ``provider`` gives, below ``root``. Another model, dimension or bucket count is another table."""

    def __init__(self, spark: SparkSession, root: str, model: str, provider: embedding.Provider, buckets: int = BUCKETS):
        self.spark, self.provider, self.buckets = spark, provider, buckets
        part = hashlib.sha256(f"{model}\x1f{provider.dimension}\x1f{buckets}".encode()).hexdigest()[:16]
        self.at = f"{root.rstrip('/')}/{part}"
        self.name = f"loom_vectors_{hashlib.sha256(self.at.encode()).hexdigest()[:16]}"
        place = self.at.replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} (digest STRING, embedding ARRAY<DOUBLE>) USING parquet CLUSTERED BY (digest) INTO {buckets} BUCKETS LOCATION '{place}'")

    def vectors(self) -> DataFrame:
        """digest, embedding. Buckets hold whole digests, so making them distinct shuffles nothing."""
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name).dropDuplicates(["digest"])

    def missing(self, rows: DataFrame, text: str = "text") -> DataFrame:
        """digest, text of the contents that have no vector yet."""
        return contents(rows, text).join(self.vectors().select("digest"), "digest", "left_anti")

    def add(self, rows: DataFrame, text: str = "text") -> int:
        """Embeds the contents of ``rows`` that have no vector and returns how many vectors the store has more."""
        before = self._written()
        done = embedding.embedded(self.missing(rows, text), self.provider).select("digest", "embedding")
        # vectors of new contents alone move, so that a bucket gets one file
        done.repartition(self.buckets, "digest").write.insertInto(self.name)
        return self._written() - before

    def _written(self) -> int:
        """Rows in the files, by their footers."""
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name).count()

    def attached(self, rows: DataFrame, text: str = "text") -> DataFrame:
        """digest, embedding of the contents of ``rows`` that have a vector."""
        return self.vectors().join(rows.select(digest_of(text).alias("digest")).distinct(), "digest", "left_semi")

    def search(self, rows: DataFrame, question: str, k: int = 10, id_col: str = "id", text: str = "text") -> DataFrame:
        """id, score of the ``k`` (1 to 50) rows nearest to a question, by score and id; rows without a vector aren't found.

        Contents are scored, not rows. Every hit's content is among the ``k`` first by score and smallest id, so only these few
        are broadcast to the rows.
        """
        k = max(1, min(50, k))
        asked = list(embedding.checked(self.provider, [question])[0])
        named = rows.select(F.col(f"`{id_col}`").alias("_id"), digest_of(text).alias("digest"))
        first = named.groupBy("digest").agg(F.min("_id").alias("_first"))
        scored = self.vectors().join(first, "digest").select("digest", "_first", retrieval.cosine(F.col("embedding"), asked).alias("score"))
        best = scored.orderBy(F.desc("score"), F.asc_nulls_last("_first"), "digest").limit(k)
        hits = named.join(F.broadcast(best.select("digest", "score")), "digest")
        return hits.select(F.col("_id").alias(id_col), "score").orderBy(F.desc("score"), F.asc_nulls_last(id_col)).limit(k)
