"""A vector store behind the retrieval port: upsert by chunk id, filtered search, delete by path, purge and exact count."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.stores import KeyedTable
from . import retrieval

SCHEMA = "repo_id string, id string, path string, language string, fqn string, kind string, start_line int, end_line int, text string, embedding array<double>"


class VectorStore:
    """Chunks with their vectors, by repository. Opening it twice changes nothing."""

    def __init__(self, spark: SparkSession, root: str, schema: str = SCHEMA):
        self.table = KeyedTable(spark, root, schema, ["repo_id", "id"], "repo_id")

    def upsert(self, chunks: DataFrame, vectors: DataFrame) -> None:
        """chunks (with id) and vectors (id, embedding) must be as many and match one to one; anything else is an error."""
        own, given = chunks.count(), vectors.count()
        both = chunks.join(vectors, "id")
        if own != given or both.count() != own:
            raise ValueError(f"{own} chunks and {given} vectors don't match one to one")
        self.table.upsert(both)

    def delete_paths(self, repo_id, paths: list[str]) -> None:
        if paths:
            spark = self.table.spark
            kind = self.table.schema["repo_id"].dataType.simpleString()
            self.table.delete(spark.createDataFrame([(repo_id, p) for p in paths], f"repo_id {kind}, path string"))

    def purge_repo(self, repo_id) -> None:
        self.table.purge(repo_id)

    def count(self, repo_id) -> int:
        return self.table.count(repo_id)

    def search(self, repo_id, vector: list[float], limit: int = 10, paths: list[str] | None = None) -> DataFrame:
        """The chunks of a repository, perhaps of some paths only, nearest to ``vector``."""
        return filtered_topk(self.table.rows([repo_id]), vector, F.col("path").isin(paths) if paths is not None else None, limit)


def filtered_topk(vectors: DataFrame, vector: list[float], where=None, limit: int = 10, id_col: str = "id") -> DataFrame:
    """Top-k by cosine among the rows that a payload filter keeps; the filter comes before the scores."""
    return retrieval.cosine_topk(vectors if where is None else vectors.where(where), vector, limit, id_col)
