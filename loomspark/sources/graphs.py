"""A sink for code graphs: files, symbols, edges and imports as keyed tables by repository, and the facts they follow from."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .stores import KeyedTable

#: Label: columns, key.
LABELS = {
    "File": ("repo_id string, path string, language string, content_hash string", ["repo_id", "path"]),
    "Symbol": ("repo_id string, path string, fqn string, name string, kind string", ["repo_id", "path", "fqn"]),
    "Edge": ("repo_id string, type string, src_path string, src_fqn string, dst_path string, dst_fqn string, dst_name string, confidence double, via string", ["repo_id", "type", "src_path", "src_fqn", "dst_path", "dst_fqn", "dst_name"]),
    "Import": ("repo_id string, path string, module string", ["repo_id", "path", "module"]),
}


#: Edges that lead to a symbol or a type's name; of the others, CALLS_UNRESOLVED lead to a name, DEFINES from a file to its symbols.
RESOLVED = ["CALLS", "INHERITS", "IMPLEMENTS"]


class GraphStore:
    """Writing the same rows twice changes nothing. Each label's table is written at once, one after the other."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.tables = {n: KeyedTable(spark, f"{root}/{n.lower()}", schema, keys, "repo_id") for n, (schema, keys) in LABELS.items()}

    def write(self, files: DataFrame, symbols: DataFrame, edges: DataFrame, imports: DataFrame) -> None:
        for name, rows in zip(LABELS, (files, symbols, edges, imports), strict=True):
            self.tables[name].upsert(self._whole(name, rows))

    def _whole(self, name: str, rows: DataFrame) -> DataFrame:
        """rows with all of the label's columns; parts of an edge's key are never null."""
        schema = self.tables[name].schema
        rows = rows.select(*[F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema])
        return rows.na.fill("", ["dst_path", "dst_fqn", "dst_name"]) if name == "Edge" else rows

    def rewrite(self, repos: list, edges, imports, symbols, files) -> None:
        """Replaces these repositories' rows, each label's by what its function makes of them.

        Readers see a table before or after, never emptied. Edges come first and files last: a run that fails between finds the files'
        old hashes and symbols when it is repeated, and so comes to the same edges.
        """
        for name, change in (("Edge", edges), ("Import", imports), ("Symbol", symbols), ("File", files)):
            self.tables[name].rewrite(repos, lambda old, name=name, change=change: self._whole(name, change(old)))

    def edges(self, repos: list) -> DataFrame:
        """Edges by their sites, nulls as they were."""
        rows = self.tables["Edge"].rows(repos)
        return rows.withColumns({c: F.when(F.col(c) != "", F.col(c)) for c in ("dst_path", "dst_fqn", "dst_name")})

    def stats(self, repos: list) -> dict:
        """files, symbols, calls, unresolved_calls of repositories, as they are stored."""
        by_type = {r[0]: r[1] for r in self.tables["Edge"].rows(repos).groupBy("type").agg(F.count(F.lit(1))).collect()}  # some types
        files, symbols = (self.tables[n].rows(repos).count() for n in ("File", "Symbol"))
        return {"files": files, "symbols": symbols, "calls": by_type.get("CALLS", 0), "unresolved_calls": by_type.get("CALLS_UNRESOLVED", 0)}

    def delete_files(self, gone: DataFrame) -> None:
        """Files (repo_id, path), their symbols and imports, and edges from and to these."""
        for name in ("File", "Symbol", "Import"):
            self.tables[name].delete(gone.select("repo_id", "path"))
        for side in ("src_path", "dst_path"):
            self.tables["Edge"].delete(gone.select("repo_id", F.col("path").alias(side)))

    def purge(self, repo_id: str) -> None:
        for t in self.tables.values():
            t.purge(repo_id)

    def counts(self) -> DataFrame:
        """repo_id, label, n; of edges, those that lead to a symbol or a type's name."""
        rows = {name: t.rows() for name, t in self.tables.items()}
        rows["Edge"] = rows["Edge"].where(F.col("type").isin(RESOLVED))
        parts = [t.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n")).select("repo_id", F.lit(name).alias("label"), "n") for name, t in rows.items()]
        return reduce(DataFrame.unionByName, parts)
