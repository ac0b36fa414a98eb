"""Indexing: files to facts, facts to graph and chunks, in full and incrementally.

Facts (symbols and references) of a content are scanned once and written; all else reads what was written. ``full`` and
``incremental`` derive edges from all facts, so they give the same; ``operators.delta`` gets there from what changed.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph
from ..operators.incremental import diff
from ..sources.tables import durable, ship
from .scanners import scan

SYMBOL = "struct<fqn:string,name:string,kind:string,signature:string,docstring:string,parent_fqn:string,start_line:int,end_line:int,start_byte:int,end_byte:int>"
FACTS = (
    f"repo_id string, path string, language string, content_hash string, symbols array<{SYMBOL}>, "
    "calls array<struct<caller_fqn:string,callee_name:string,start_line:int,end_line:int>>, "
    "imports array<struct<module:string,symbols:array<string>,alias:string>>, "
    "inherits array<struct<subclass_fqn:string,base_name:string,kind:string>>, parse_errors int"
)


def facts(files: DataFrame) -> DataFrame:
    """One row of nested facts for each file (repo_id, path, language, content, content_hash) of a supported language."""

    ship(files.sparkSession)

    def run(frames):
        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                found = scan(r.language, bytes(r.content))
                if found is not None:
                    out.append([r.repo_id, r.path, r.language, r.content_hash, found.symbols, found.calls, found.imports, found.inherits, found.errors])
            yield pd.DataFrame(out, columns=["repo_id", "path", "language", "content_hash", "symbols", "calls", "imports", "inherits", "parse_errors"])

    return files.select("repo_id", "path", "language", "content", "content_hash").mapInPandas(run, FACTS)


@dataclass
class Index:
    """The stored state: facts of every file."""

    facts: DataFrame

    def exploded(self, column: str) -> DataFrame:
        return self.facts.select("repo_id", "path", F.explode(column).alias("x")).select("repo_id", "path", "x.*")

    @property
    def files(self) -> DataFrame:
        return self.facts.select("repo_id", "path", "language", "content_hash")

    @property
    def symbols(self) -> DataFrame:
        """Declared symbols; of a name declared twice in a file, the last."""
        rows = self.exploded("symbols")
        last = rows.groupBy("repo_id", "path", "fqn").agg(F.max_by(F.struct(*[c for c in rows.columns if c not in ("repo_id", "path", "fqn")]), F.col("start_byte")).alias("s"))
        return last.select("repo_id", "path", "fqn", "s.*")

    @property
    def nodes(self) -> DataFrame:
        return graph.all_symbols(self.files, self.symbols)

    @property
    def calls(self) -> DataFrame:
        return graph.resolve_calls(self.exploded("calls"), self.nodes)

    @property
    def unresolved(self) -> DataFrame:
        return graph.unresolved_calls(self.exploded("calls"), self.nodes)

    @property
    def inheritance(self) -> DataFrame:
        return graph.resolve_inheritance(self.exploded("inherits"), self.nodes)

    @property
    def imports(self) -> DataFrame:
        return graph.import_edges(self.exploded("imports"), self.files)

    def stats(self) -> DataFrame:
        return graph.repo_stats(self.files, self.nodes, graph.call_totals(self.exploded("calls"), self.nodes))

    def call_edges(self) -> DataFrame:
        """src, dst as node ids, for traversals."""
        key = lambda p, f: F.concat_ws("\x1f", "repo_id", p, f)
        return self.calls.select(key("src_path", "src_fqn").alias("src"), key("dst_path", "dst_fqn").alias("dst"))


def full(files: DataFrame) -> Index:
    return Index(durable(facts(files), "facts"))


def incremental(before: Index, files: DataFrame) -> tuple[Index, DataFrame]:
    """The index of ``files`` with only new and changed files scanned, and the changes (path, change)."""
    key = ["repo_id", "path"]
    a = files.select(F.struct(*key).alias("key"), "content_hash")
    b = before.files.select(F.struct(*key).alias("key"), "content_hash")
    changes = durable(diff(a, b, "key"), "changes")
    fresh = changes.where(F.col("change").isin("added", "changed")).select("key.*")
    same = changes.where("change = 'unchanged'").select("key.*")
    after = before.facts.join(same, key, "left_semi").unionByName(durable(facts(files.join(fresh, key, "left_semi")), "facts"))
    return Index(after), changes.where("change <> 'unchanged'").select("key.repo_id", "key.path", "change")
