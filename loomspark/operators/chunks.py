"""Symbol-aware chunks: line windows, headers, preambles. All are expressions and one aggregation by parent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import MODULE_NAME, split_lines, uuid5

WINDOW, OVERLAP, PREAMBLE, MOST_CHARS = 120, 20, 80, 8000
LEAF = ["function", "method", "type"]
CONTAINER = ["class", "interface", "enum"]


def windows(start: Column, end: Column, window: int = WINDOW, overlap: int = OVERLAP) -> Column:
    """Array of (k, first, last): windows of ``window`` lines that overlap by ``overlap``."""
    step = window - overlap
    n = end - start + 1
    last = F.when(n <= window, F.lit(0)).otherwise(F.ceil((n - window) / F.lit(step))).cast("int")
    one = lambda k: F.struct(k.alias("k"), (start + k * step).cast("int").alias("first"), F.least(start + k * step + (window - 1), end).cast("int").alias("last"))
    return F.when(n >= 1, F.transform(F.sequence(F.lit(0), last), one)).otherwise(F.array().cast("array<struct<k:int,first:int,last:int>>"))


def header(path: Column, first: Column, last: Column, kind: Column, fqn: Column) -> Column:
    return F.rtrim(F.concat(path, F.lit(":"), first, F.lit("-"), last, F.lit(" "), kind, F.lit(" "), F.coalesce(fqn, F.lit(""))))


def spans(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """repo_id, path, fqn, kind, first, last of every chunk before windowing. files: repo_id, path, n_lines."""
    key = ["repo_id", "path"]
    starts = symbols.groupBy(*key).agg(F.min("start_line").alias("_s"))
    lines = files.where("n_lines > 0").select(*key, "n_lines")
    top = lines.join(starts, key, "left").withColumn("last", F.least(F.coalesce(F.col("_s"), F.col("n_lines") + 1) - 1, F.lit(PREAMBLE), F.col("n_lines")))
    preamble = top.where("last >= 1").select(*key, F.lit(None).cast("string").alias("fqn"), F.lit("module").alias("kind"), F.lit(1).alias("first"), "last")
    leaves = symbols.where(F.col("kind").isin(LEAF)).select(*key, "fqn", "kind", F.col("start_line").alias("first"), F.col("end_line").alias("last"))
    inner = symbols.where(F.col("kind").isin(LEAF + CONTAINER) & F.col("parent_fqn").isNotNull()).groupBy(*key, F.col("parent_fqn").alias("fqn")).agg(F.min("start_line").alias("_c"))
    heads = symbols.where(F.col("kind").isin(CONTAINER)).join(inner, [*key, "fqn"], "left").select(*key, "fqn", "kind", F.col("start_line").alias("first"), F.least(F.coalesce(F.col("_c") - 1, F.col("end_line")), F.col("end_line")).alias("last"))
    every = preamble.unionByName(leaves).unionByName(heads.where("last >= first"))
    every = every.join(lines, key).withColumn("first", F.greatest(F.lit(1), F.col("first"))).withColumn("last", F.least("last", "n_lines"))
    return every.where("last >= first").drop("n_lines")


def chunks(files: DataFrame, symbols: DataFrame, window: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """id, repo_id, path, language, fqn, kind, start_line, end_line, text. files: repo_id, path, language, text."""
    lined = files.withColumn("_lines", split_lines(F.col("text"))).withColumn("n_lines", F.when(F.coalesce(F.length("text"), F.lit(0)) == 0, F.lit(0)).otherwise(F.size("_lines")))
    spanned = spans(lined.select("repo_id", "path", "n_lines"), symbols)
    # a file's spans come to its lines together, so its text moves once, and only chunks' texts leave the row
    by_file = spanned.groupBy("repo_id", "path").agg(F.collect_list(F.struct("fqn", "kind", "first", "last")).alias("_spans"))
    cut = lambda w: F.substring(F.array_join(F.slice(F.col("_lines"), w["first"], w["last"] - w["first"] + 1), "\n"), 1, MOST_CHARS)
    one = lambda s, w: F.struct(s["fqn"].alias("fqn"), s["kind"].alias("kind"), w["k"].alias("k"), w["first"].alias("first"), w["last"].alias("last"), cut(w).alias("body"))
    parts = F.flatten(F.transform("_spans", lambda s: F.transform(windows(s["first"], s["last"], window, overlap), lambda w: one(s, w))))
    rows = lined.join(by_file, ["repo_id", "path"]).select("repo_id", "path", "language", F.explode(parts).alias("c")).select("repo_id", "path", "language", "c.*")
    name = F.concat(F.col("repo_id"), F.lit(":"), F.col("path"), F.lit(":"), F.coalesce("fqn", F.lit(MODULE_NAME)), F.lit(":"), F.col("k").cast("string"))
    text = F.concat(header(F.col("path"), F.col("first").cast("string"), F.col("last").cast("string"), F.col("kind"), F.col("fqn")), F.lit("\n"), F.col("body"))
    return rows.select(uuid5(name).alias("id"), "repo_id", "path", "language", "fqn", "kind", F.col("first").alias("start_line"), F.col("last").alias("end_line"), text.alias("text"))
