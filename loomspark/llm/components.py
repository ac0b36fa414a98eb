"""Connected components of a table of edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _stars(edges: DataFrame) -> DataFrame:
    """One large star, then one small star, over edges (a, b); both keep what is connected."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b")).distinct()
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(least, "a")
    return small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct()


#: Edges in a file.
PER = 500_000


def components(edges: DataFrame, rows: int, most: int = 60) -> DataFrame:
    """node, comp (its component's smallest node) of all nodes of edges (a, b), about ``rows`` at most; edges to itself are ignored.

    Each round is written to the shared folder, and only its row count and a hash sum reach the driver.
    """
    now = common.saved(common.spread(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), rows, PER), "edges")
    seen, n = None, now.count()
    for _ in range(most):
        if not n:
            break
        now = common.saved(common.spread(_stars(now), 2 * n, PER), "edges")
        r = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
        if (r["n"], r["h"]) == seen:
            break
        n = r["n"]
        seen = (r["n"], r["h"])
    else:
        raise RuntimeError(f"no fixed point after {most} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("comp"))).distinct()
