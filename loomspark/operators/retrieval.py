"""Vector, lexical and fused retrieval, and its evaluation."""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import jaccard, trigrams
from ..sources.tables import ship

K1, B, RRF = 1.2, 0.75, 60


def cosine(vector: Column, query: list[float]) -> Column:
    """Cosine similarity to a literal query vector, in doubles, rounded to five places; 0 for a zero vector."""
    q = F.array(*[F.lit(float(x)) for x in query])
    norm = math.sqrt(sum(float(x) ** 2 for x in query))
    plus = lambda a, x: a + x
    dot = F.aggregate(F.zip_with(vector, q, lambda a, b: a.cast("double") * b), F.lit(0.0), plus)
    own = F.sqrt(F.aggregate(F.transform(vector, lambda a: a.cast("double") * a.cast("double")), F.lit(0.0), plus))
    return F.round(F.when((own > 0) & F.lit(norm > 0), dot / (own * norm)).otherwise(0.0), 5)


def cosine_topk(vectors: DataFrame, query: list[float], k: int = 10, id_col: str = "id", vector: str = "embedding") -> DataFrame:
    """The ``k`` (1 to 50) rows nearest to ``query``: a top-k, no sort of all rows."""
    return vectors.withColumn("score", cosine(F.col(vector), query)).orderBy(F.desc("score"), id_col).limit(max(1, min(50, k)))


def enriched(hits: DataFrame, edges: DataFrame, top: int = 3, id_col: str = "id") -> DataFrame:
    """hits (50 at most) with rank (from 0), and for the first ``top`` n_callers and n_callees over edges (src, dst), else null.

    The few first hits are joined to the edges before anything is counted.
    """
    ranked = hits.withColumn("rank", (F.row_number().over(Window.orderBy(F.desc("score"), id_col)) - 1).cast("int"))  # at most 50 rows
    first = F.broadcast(ranked.where(F.col("rank") < top).select(F.col(id_col).alias("n_id")))
    touched = edges.select(F.col("dst").alias("n_id"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionByName(edges.select(F.col("src").alias("n_id"), F.lit(0).alias("i"), F.lit(1).alias("o")))
    counts = touched.join(first, "n_id").groupBy("n_id").agg(F.sum("i").alias("n_callers"), F.sum("o").alias("n_callees"))
    out = ranked.join(counts, ranked[id_col] == counts["n_id"], "left").drop("n_id")
    shown = lambda c: F.when(F.col("rank") < top, F.coalesce(F.col(c), F.lit(0))).alias(c)
    return out.select(*hits.columns, "rank", shown("n_callers"), shown("n_callees"))


def with_neighbours(hits: DataFrame, edges: DataFrame, top: int = 3, id_col: str = "id") -> DataFrame:
    """hits (50 at most) with rank (from 0), and for the first ``top`` the sorted callers and callees over edges (src, dst), else null.

    The first hits are broadcast to the edges, so only their own edges are shuffled.
    """
    ranked = hits.withColumn("rank", (F.row_number().over(Window.orderBy(F.desc("score"), id_col)) - 1).cast("int"))  # at most 50 rows
    first = F.broadcast(ranked.where(F.col("rank") < top).select(F.col(id_col).alias("n_id")))
    ends = edges.select(F.col("dst").alias("n_id"), F.col("src").alias("caller"), F.lit(None).cast(edges.schema["dst"].dataType).alias("callee"))
    ends = ends.unionByName(edges.select(F.col("src").alias("n_id"), F.lit(None).cast(edges.schema["src"].dataType).alias("caller"), F.col("dst").alias("callee")))
    lists = ends.join(first, "n_id").groupBy("n_id").agg(*[F.sort_array(F.collect_set(c)).alias(f"{c}s") for c in ("caller", "callee")])
    out = ranked.join(lists, ranked[id_col] == lists["n_id"], "left").drop("n_id")
    shown = lambda c: F.when(F.col("rank") < top, F.coalesce(F.col(c), F.array().cast(lists.schema[c].dataType))).alias(c)
    return out.select(*hits.columns, "rank", shown("callers"), shown("callees"))


def fuzzy(names: DataFrame, query: str, column: str = "name", least: float = 0.3) -> DataFrame:
    """Distinct names by trigram similarity (rounded to five places) to ``query``."""
    score = F.round(jaccard(trigrams(F.col(column)), trigrams(F.lit(query))), 5)
    return names.select(column).distinct().withColumn("score", score).where(F.col("score") >= least)


def edit_distance(names: DataFrame, query: str, column: str = "name") -> DataFrame:
    return names.select(column).distinct().withColumn("distance", F.levenshtein(F.col(column), F.lit(query)))


def ranked(hits: DataFrame, id_col: str, k: int) -> DataFrame:
    """id, rank (from 1) of the ``k`` best hits."""
    top = hits.orderBy(F.desc("score"), id_col).limit(k)
    return top.select(F.col(id_col).alias("id"), F.row_number().over(Window.orderBy(F.desc("score"), id_col)).alias("rank"))  # k rows


def fuse(lists: list[tuple[DataFrame, float]], k: int = RRF) -> DataFrame:
    """Weighted reciprocal rank fusion of ranked lists (id, rank)."""
    parts = [df.select("id", (F.lit(w) / (F.lit(k) + F.col("rank"))).alias("s")) for df, w in lists]
    return reduce(DataFrame.unionByName, parts).groupBy("id").agg(F.round(F.sum("s"), 8).alias("score"))


def expand(seeds: DataFrame, edges: DataFrame, fraction: float = 0.5, siblings: DataFrame | None = None) -> DataFrame:
    """seeds (id, score), their callers and callees, and with ``siblings`` (id, parent) those of the same parent; what is
    reached inherits a fraction of the best seed's score."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    near = seeds.join(both, seeds["id"] == both["src"]).select(F.col("dst").alias("id"), (F.col("score") * fraction).alias("score"))
    if siblings is not None:
        parents = seeds.join(siblings, "id").groupBy("parent").agg(F.max("score").alias("score"))  # one row a parent, however many seeds it has
        near = near.unionByName(siblings.join(parents, "parent").select("id", (F.col("score") * fraction).alias("score")))
    return seeds.select("id", "score").unionByName(near).groupBy("id").agg(F.round(F.max("score"), 6).alias("score"))


def without_overlaps(hits: DataFrame, group: str, first: str, last: str, rank: str) -> DataFrame:
    """Hits of whose span no better hit of the same group covers all: a symbol's chunk stands for the windows within it.

    Hits are dealt by group and sorted by rank. One pass keeps the spans seen that no other covers, starts and ends both rising, so
    a look-up by start tells whether a better one covers a hit. Equal ranks don't cover each other, and nulls cover nothing.
    """
    names = hits.columns
    at = [names.index(c) for c in (group, first, last, rank)]
    ship(hits.sparkSession)

    def run(batches):
        here, starts, ends, waiting, level = None, [], [], [], None
        for b in batches:
            keep = []
            for g, f, e, r in zip(*(b.column(i).to_pylist() for i in at), strict=True):
                if None in (g, f, e, r):
                    keep.append(True)
                    continue
                if g != here:
                    here, starts, ends, waiting, level = g, [], [], [], r
                if r != level:  # all of the rank before have been looked up
                    for span in waiting:
                        _cover(starts, ends, *span)
                    waiting, level = [], r
                i = bisect_right(starts, f) - 1
                keep.append(i < 0 or ends[i] < e)
                if keep[-1]:
                    waiting.append((f, e))
            yield b.filter(pa.array(keep, pa.bool_()))

    return hits.repartition(group).sortWithinPartitions(group, rank).mapInArrow(run, hits.schema)


def _cover(starts: list, ends: list, first, last) -> None:
    """Puts a span among those that no other covers; both lists rise."""
    i = bisect_right(starts, first) - 1
    if i >= 0 and ends[i] >= last:
        return
    lo = bisect_left(starts, first)
    hi = bisect_right(ends, last, lo)
    starts[lo:hi], ends[lo:hi] = [first], [last]


def within_budget(rows: DataFrame, group: str, order: str, cost: str, budget: int) -> DataFrame:
    """Rows of each group, in order, while the running sum of ``cost`` stays within ``budget``."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("used", F.sum(cost).over(w)).where(F.col("used") <= budget)


def recall_at(ranked_hits: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """query, recall at ``k`` and reciprocal rank. ranked_hits: query, id, rank; relevant: query, id."""
    total = relevant.groupBy("query").agg(F.count(F.lit(1)).alias("total"))
    found = ranked_hits.join(relevant, ["query", "id"]).groupBy("query").agg(F.count_if(F.col("rank") <= k).alias("found"), F.min("rank").alias("first"))
    out = total.join(found, "query", "left")
    return out.select("query", F.round(F.coalesce("found", F.lit(0)) / F.col("total"), 6).alias("recall"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("reciprocal_rank"))
