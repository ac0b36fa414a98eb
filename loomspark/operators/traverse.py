"""Traversals of a call graph: edges (src, dst), breadth first, several roots at once.

A node is reached by a walk of 1 to ``depth`` edges; the root itself is reached only through a cycle. Each hop is one join
of the new nodes with the edges and one anti join with those known; hops are kept in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import durable

MAX_DEPTH = 10


def clamp(value: int, low: int, high: int) -> int:
    return max(low, min(high, value))


def reach(edges: DataFrame, roots: DataFrame, depth: int, reverse: bool = False) -> DataFrame:
    """root, node, depth (the fewest edges) of everything reached from roots (root)."""
    depth = clamp(depth, 1, MAX_DEPTH)
    a, b = ("dst", "src") if reverse else ("src", "dst")
    step = edges.select(F.col(a).alias("at"), F.col(b).alias("node")).distinct()
    front = roots.select("root").distinct().select("root", F.col("root").alias("at"))
    seen = None
    for d in range(1, depth + 1):
        new = front.join(step, "at").select("root", "node").distinct()
        if seen is not None:
            new = new.join(seen, ["root", "node"], "left_anti")
        new = new.withColumn("depth", F.lit(d))
        if d < depth:
            new = durable(new, "hop")
        seen = new if seen is None else seen.unionByName(new)
        front = new.select("root", F.col("node").alias("at"))
        if d < depth and new.isEmpty():
            break
    return seen


def impact(edges: DataFrame, roots: DataFrame, paths: DataFrame, depth: int = 3) -> DataFrame:
    """Of each root: dependents, those in other files, and risk = min(1, (dependents + cross) / 50). paths: id, path."""
    return _impact(reach(edges, roots, depth, reverse=True), roots, paths)


def _impact(found: DataFrame, roots: DataFrame, paths: DataFrame) -> DataFrame:
    own = paths.select(F.col("id").alias("root"), F.col("path").alias("root_path"))
    other = paths.select(F.col("id").alias("node"), F.col("path"))
    counted = found.join(own, "root").join(other, "node").groupBy("root").agg(F.count(F.lit(1)).alias("dependent_count"), F.count_if(F.col("path") != F.col("root_path")).alias("cross_file_count"))
    out = roots.select("root").distinct().join(counted, "root", "left")
    n, c = (F.coalesce(x, F.lit(0)).cast("long") for x in ("dependent_count", "cross_file_count"))
    return out.select("root", n.alias("dependent_count"), c.alias("cross_file_count"), F.round(F.least(F.lit(1.0), (n + c) / 50.0), 3).alias("risk_score"))


def decayed_risk(edges: DataFrame, roots: DataFrame, depth: int = 3, decay: float = 0.5) -> DataFrame:
    """Of each root: the sum over its dependents of decay to the power of their distance."""
    return reach(edges, roots, depth, reverse=True).groupBy("root").agg(F.round(F.sum(F.pow(F.lit(decay), F.col("depth"))), 6).alias("risk"))


def neighborhood(edges: DataFrame, roots: DataFrame, depth: int = 2) -> DataFrame:
    """root, node, direction (callee or caller) within ``depth`` calls."""
    callees = reach(edges, roots, depth).withColumn("direction", F.lit("callee"))
    callers = reach(edges, roots, depth, reverse=True).withColumn("direction", F.lit("caller"))
    return callees.unionByName(callers)


NODE = ["fqn", "name", "kind", "path"]


def described(reached: DataFrame, nodes: DataFrame) -> DataFrame:
    """reached (root, node, ...) with what nodes (id, fqn, name, kind, path) tell of each node."""
    return reached.join(nodes.select(F.col("id").alias("node"), *NODE), "node")


def neighborhood_of(edges: DataFrame, nodes: DataFrame, roots: DataFrame, depth: int = 2) -> DataFrame:
    """root, found, symbol (fqn, name, kind, path, signature), callees and callers (fqn, name, kind, path) of each root.

    nodes: id, fqn, name, kind, path, signature. A root that is no node isn't found; all else is null then. Lists are
    sorted and distinct.
    """
    near = described(neighborhood(edges, roots, depth), nodes)
    one = F.struct(*NODE)
    side = lambda d: F.sort_array(F.collect_set(F.when(F.col("direction") == d, one)))
    lists = near.groupBy("root").agg(side("callee").alias("callees"), side("caller").alias("callers"))
    own = nodes.select(F.col("id").alias("root"), F.struct(*NODE, "signature").alias("symbol"))
    out = roots.select("root").distinct().join(own, "root", "left").join(lists, "root", "left")
    found = F.col("symbol").isNotNull()
    empty = F.array().cast("array<struct<fqn:string,name:string,kind:string,path:string>>")
    listed = lambda c: F.when(found, F.coalesce(F.col(c), empty)).alias(c)
    return out.select("root", found.alias("found"), "symbol", listed("callees"), listed("callers"))


def impact_of(edges: DataFrame, nodes: DataFrame, roots: DataFrame, depth: int = 3, most: int = 100) -> DataFrame:
    """What ``impact`` gives for each root that is a node, with found, symbol and the first ``most`` dependents by path and fqn."""
    paths = nodes.select("id", "path")
    known = roots.select("root").distinct().join(nodes.select(F.col("id").alias("root")), "root", "left_semi")
    found = durable(reach(edges, known, depth, reverse=True), "reached")
    numbers = _impact(found, known, paths)
    near = described(found, nodes)
    w = Window.partitionBy("root").orderBy("path", "fqn", "node")
    first = near.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most)
    lists = first.groupBy("root").agg(F.array_sort(F.collect_list(F.struct("_n", F.struct(*NODE).alias("x")))).alias("l")).select("root", F.transform("l", lambda x: x["x"]).alias("dependents"))
    own = nodes.select(F.col("id").alias("root"), F.struct(*NODE).alias("symbol"))
    return roots.select("root").distinct().join(own, "root", "left").join(numbers, "root", "left").join(lists, "root", "left").withColumn("found", F.col("symbol").isNotNull())


def weighted_risk(edges: DataFrame, roots: DataFrame, churn: DataFrame, depth: int = 3, decay: float = 0.5) -> DataFrame:
    """Of each root: over its dependents, decay to the power of the distance, times the best confidence of an edge from the
    dependent, times 1 + its churn. edges: src, dst, confidence; churn: id, churn."""
    found = reach(edges, roots, depth, reverse=True)
    best = edges.groupBy(F.col("src").alias("node")).agg(F.max("confidence").alias("confidence"))
    weighed = found.join(best, "node").join(churn.withColumnRenamed("id", "node"), "node", "left")
    term = F.pow(F.lit(decay), F.col("depth")) * F.col("confidence") * (1 + F.coalesce("churn", F.lit(0)))
    return weighed.groupBy("root").agg(F.round(F.sum(term), 6).alias("risk"))


def best_paths(edges: DataFrame, roots: DataFrame, depth: int = 3, least: float = 0.0) -> DataFrame:
    """root, node, strength: of the paths of 1 to ``depth`` edges that lead from node to root, the greatest product of weights.

    edges: src, dst, weight (0 to 1); of several between two nodes the strongest counts. Relaxation by hops: a node goes on only if its
    product grew, as a weaker one after more hops leads nowhere better; products below ``least`` end there. A hop is one join of
    what grew with the edges, one aggregation, and one join with what is known.
    """
    depth = clamp(depth, 1, MAX_DEPTH)
    step = durable(edges.groupBy(F.col("dst").alias("at"), F.col("src").alias("node")).agg(F.max("weight").alias("weight")), "weights")
    front = roots.select("root").distinct().select("root", F.col("root").alias("at"), F.lit(1.0).alias("strength"))
    best = None
    for d in range(depth):
        grown = front.join(step, "at").select("root", "node", (F.col("strength") * F.col("weight")).alias("strength")).where(F.col("strength") >= least)
        grown = grown.groupBy("root", "node").agg(F.max("strength").alias("strength"))
        if best is not None:
            known = best.select("root", "node", F.col("strength").alias("_known"))
            grown = grown.join(known, ["root", "node"], "left").where(F.col("_known").isNull() | (F.col("strength") > F.col("_known"))).drop("_known")
        if d < depth - 1:
            grown = durable(grown, "hop")
        best = grown if best is None else best.unionByName(grown).groupBy("root", "node").agg(F.max("strength").alias("strength"))
        if d < depth - 1:
            if grown.isEmpty():
                break
            best = durable(best, "best")
        front = grown.select("root", F.col("node").alias("at"), "strength")
    return best


def path_risk(edges: DataFrame, roots: DataFrame, churn: DataFrame, weights: dict[str, float], depth: int = 3, decay: float = 0.5, least: float = 0.0) -> DataFrame:
    """Of each root: dependents, risk (the sum over them of the best path's strength times 1 + churn) and the strongest one's strength.

    An edge (src, dst, type, confidence) weighs decay * confidence * its type's weight; other types don't count. churn: id, churn.
    """
    typed = F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col("type"))
    weighed = edges.where(F.col("type").isin(list(weights))).select("src", "dst", (F.lit(decay) * F.col("confidence") * typed).alias("weight"))
    found = best_paths(weighed, roots, depth, least).join(churn.withColumnRenamed("id", "node"), "node", "left")
    term = F.col("strength") * (1 + F.coalesce("churn", F.lit(0)))
    return found.groupBy("root").agg(F.count(F.lit(1)).alias("dependents"), F.round(F.sum(term), 6).alias("risk"), F.round(F.max("strength"), 9).alias("strongest"))


def recently_changed(dependents: DataFrame, nodes: DataFrame, changed: DataFrame) -> DataFrame:
    """Dependents (root, node) in files of ``changed`` (path), by root and path."""
    return described(dependents, nodes).join(changed, "path", "left_semi").groupBy("root", "path").agg(F.count_distinct("node").alias("dependents"))
