"""Approximate nearest neighbours: an inverted file of cells with product-quantised residuals and exact re-ranking.

Unit vectors are dealt to the nearest of ``cells`` centroids; what is left of a vector is told by one code for each of its
``pieces``. Cells are partitions of two stored tables: ``codes`` (id, payload, code), narrow, and ``vectors`` (id, embedding).
A search picks the ``probes`` nearest cells of each query, so only these partitions are read; the payload filter comes before any
score; codes are scored by table look-ups; and of the ``refine`` best of each query the vectors are read and scored exactly.
Tasks keep the best of all their cells and pass on these only. Where ``refine`` covers all vectors, codes would choose nothing, so
the vectors of the probed cells are scored at once and a task passes on ``k`` of a batch for each query.

Centroids and codebooks are fitted on at most ``SAMPLE`` vectors, chosen by a hash of the id; every vector is indexed.
Cells that hold many vectors are written by as many tasks as they need. Vectors that are null aren't indexed; zero vectors
score 0. A stored index is never changed; a new one is built beside it.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import ship

#: Vectors that the centroids and codebooks are fitted on, at most (about).
SAMPLE = 65_536
MOST_CELLS = 4096
CODES = 256
#: Vectors of a written file.
PER_FILE = 500_000
#: Queries that are broadcast at once; more go in several rounds.
MOST_QUERIES = 4096
#: Candidates that a task holds before it drops those that aren't among the best.
HELD = 1_000_000


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def _nearest(x: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Index of the nearest row of ``to`` for each row of x."""
    half = (to * to).sum(1) / 2
    out = np.empty(len(x), np.int64)
    for i in range(0, len(x), 4096):
        out[i : i + 4096] = (half - x[i : i + 4096] @ to.T).argmin(1)
    return out


def lloyd(x: np.ndarray, k: int, rounds: int = 12, seed: int = 1) -> np.ndarray:
    """Centroids of k-means; a centroid without members stays."""
    rng = np.random.default_rng(seed)
    at = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = _nearest(x, at)
        count = np.bincount(near, minlength=len(at))
        for d in range(x.shape[1]):
            total = np.bincount(near, x[:, d], len(at))
            at[:, d] = np.where(count > 0, total / np.maximum(count, 1), at[:, d])
    return at


#: A ``refine`` of all vectors.
ALL = 1 << 62


def _best(held: list[tuple], most: int) -> tuple:
    """Of parts (query number, id, cell, distance) the ``most`` least distances of each query."""
    n, cell, far = (np.concatenate([h[i] for h in held]) for i in (0, 2, 3))
    ids = pa.concat_arrays([h[1] for h in held])
    order = np.lexsort((far, n))
    own = n[order]
    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    nth = np.arange(len(own)) - np.repeat(first, np.diff(np.r_[first, len(own)]))
    order = order[nth < most]
    return n[order], ids.take(pa.array(order)), cell[order], far[order]


def _firsts(ids: pa.Array, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of scores (queries by ids) the places of each query's ``k`` best, ties by id, and their scores."""
    order = np.argsort(ids.to_numpy(zero_copy_only=False), kind="stable")
    few = order[np.argsort(-score[:, order], axis=1, kind="stable")[:, :k]]
    return few, np.take_along_axis(score, few, 1)


class AnnIndex:
    """The index below ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = ship(spark), root.rstrip("/")

    @classmethod
    def build(cls, vectors: DataFrame, root: str, cells: int | None = None, pieces: int = 8, id_col: str = "id", vector: str = "embedding") -> AnnIndex:
        """Indexes ``vectors``; columns besides id and vector are its payload. ``cells``: the root of the number of vectors unless given."""
        ix = cls(vectors.sparkSession, root)
        payload = [c for c in vectors.columns if c not in (id_col, vector)]
        rows = vectors.where(F.col(vector).isNotNull()).select(F.col(id_col).alias("id"), *payload, F.col(vector).cast("array<double>").alias("embedding"))
        n = rows.count()
        if not n:
            raise ValueError("there are no vectors to index")
        dim = rows.select(F.max(F.size("embedding")).alias("a"), F.min(F.size("embedding")).alias("b")).first()
        if dim["a"] != dim["b"] or dim["a"] % pieces:
            raise ValueError(f"vectors of {dim['b']} to {dim['a']} numbers can't be cut into {pieces} pieces")
        dim = dim["a"]
        cells = max(1, min(MOST_CELLS, n, cells or math.isqrt(n)))
        share = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(min(1.0, SAMPLE / n) * (1 << 30))

        def scaled(batches):  # in numpy: a column's transform would work the norm out again for each number
            for b in batches:
                x = _unit(_matrix(b.column(0), dim))
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * dim, pa.int32()), pa.array(x.ravel()))], names=["u"])

        some = rows.where(share | F.lit(n <= SAMPLE)).select("embedding").mapInArrow(scaled, "u array<double>")
        model = KMeans(k=cells, seed=1, maxIter=10, featuresCol="v").fit(some.select(array_to_vector("u").alias("v")))
        centroids = np.array(model.clusterCenters())
        width, shared = dim // pieces, ix.spark.sparkContext.broadcast(centroids)

        def residuals(batches):
            for b in batches:
                x = _matrix(b.column(0), dim)
                x = x - shared.value[_nearest(x, shared.value)]
                for p in range(pieces):
                    part = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * width, pa.int32()), pa.array(x[:, p * width : (p + 1) * width].ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), p, np.int32)), part], names=["piece", "r"])

        def fitted(key, frame):
            book = lloyd(np.stack(frame["r"].to_numpy()), min(CODES, len(frame)))
            return pd.DataFrame({"kind": "code", "a": int(key[0]), "b": range(len(book)), "x": list(book)})

        parts = some.select("u").mapInArrow(residuals, "piece int, r array<double>")  # at most SAMPLE rows for each piece
        books = parts.groupBy("piece").applyInPandas(fitted, "kind string, a int, b int, x array<double>")
        own = ix.spark.createDataFrame([("cell", i, 0, c.tolist()) for i, c in enumerate(centroids)], "kind string, a int, b int, x array<double>")
        own.unionByName(books).coalesce(1).write.parquet(f"{root}/model")
        _, codebooks = ix.model()
        both = ix.spark.sparkContext.broadcast((centroids, codebooks))
        schema = rows.select("id", *payload, "embedding").withColumns({"cell": F.lit(0), "code": F.lit(b"")}).schema

        def coded(batches):
            centroids, codebooks = both.value
            for b in batches:
                x = _unit(_matrix(b.column(len(payload) + 1), dim))
                cell = _nearest(x, centroids)
                x = x - centroids[cell]
                code = np.stack([_nearest(x[:, p * width : (p + 1) * width], codebooks[p]) for p in range(pieces)], 1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32()), pa.array([c.tobytes() for c in code], pa.binary())], names=[*b.schema.names, "cell", "code"])

        # a cell of many vectors is dealt to several tasks; there are at most MOST_CELLS sizes
        done = rows.select("id", *payload, "embedding").mapInArrow(coded, schema)
        done.write.parquet(f"{root}/coded")
        done = ix.spark.read.schema(schema).parquet(f"{root}/coded")
        sizes = done.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / PER_FILE).alias("_files"))
        parts = max(1, min(cells, int(ix.spark.conf.get("spark.sql.shuffle.partitions"))))
        dealt = done.join(F.broadcast(sizes), "cell").withColumn("_nth", F.pmod(F.xxhash64("id"), F.col("_files"))).repartition(parts, "cell", "_nth").sortWithinPartitions("cell", "id")
        dealt.select("id", *payload, "code", "cell").write.partitionBy("cell").parquet(f"{root}/codes")
        dealt.select("id", "embedding", "cell").write.partitionBy("cell").parquet(f"{root}/vectors")
        return ix

    def model(self) -> tuple[np.ndarray, list[np.ndarray]]:
        """Centroids and, for each piece, its codebook."""
        rows = self.spark.read.parquet(f"{self.root}/model").orderBy("kind", "a", "b").collect()  # MOST_CELLS and CODES a piece
        centroids = np.array([r["x"] for r in rows if r["kind"] == "cell"])
        books: dict[int, list] = {}
        for r in rows:
            if r["kind"] == "code":
                books.setdefault(r["a"], []).append(r["x"])
        return centroids, [np.array(books[p]) for p in sorted(books)]

    def search(self, queries: DataFrame, k: int = 10, probes: int = 8, refine: int = 100, where: Column | None = None, id_col: str = "id", vector: str = "embedding") -> DataFrame:
        """query, id, score (cosine, rounded to five places), rank (from 1) of the ``k`` nearest that are found for each query."""
        asked = queries.select(F.col(id_col).alias("query"), F.col(vector).cast("array<double>").alias("q"))
        rounds = max(1, -(-asked.count() // MOST_QUERIES))
        if refine > HELD // MOST_QUERIES and refine >= self.spark.read.parquet(f"{self.root}/codes").count():
            refine = ALL
        out = [self._round(asked.where(F.pmod(F.xxhash64("query"), F.lit(rounds)) == i) if rounds > 1 else asked, k, probes, max(k, refine), where) for i in range(rounds)]
        done = out[0]
        for more in out[1:]:
            done = done.unionByName(more)
        return done

    def probes_for(self, vectors: DataFrame, k: int = 10, least: float = 0.95, refine: int = 100, asked: int = 64, id_col: str = "id", vector: str = "embedding") -> int:
        """The fewest probes, doubling from 4, with which ``asked`` of the indexed vectors, chosen by a hash, find that part of their ``k`` nearest."""
        n = self.model()[0].shape[0]
        some = vectors.where(F.col(vector).isNotNull()).orderBy(F.xxhash64(id_col, F.lit("asked")), id_col).limit(asked)
        want = {(r["query"], r["id"]) for r in exact(vectors, some, k, id_col, vector).collect()}  # asked times k
        probes = 4
        while probes < n:
            found = {(r["query"], r["id"]) for r in self.search(some, k, probes, refine, None, id_col, vector).collect()}
            if len(found & want) >= least * len(want):
                break
            probes *= 2
        return min(probes, n)

    def _probed(self, asked: DataFrame, probes: int) -> tuple[np.ndarray, dict[int, list[int]], np.ndarray, list[np.ndarray]]:
        """Unit vectors of the collected queries, the numbers of those that probe each cell, centroids and codebooks."""
        centroids, books = self.model()
        rows = asked.orderBy("query").collect()  # at most about MOST_QUERIES
        x = _unit(np.array([r["q"] for r in rows]).reshape(len(rows), centroids.shape[1]))
        far = (centroids * centroids).sum(1) - 2 * x @ centroids.T
        near = np.argsort(far, axis=1, kind="stable")[:, :probes]
        by_cell: dict[int, list[int]] = {}
        for i, own in enumerate(near.tolist()):
            for c in own:
                by_cell.setdefault(c, []).append(i)
        return x, by_cell, centroids, books

    def candidates(self, asked: DataFrame, probes: int, refine: int, where: Column | None) -> tuple[DataFrame, list[int]]:
        """query (its number), id, cell of the ``refine`` best by their codes for each collected query; the cells read."""
        x, by_cell, centroids, books = self._probed(asked, probes)
        cells = sorted(by_cell)
        shared = self.spark.sparkContext.broadcast((x, by_cell, centroids, books))
        codes = self.spark.read.parquet(f"{self.root}/codes").where(F.col("cell").isin(cells))
        codes = (codes if where is None else codes.where(where)).select("id", "cell", "code")
        id_type = dict(codes.dtypes)["id"]

        def scored(batches):
            x, by_cell, centroids, books = shared.value
            width = books[0].shape[1]
            held, n_held = [], 0
            row = lambda h: pa.RecordBatch.from_arrays([pa.array(h[0]), h[1], pa.array(h[2]), pa.array(h[3])], names=["n", "id", "cell", "far"])
            for b in batches:
                cell = b.column(1).to_numpy()
                code = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(-1, len(books))
                for c in np.unique(cell):
                    at = np.flatnonzero(cell == c)
                    asks = by_cell[int(c)]
                    rest = x[asks] - centroids[c]
                    score = np.zeros((len(asks), len(at)))
                    for p, book in enumerate(books):
                        part = rest[:, p * width : (p + 1) * width]
                        table = (part * part).sum(1, keepdims=True) - 2 * part @ book.T + (book * book).sum(1)
                        score += table[:, code[at, p]]
                    few = min(refine, len(at))
                    best = np.argpartition(score, few - 1, axis=1)[:, :few]
                    held.append((np.repeat(np.array(asks, np.int32), few), b.column(0).take(pa.array(at[best.ravel()])), np.full(best.size, c, np.int32), np.take_along_axis(score, best, 1).ravel()))
                    n_held += best.size
                    if n_held > HELD:
                        held = [_best(held, refine)]
                        n_held = len(held[0][0])
                        if n_held > HELD // 2:
                            yield row(held[0])
                            held, n_held = [], 0
            if held:
                yield row(_best(held, refine))

        found = codes.mapInArrow(scored, f"n int, id {id_type}, cell int, far double")
        w = Window.partitionBy("n").orderBy("far", "id")
        return found.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= refine).select("n", "id", "cell"), cells

    def _round(self, asked: DataFrame, k: int, probes: int, refine: int, where: Column | None) -> DataFrame:
        numbered = asked.withColumn("n", (F.row_number().over(Window.orderBy("query")) - 1).cast("int"))  # at most about MOST_QUERIES
        if refine == ALL:
            found = self._scored_at_once(asked, k, probes, where)
            return best_of(found.join(F.broadcast(numbered.select("n", "query")), "n").select("query", "id", "score"), k)
        few, cells = self.candidates(asked, probes, refine, where)
        vectors = self.spark.read.parquet(f"{self.root}/vectors").where(F.col("cell").isin(cells))
        # refine rows for each query, so as many as grow with the queries: they are dealt, not broadcast
        pairs = vectors.join(few, ["cell", "id"]).join(F.broadcast(numbered), "n")
        return best_of(pairs.select("query", "id", similarity(F.col("embedding"), F.col("q")).alias("score")), k)

    def _scored_at_once(self, asked: DataFrame, k: int, probes: int, where: Column | None) -> DataFrame:
        """n (a query's number), id, score of the ``k`` best of each batch of the probed cells' vectors that ``where`` keeps."""
        x, by_cell, centroids, _ = self._probed(asked, probes)
        cells = sorted(by_cell)
        whole = probes >= len(centroids)
        shared = self.spark.sparkContext.broadcast((x, {} if whole else by_cell))
        own = self.spark.read.parquet(f"{self.root}/vectors").where(F.col("cell").isin(cells))
        if where is not None:
            kept = self.spark.read.parquet(f"{self.root}/codes").where(F.col("cell").isin(cells)).where(where).select("id", "cell")
            own = own.join(kept, ["id", "cell"], "left_semi")
        id_type = dict(own.dtypes)["id"]

        def scored(batches):
            x, by_cell = shared.value
            every = np.arange(len(x))
            for b in batches:
                for lo in range(0, b.num_rows, 2048):
                    part = b.slice(lo, 2048)
                    unit, cell = _unit(_matrix(part.column(1), x.shape[1])), part.column(2).to_numpy()
                    for c in [None] if whole else np.unique(cell):
                        at = np.arange(len(cell)) if whole else np.flatnonzero(cell == c)
                        asks = every if whole else np.array(by_cell[int(c)])
                        ids = part.column(0).take(pa.array(at))
                        few, best = _firsts(ids, np.round(unit[at] @ x[asks].T, 5).T, k)
                        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(asks.astype(np.int32), few.shape[1])), ids.take(pa.array(few.ravel())), pa.array(best.ravel())], names=["n", "id", "score"])

        return own.select("id", "embedding", "cell").mapInArrow(scored, f"n int, id {id_type}, score double")


def similarity(a: Column, b: Column) -> Column:
    """Cosine of two arrays of doubles, rounded to five places; 0 for a zero vector."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(total(F.transform(a, lambda v: v * v))) * F.sqrt(total(F.transform(b, lambda v: v * v)))
    return F.round(F.when(norms > 0, total(F.zip_with(a, b, lambda x, y: x * y)) / norms).otherwise(0.0), 5)


def best_of(pairs: DataFrame, k: int) -> DataFrame:
    """query, id, score, rank of the ``k`` best of each query, ties by id."""
    w = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query", "id", "score", "rank")


def exact(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "id", vector: str = "embedding") -> DataFrame:
    """What ``AnnIndex.search`` looks for, over all vectors: each batch is scored against all queries, and its best go on."""
    spark = ship(vectors.sparkSession)
    rows = queries.select(F.col(id_col).alias("query"), F.col(vector).cast("array<double>").alias("q")).limit(MOST_QUERIES + 1).collect()
    if len(rows) > MOST_QUERIES:
        raise ValueError(f"over {MOST_QUERIES} queries")
    names, x = [r["query"] for r in rows], _unit(np.array([r["q"] for r in rows]))
    shared = spark.sparkContext.broadcast(x)
    given = vectors.where(F.col(vector).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v"))

    def scored(batches):
        x = shared.value
        for b in batches:
            for lo in range(0, b.num_rows, 2048):
                part = b.slice(lo, 2048)
                # as a search rounds: ties at the fifth place are told by the id
                score = np.round(_unit(_matrix(part.column(1), x.shape[1])) @ x.T, 5).T
                ids = part.column(0)
                few, best = _firsts(ids, score, k)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(x), dtype=np.int32), few.shape[1])), ids.take(pa.array(few.ravel())), pa.array(best.ravel())], names=["n", "id", "score"])

    found = given.mapInArrow(scored, f"n int, id {dict(given.dtypes)['id']}, score double")
    kind = dict(queries.select(F.col(id_col).alias("q")).dtypes)["q"]
    named = spark.createDataFrame(list(enumerate(names)), f"n int, query {kind}")
    return best_of(found.join(F.broadcast(named), "n"), k)
