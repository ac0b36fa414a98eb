"""A stored lexical index in immutable segments: posting blocks by impact with block maxima, exact top-k that skips blocks.

Tokens are code-aware: an identifier gives its parts (``getUserById``: get, user, by, id) and, if these are not all of it,
itself.

A segment holds ``docs`` (id, len and its tokens with counts), and ``blocks``: a token's postings by descending impact, up to
``BLOCK`` in a row, with the greatest count and the least length among them. Tokens are counted within a document's row and then dealt by
range of (token, impact, id), so a frequent token lies in as many tasks as it needs, a file holds neighbouring tokens and a reader
skips the others by the files' minima and maxima.

Changes make new segments only. A segment names the documents that it replaces or removes (``gone``), and how many postings of
which earlier segment that makes void for each token (``less``), so document frequencies stay exact without reading old
postings. ``merge`` rewrites neighbouring segments as one and leaves out what is void.

For a top-k, the blocks with the highest bounds are scored first: the k-th best of these partial sums is a threshold that k
documents reach at least. A block whose bound, with the best that other tokens could add, stays below it can hold none of the k: its
documents' scores are all too low. So only the other blocks are read, and the result is exact.
"""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import ship
from .embedding import _parts
from .retrieval import K1, B

BLOCK = 128
#: Postings of a task when a segment is written.
PER_TASK = 2_000_000
#: Blocks of each token that are scored to find the threshold.
SEEDS = 4
#: Scores are rounded to six places.
_SLACK = 2e-6


def code_tokens(text: Column) -> Column:
    """Lower-cased parts of all identifiers ``[A-Za-z0-9_]+`` in order, then the identifiers that have marks of parts."""
    parted = F.regexp_replace(F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2"), "[^A-Za-z0-9]+", " ")
    parts = F.filter(F.split(F.lower(parted), " "), lambda w: w != "")
    whole = F.regexp_extract_all(text, F.lit("(?<![A-Za-z0-9_])[A-Za-z0-9_]*(?:[a-z0-9][A-Z]|_)[A-Za-z0-9_]*"), F.lit(0))
    return F.concat(parts, F.transform(whole, F.lower))


def counted(tokens: Column) -> Column:
    """Distinct tokens with their counts (token, tf): sorted, then cut where the token changes; linear after the sort."""
    once = F.array(F.struct(F.sort_array(tokens).alias("s")))  # the sorted array is made once, as a lambda's argument

    def cut(x):
        s = x["s"]
        starts = F.filter(F.transform(s, lambda w, i: F.when((i == 0) | (w != F.get(s, i - 1)), i)), lambda i: i.isNotNull())
        both = F.array(F.struct(s.alias("s"), starts.alias("at"), F.size(s).alias("n")))
        return F.element_at(F.transform(both, lambda y: F.transform(y["at"], lambda i, k: F.struct(F.get(y["s"], i).alias("token"), (F.coalesce(F.get(y["at"], k + 1), y["n"]) - i).alias("tf")))), 1)

    return F.element_at(F.transform(once, cut), 1)


def _part(tf: Column, size: Column, mean) -> Column:
    """BM25's share of a posting, without its token's weight: it grows with the count and falls with the length."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / mean))


class LexicalIndex:
    """The index below ``root``, of documents with ids of one type (DDL). Opening it twice changes nothing; one writer at a time."""

    def __init__(self, spark: SparkSession, root: str, id_type: str = "bigint"):
        self.spark, self.root = ship(spark), root.rstrip("/")
        self.schemas = {
            "docs": f"id {id_type}, len int, posts array<struct<token:string,tf:int>>",
            "blocks": f"token string, n int, max_tf int, min_len int, ids array<{id_type}>, tfs array<int>, lens array<int>",
            "gone": f"id {id_type}",
            "less": "token string, segment int, n bigint",
            "statistics": "docs bigint, tokens bigint, blocks bigint",
        }
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._path = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        self._fs = self._path("segments").getFileSystem(conf)
        self._fs.mkdirs(self._path("segments"))

    # segments are named first-last-something; one that covers others stands for them

    def segments(self) -> list[tuple[int, int, str]]:
        """(first, last, folder) of the current segments, in order."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path("segments"))]  # a name for each batch
        found = sorted((*map(int, n.split("-")[:2]), n) for n in names if self._fs.exists(self._path(f"segments/{n}/statistics/_SUCCESS")))
        return [s for s in found if not any(t[0] <= s[0] and s[1] <= t[1] and (t[0], t[1]) != (s[0], s[1]) for t in found)]

    def _read(self, name: str, only: list | None = None) -> DataFrame:
        """Rows of the current (or given) segments' table, with first: the segment's number."""
        schema = T.StructType.fromDDL(self.schemas[name])
        parts = [self.spark.read.schema(schema).parquet(f"{self.root}/segments/{s[2]}/{name}").withColumn("first", F.lit(s[0])) for s in (self.segments() if only is None else only)]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("first", T.IntegerType())]))

    def live_docs(self, segments: list | None = None) -> DataFrame:
        """docs of segments (all current ones) that no later segment of theirs replaces or removes."""
        segments = self.segments() if segments is None else segments
        docs = self._read("docs", segments)
        if len(segments) < 2:
            return docs
        gone = self._read("gone", segments).groupBy("id").agg(F.max("first").alias("_gone"))
        return docs.join(gone, "id", "left").where(F.col("_gone").isNull() | (F.col("first") >= F.col("_gone"))).drop("_gone")

    def add(self, docs: DataFrame, id_col: str = "id", text: str = "text") -> str:
        """A segment of documents, which replace those of the same ids; the last of rows that repeat an id isn't defined. Its folder's name."""
        cores = self.spark.sparkContext.defaultParallelism
        if docs.rdd.getNumPartitions() < cores:  # cutting tokens costs more than dealing out so few splits
            docs = docs.select(id_col, text).repartition(cores)
        kind = T.StructType.fromDDL(self.schemas["docs"])["id"].dataType
        rows = docs.select(F.col(id_col).cast(kind).alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(_cut, self.schemas["docs"])
        return self._write(rows, None)

    def remove(self, ids: DataFrame) -> str:
        """A segment without documents that removes ``ids`` (id)."""
        return self._write(self.spark.createDataFrame([], T.StructType.fromDDL(self.schemas["docs"])), ids.select("id"))

    def _write(self, rows: DataFrame, removed: DataFrame | None) -> str:
        before = self.segments()
        first = before[-1][1] + 1 if before else 1
        name = f"{first:06d}-{first:06d}-{uuid.uuid4().hex[:8]}"
        at = f"{self.root}/segments/{name}"
        rows.write.parquet(f"{at}/docs")
        docs = self.spark.read.schema(self.schemas["docs"]).parquet(f"{at}/docs")
        named = docs.select("id") if removed is None else removed.distinct()
        if before:
            void = self.live_docs().join(named, "id", "left_semi")
            self._save(void.select("id").distinct(), at, "gone")
            void = void.join(self.spark.read.schema(self.schemas["gone"]).parquet(f"{at}/gone"), "id", "left_semi")
            self._save(void.select(F.explode("posts.token").alias("token"), F.col("first").alias("segment")).groupBy("token", "segment").agg(F.count(F.lit(1)).alias("n")), at, "less")
            lost = void.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("len"), F.lit(0)).alias("tokens")).first()
        else:
            for t in ("gone", "less"):
                self._save(self.spark.createDataFrame([], T.StructType.fromDDL(self.schemas[t])), at, t)
            lost = {"docs": 0, "tokens": 0}
        self._finish(at, docs, lost)
        return name

    def _save(self, df: DataFrame, at: str, table: str) -> None:
        df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(self.schemas[table])]).write.parquet(f"{at}/{table}")

    def _finish(self, at: str, docs: DataFrame, lost) -> None:
        """The blocks of a segment and, last, its statistics, net of what it makes void before."""
        n = docs.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("len"), F.lit(0)).alias("tokens"), F.coalesce(F.sum(F.size("posts")), F.lit(0)).alias("posts")).first()
        mean = max(n["tokens"] / max(n["docs"], 1), 1e-9)
        posts = docs.select("id", "len", F.explode("posts").alias("p")).select("p.token", "id", "p.tf", "len")
        low = (-F.floor(_part(F.col("tf"), F.col("len"), F.lit(mean)) * 1000)).cast("int").alias("_low")
        parts = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-n["posts"] // PER_TASK))
        order = ["token", "_low", "id"]
        dealt = posts.withColumn("_low", low).repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("_low")
        dealt.mapInArrow(_blocks, self.schemas["blocks"]).write.parquet(f"{at}/blocks")
        blocks = self.spark.read.schema(self.schemas["blocks"]).parquet(f"{at}/blocks").count()
        self.spark.createDataFrame([(n["docs"] - lost["docs"], n["tokens"] - lost["tokens"], blocks)], self.schemas["statistics"]).coalesce(1).write.parquet(f"{at}/statistics")

    def merge(self, most: int = 4, ratio: float = 4) -> str | None:
        """Rewrites the last ``most`` segments as one if they are of a size, the greatest at most ``ratio`` times the others together; what is void in them goes. Readers take the new segment once it is complete. Its name."""
        last = self.segments()[-most:]
        if len(last) < most:
            return None
        sizes = {r["first"]: r["n"] for r in self._read("docs", last).groupBy("first").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each segment
        if max(sizes.values(), default=0) > ratio * max(1, sum(sizes.values()) - max(sizes.values(), default=0)):
            return None
        name = f"{last[0][0]:06d}-{last[-1][1]:06d}-{uuid.uuid4().hex[:8]}"
        at = f"{self.root}/segments/{name}"
        self.live_docs(last).drop("first").write.parquet(f"{at}/docs")
        self._save(self._read("gone", last).select("id").distinct(), at, "gone")
        older = self._read("less", last).where(F.col("segment") < last[0][0])
        self._save(older.groupBy("token", "segment").agg(F.sum("n").alias("n")), at, "less")
        docs = self.spark.read.schema(self.schemas["docs"]).parquet(f"{at}/docs")
        whole = self._read("statistics", last).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).first()
        own = docs.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("len"), F.lit(0)).alias("tokens")).first()
        self._finish(at, docs, {k: own[k] - whole[k] for k in ("docs", "tokens")})
        return name

    # reading

    def _weights(self, words: list[str]) -> tuple[dict[str, float], float]:
        """Each word's weight, if any document has it, and the mean length."""
        s = self._read("statistics").agg(F.sum("docs").alias("n"), F.sum("tokens").alias("t")).first()
        if not s["n"]:
            return {}, 1.0
        current = [x[0] for x in self.segments()]
        sums = self._read("blocks").where(F.col("token").isin(words)).select("token", "n")
        if len(current) > 1:
            ranges = self.segments()
            held = reduce(lambda a, b: a | b, [F.col("segment").between(a, b) for a, b, _ in ranges])
            sums = sums.unionByName(self._read("less").where(F.col("token").isin(words) & held).select("token", (-F.col("n")).cast("int").alias("n")))
        df = {r["token"]: r["n"] for r in sums.groupBy("token").agg(F.sum("n").alias("n")).collect() if r["n"] > 0}
        return {w: float(np.log(1 + (s["n"] - n + 0.5) / (n + 0.5))) for w, n in df.items()}, s["t"] / s["n"]

    def live_postings(self) -> DataFrame:
        """token, id, tf, len of all that counts."""
        posts = self._read("blocks").select("token", "first", F.explode(F.arrays_zip("ids", "tfs", "lens")).alias("p")).select("token", "first", F.col("p.ids").alias("id"), F.col("p.tfs").alias("tf"), F.col("p.lens").alias("len"))
        return self._alive(posts).drop("first")

    def _alive(self, posts: DataFrame) -> DataFrame:
        """posts (id, first, ...) without those that a later segment makes void."""
        if len(self.segments()) < 2:
            return posts
        gone = self._read("gone").groupBy("id").agg(F.max("first").alias("_gone"))
        return posts.join(gone, "id", "left").where(F.col("_gone").isNull() | (F.col("first") >= F.col("_gone"))).drop("_gone")

    def _weighed(self, blocks: DataFrame, weights: dict[str, float]) -> DataFrame:
        named = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
        return blocks.where(F.col("token").isin(list(weights))).withColumn("weight", F.element_at(named, F.col("token")))

    def _scored(self, blocks: DataFrame, mean: float, words: list[str]) -> DataFrame:
        """id, score (the sum in the words' order) of the live documents in weighed blocks."""
        posts = blocks.select("token", "weight", "first", F.explode(F.arrays_zip("ids", "tfs", "lens")).alias("p")).select("token", "first", F.col("p.ids").alias("id"), (F.col("weight") * _part(F.col("p.tfs"), F.col("p.lens"), F.lit(mean))).alias("s"))
        each = self._alive(posts).groupBy("id").agg(*[F.max(F.when(F.col("token") == w, F.col("s"))).alias(f"s{i}") for i, w in enumerate(words)])
        return each.select("id", F.round(reduce(lambda a, b: a + b, [F.coalesce(f"s{i}", F.lit(0.0)) for i in range(len(words))]), 6).alias("score"))

    def scores(self, words: list[str]) -> DataFrame:
        """id, score (rounded to six places) of all documents with a token of ``words``; k1 1.2, b 0.75."""
        words = list(dict.fromkeys(w.lower() for w in words))
        weights, mean = self._weights(words)
        if not weights:
            return self.spark.createDataFrame([], T.StructType.fromDDL(self.schemas["gone"]).add("score", T.DoubleType()))
        return self._scored(self._weighed(self._read("blocks"), weights), mean, [w for w in words if w in weights])

    def needed(self, words: list[str], k: int) -> tuple[DataFrame, float, list[str]]:
        """The weighed blocks that may hold a posting of the ``k`` best, the mean length and the words that have any."""
        weights, mean = self._weights(words)
        words = [w for w in words if w in weights]
        blocks = self._weighed(self._read("blocks"), weights) if weights else self._read("blocks").where(F.lit(False)).withColumn("weight", F.lit(0.0))
        blocks = blocks.withColumn("bound", F.col("weight") * _part(F.col("max_tf"), F.col("min_len"), F.lit(mean)))
        best = {r["token"]: r["bound"] for r in blocks.groupBy("token").agg(F.max("bound").alias("bound")).collect()}  # a row for each word
        top = reduce(DataFrame.unionByName, [blocks.where(F.col("token") == w).orderBy(F.desc("bound")).limit(SEEDS + k // BLOCK) for w in best]) if best else blocks
        sums = [r["score"] for r in self._scored(top.drop("bound"), mean, words).orderBy(F.desc("score")).limit(k).collect()] if best else []
        if len(sums) < k:
            return blocks, mean, words
        least = sums[-1] - _SLACK
        others = F.element_at(F.create_map(*[F.lit(x) for w in best for x in (w, sum(best.values()) - best[w])]), F.col("token"))
        return blocks.where(F.col("bound") + others >= least), mean, words

    def topk(self, words: list[str], k: int = 10) -> DataFrame:
        """id, score of the ``k`` best, ties by id; the same as the first of ``scores``."""
        words = list(dict.fromkeys(w.lower() for w in words))
        blocks, mean, words = self.needed(words, k)
        if not words:
            return self.scores(words).limit(0)
        return self._scored(blocks.drop("bound"), mean, words).orderBy(F.desc("score"), "id").limit(k)

    def skipped(self, words: list[str], k: int = 10) -> DataFrame:
        """token, blocks, read: how many blocks there are, and how many of them ``topk`` reads."""
        words = list(dict.fromkeys(w.lower() for w in words))
        count = lambda df, name: df.groupBy("token").agg(F.count(F.lit(1)).alias(name))
        every = count(self._read("blocks").where(F.col("token").isin(words)), "blocks")
        return every.join(count(self.needed(words, k)[0], "read"), "token", "left").na.fill(0, ["read"])


#: Of each byte: 1 a lower-case letter or digit, 2 an upper-case letter, 3 the underscore, 0 another, as are all bytes beyond ASCII.
_KIND = np.array([1 if chr(c) in "abcdefghijklmnopqrstuvwxyz0123456789" else 2 if 65 <= c <= 90 else 3 if c == 95 else 0 for c in range(256)], np.uint8)
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)


def _cut(batches):
    """Documents (id, text) as rows of ``docs``: what ``counted`` makes of ``code_tokens``, by marks on the bytes of some texts at a time."""
    for b in batches:
        for lo, n in _parts(pc.fill_null(pc.binary_length(b.column(1)), 0).to_pylist()):
            size, posts = _posts(b.column(1).slice(lo, n))
            yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, n), size, posts], names=["id", "len", "posts"])


def _posts(texts: pa.Array) -> tuple[pa.Array, pa.Array]:
    """How many tokens each text has, and its distinct ones with their counts, in order."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    n, (_, at, held) = len(texts), texts.buffers()
    at = np.frombuffer(at, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(held, np.uint8)[at[0] : at[-1]] if held is not None else np.zeros(0, np.uint8)
    at = at - at[0]
    kind = _KIND[data]
    before = np.zeros_like(kind)  # of the byte before it in the same text
    before[1:] = kind[:-1]
    before[at[:-1][at[:-1] < len(data)]] = 0
    lower = _LOWER[data]
    turns = (kind == 2) & (before == 1)
    whole = kind > 0
    opens = whole & (before == 0)
    which = np.cumsum(opens) - 1  # the identifier that a byte is of
    marked = np.zeros(int(opens.sum()), bool)
    marked[which[turns | (kind == 3)]] = True
    part = (kind == 1) | (kind == 2)
    whole[whole] = marked[which[whole]]
    cut = lambda kept, first: (np.flatnonzero(first), np.append(np.cumsum(kept)[first] - 1, np.count_nonzero(kept)).astype(np.int32), lower[kept])
    starts, tokens = [], []
    for first, ends, kept in (cut(part, part & (turns | (before == 0) | (before == 3))), cut(whole, whole & opens)):
        starts.append(first)
        tokens.append(pa.StringArray.from_buffers(len(first), pa.py_buffer(ends), pa.py_buffer(kept)))
    doc = np.searchsorted(at, np.concatenate(starts), "right") - 1
    codes = pa.concat_arrays(tokens).dictionary_encode()
    order = pc.sort_indices(codes.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    most = max(len(order), 1)
    keys, tf = np.unique(doc * most + rank[codes.indices.to_numpy()], return_counts=True)
    items = pa.StructArray.from_arrays([codes.dictionary.take(pa.array(order[keys % most])), pa.array(tf.astype(np.int32))], names=["token", "tf"])
    offsets = np.searchsorted(keys, np.arange(n + 1) * most).astype(np.int32)
    return pa.array(np.bincount(doc, minlength=n).astype(np.int32)), pa.ListArray.from_arrays(pa.array(offsets), items)


def _blocks(batches):
    """Sorted postings (token, id, tf, len) as rows of up to BLOCK of a token."""
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        token = b.column(0)
        new = np.ones(n, bool)
        if n > 1:
            new[1:] = pc.not_equal(token.slice(1), token.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        run = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        starts = np.flatnonzero((np.arange(n) - run) % BLOCK == 0)
        offsets = pa.array(np.append(starts, n), pa.int32())
        tf, size = (b.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
        lists = [pa.ListArray.from_arrays(offsets, b.column(i)) for i in (1, 2, 3)]
        counts = np.diff(np.append(starts, n)).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [token.take(pa.array(starts)), pa.array(counts), pa.array(np.maximum.reduceat(tf, starts)), pa.array(np.minimum.reduceat(size, starts)), *lists],
            names=["token", "n", "max_tf", "min_len", "ids", "tfs", "lens"],
        )


def state_of(spark: SparkSession, path: str) -> str:
    """What tells one state of the files below ``path`` from another: names, sizes and times."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(conf)
    top = fs.getFileStatus(at)
    each = fs.listStatus(at) if top.isDirectory() else [top]
    return "|".join(sorted(f"{s.getPath()}:{s.getLen()}:{s.getModificationTime()}" for s in each))
