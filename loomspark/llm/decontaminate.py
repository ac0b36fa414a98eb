"""Benchmark decontamination by Wu-Manber search.

An item's windows of ``n`` consecutive words (a shorter item is one window) are the patterns, searched as bytes: words of
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` with A-Z lower-cased, one space before and after each. A table of the patterns'
blocks says how far the search may jump; where a block ends a pattern's first ``m`` bytes, the bucket of that suffix
block holds the patterns to be compared byte by byte. Patterns of like length share a table, so that a short item
doesn't shorten the jumps of all others.

Patterns are sent to the tasks in batches of at most ``batch_bytes``; a larger benchmark takes a pass for each batch,
and what the passes find is put together by document. Distinct windows are hashed and counted where the items lie.

Defined results: null or empty texts have no words and aren't contaminated; items without words are no items; items with
the same text all count; items without an id count as one item, whose hits count and which isn't listed; rows with the same ``doc_id`` are judged one by one; columns of other names pass by.
"""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks, common

WINDOW = 13
#: Bytes of pattern text that one pass sends to the tasks.
BATCH_BYTES = 16 << 20
#: Bytes of texts that are searched at a time, as Python objects.
PART_BYTES = 1 << 20
#: Lower bounds of the pattern lengths that share a table, with the block size of that table.
CLASSES = ((3, 2), (8, 4), (20, 6), (48, 8))


class WuManber:
    """Finds all occurrences of byte patterns of at least ``block`` bytes."""

    def __init__(self, patterns: list[bytes], block: int):
        self.block = block
        self.least = m = min(map(len, patterns))
        self.shift: dict[bytes, int] = {}
        self.bucket: dict[bytes, list[tuple[bytes, int]]] = defaultdict(list)
        for k, p in enumerate(patterns):
            for end in range(block, m + 1):
                part = p[end - block : end]
                if self.shift.get(part, m) > m - end:
                    self.shift[part] = m - end
            self.bucket[p[m - block : m]].append((p, k))

    def find(self, text: bytes):
        """Yields (start, number of the pattern) in ascending order of the start."""
        block, m, shift, bucket = self.block, self.least, self.shift.get, self.bucket
        far, at, n = m - block + 1, m, len(text)
        while at <= n:
            jump = shift(text[at - block : at], far)
            if jump:
                at += jump
                continue
            start = at - m
            for p, k in bucket[text[at - block : at]]:
                if text.startswith(p, start):
                    yield start, k
            at += 1


class Matcher:
    """Wu-Manber tables over windows; ``items[k]`` are the numbers of the items that have window ``k``."""

    def __init__(self, windows: list[tuple[bytes, list[int]]]):
        self.items = [i for _, i in windows]
        self.words = [w.count(b" ") - 1 for w, _ in windows]
        self.tables = []
        for (low, block), high in zip(CLASSES, [x for x, _ in CLASSES[1:]] + [1 << 62], strict=True):
            own = [k for k, (w, _) in enumerate(windows) if low <= len(w) < high]
            if own:
                self.tables.append((WuManber([windows[k][0] for k in own], block), own))

    def search(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Spans of hit words, merged and in order, and the items found."""
        text = b" " + b" ".join(words) + b" "
        spans, items = [], set()
        for table, own in self.tables:
            word, upto = 0, 0
            for start, j in table.find(text):
                k = own[j]
                word += text.count(b" ", upto, start)
                upto = start
                spans.append((word, word + self.words[k]))
                items.update(self.items[k])
        merged: list[tuple[int, int]] = []
        for s, e in sorted(spans):
            if merged and s <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(e, merged[-1][1]))
            else:
                merged.append((s, e))
        return merged, items


def windows_of(benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """window (binary, with a space around), item_ids (sorted strings) and nameless (an item without an id has it), distinct over the whole benchmark."""
    common.ship(benchmark.sparkSession)

    def cut(batches):
        for b in batches:
            ids, out = [], []
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                w = common.folded_words(text)
                for i in range(max(len(w) - n, 0) + 1 if w else 0):
                    ids.append(item)
                    out.append(b" " + b" ".join(w[i : i + n]) + b" ")
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(out, pa.binary())], ["item_id", "window"])

    items = benchmark.select(F.col("item_id").cast("string"), F.col("text"))
    return items.mapInArrow(cut, "item_id string, window binary").groupBy("window").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.bool_or(F.col("item_id").isNull()).alias("nameless"))


def batches_of(windows: DataFrame, batch_bytes: int):
    """Lists of (window, item_ids, a None among them for nameless ones) of at most ``batch_bytes`` together; one at a time is on the driver."""
    size, batch = 0, []
    for w, items, nameless in windows.select("window", "item_ids", "nameless").toLocalIterator(prefetchPartitions=False):
        batch.append((bytes(w), list(items) + [None] * nameless))
        size += len(w) + sum(map(len, items)) + nameless
        if size >= batch_bytes:
            yield batch
            size, batch = 0, []
    if batch:
        yield batch


def _pass(docs: DataFrame, batch: list[tuple[bytes, list[str | None]]]) -> DataFrame:
    """docs with n_words, spans, items and nameless of one batch of windows."""
    spark = docs.sparkSession
    names = sorted({i for _, items in batch for i in items if i is not None})
    number = {x: k for k, x in enumerate(names)} | {None: -1}
    shared = spark.sparkContext.broadcast((names, [(w, [number[i] for i in items]) for w, items in batch]))
    schema, cols = common.with_fields(docs, {"text"}, "n_words long, spans array<struct<s:long,e:long>>, items array<string>, nameless boolean")
    at = docs.columns.index("text")

    def parts(batches):
        for b in batches:
            for lo, size in blocks.slices(b.column(at), size=PART_BYTES):
                yield b.slice(lo, size)

    def search(batches):
        names, windows = shared.value
        matcher = Matcher(windows)
        for b in parts(batches):
            n, spans, found, nameless = [], [], [], []
            for text in b.column(at).to_pylist():
                words = common.folded_words(text)
                s, items = matcher.search(words) if words else ([], set())
                n.append(len(words))
                spans.append([{"s": x, "e": y} for x, y in s])
                nameless.append(-1 in items)
                found.append(sorted(names[i] for i in items if i >= 0))
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in cols], pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))), pa.array(found, pa.list_(pa.string())), pa.array(nameless, pa.bool_())],
                schema.names,
            )

    return docs.mapInArrow(common.tidy(search), schema)


def _merged(spans):
    """Overlapping and touching spans joined, as a column."""
    start = F.array().cast("array<struct<s:bigint,e:bigint>>")
    last = lambda a: F.element_at(a, -1)

    def step(a, x):
        joins = (F.size(a) > 0) & (x["s"] <= F.when(F.size(a) > 0, last(a)["e"]).otherwise(-1))
        joined = F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.struct(last(a)["s"].alias("s"), F.greatest(last(a)["e"], x["e"]).alias("e"))))
        return F.when(joins, joined).otherwise(F.concat(a, F.array(x)))

    return F.aggregate(F.array_sort(spans), start, step)


def find(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """``docs`` with n_words, spans (hit words, from s to before e, merged), items (ids found, sorted) and nameless (items without an id were found) added."""
    common.ship(docs.sparkSession)
    batches = batches_of(windows_of(benchmark, n), batch_bytes)
    first = next(batches, [])
    second = next(batches, None)
    if second is None:
        return _pass(docs, first)
    keyed = docs.withColumn("_key", common.digest(F.col("text")))
    found, texts = None, keyed.select("_key", "text")
    while True:
        part = common.saved(_pass(texts, first).where(F.size("spans") > 0).dropDuplicates(["_key"]), "windows")
        found = part if found is None else found.unionByName(part)
        if second is None:
            break
        first, second = second, next(batches, None)
    by_text = found.groupBy("_key").agg(
        _merged(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.bool_or("nameless").alias("nameless")
    )
    out = _pass(keyed, []).drop("spans", "items", "nameless").join(by_text, "_key", "left")
    for c, none in (("spans", F.array().cast("array<struct<s:bigint,e:bigint>>")), ("items", F.array().cast("array<string>")), ("nameless", F.lit(False))):
        out = out.withColumn(c, F.coalesce(F.col(c), none))
    return out.drop("_key")


def report(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of what ``find`` returned."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["e"] - x["s"])
    n_items = (F.size("items") + F.col("nameless").cast("int")).cast("long")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), n_items.alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256")).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
    )


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return report(find(docs, common.table(spark, sf_dir, "benchmark")))


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, with its columns, that aren't contaminated."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc_id"), F.col("text").alias("text"))
    return report(find(packed, benchmark)).where("not contaminated").select("doc_id.*")


OP8_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
q AS (SELECT item_id, w, least(len(w), 13) AS n, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i FROM b WHERE len(w) > 0),
p AS (SELECT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM q),
lens AS (SELECT DISTINCT n FROM p),
x AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM d, lens WHERE len(w) >= n),
g AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM x),
m AS (SELECT g.doc_id, g.n, g.i, p.item_id FROM g JOIN p ON g.n = p.n AND g.g = p.g),
h AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
