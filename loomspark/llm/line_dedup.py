"""Line dedup with range-partitioned hashes and keep bitmaps; DataFrame functions only.

Lines (document, position, 128 bits of the key's SHA-256) are written once, then dealt by range of (hash, document) and
sorted by hash, document and position within each range. So a hash has its occurrences next to each other in order of
document and position, and one that a third of all rows share spans as many ranges as it needs. Each range is streamed: a
row for each hash and document with its first position, then by partial sums a row for each hash with its number of
documents and lines and its first occurrence. Hashes that decide anything go back to the lines: the few that hold more
than ``1 / HOT`` of all lines each by broadcast (there are at most ``HOT`` of them), the others by a join on the hash.

What comes back for each document is a bitmap of dropped lines in 64-bit words, words without a bit left out. Texts
never move to be compared. Bitmaps of up to ``MOST_WORDS`` words in all are broadcast to where the texts lie; more meet
the texts by a join on the row's hash.

``mode="frequent"`` drops every line whose key is in at least ``min_docs`` documents; ``mode="first"`` keeps, of such a
key, its first occurrence by document and position.

A key is the line without ``[\\x20\\x09-\\x0D]`` at both ends and with A-Z lower-cased; lines with an empty key always stay.
Defined results: a null or empty text has one empty line; rows with a null ``doc_id`` and the same text are one document;
rows that repeat a ``doc_id`` are one document when documents are counted, and each row is cut on its own; columns of
other names pass by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MIN_DOCS = 10
#: At most so many hashes, each with more than this part of all lines, are broadcast.
HOT = 4000
#: Words of bitmaps (some 50 bytes each, with their rows' hashes) that are broadcast at most.
MOST_WORDS = 1_000_000
_BLANK = " \t\n\x0b\f\r"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key_of(line: Column) -> Column:
    """Blanks go at both ends; only lines that have one there are trimmed."""
    return common.ascii_lower(F.btrim(line, F.lit(_BLANK)))


def numbered(docs: DataFrame) -> DataFrame:
    """docs with _row (a hash of id and text); rows that are equal in both are cut alike."""
    return docs.withColumn("_row", common.digest(F.col("doc_id"), F.col("text")))


def dropped_bits(docs: DataFrame, min_docs: int = MIN_DOCS, mode: str = "frequent") -> DataFrame:
    """row (its hash) and bitmap (array of word, bits; bit p mod 64 of word p div 64 for line p) of rows that lose lines."""
    if mode not in ("frequent", "first"):
        raise ValueError(f"unknown mode {mode!r}")
    rows = numbered(docs.select("doc_id", "text"))
    # a document is its id, or where that is null its row
    doc = [F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc"), F.when(F.col("doc_id").isNull(), F.col("_row")).alias("anon")]
    lines = rows.select(F.col("_row").alias("row"), *doc, F.posexplode(lines_of(F.col("text"))).alias("pos", "line")).withColumn("key", key_of(F.col("line"))).where("key <> ''")
    lines = common.saved(lines.select("row", "doc", "anon", "pos", common.digest(F.col("key")).alias("h")), "lines")
    n = lines.count()
    ranged = lines.repartitionByRange(common.partitions_for(lines, 4), "h", "doc", "anon").sortWithinPartitions("h", "doc", "anon", "pos")
    # ranges already hold a hash's rows of one document together: no exchange here
    per_doc = ranged.groupBy("h", "doc", "anon").agg(F.min(F.struct("pos", "row")).alias("first"), F.count(F.lit(1)).alias("lines"))
    first = F.min(F.struct("doc", "anon", "first.pos", "first.row")).alias("first")
    keys = per_doc.groupBy("h").agg(F.count(F.lit(1)).alias("docs"), F.sum("lines").alias("lines"), first).where(F.col("docs") >= min_docs)
    keys = common.saved(common.spread(keys, n, 1_000_000), "line-keys")
    hot = keys.where(F.col("lines") > n / HOT)
    rest = keys.where(F.col("lines") <= n / HOT)
    at = ["row", "doc", "anon", "pos"]
    marked = lines.join(F.broadcast(hot.select("h", "first", F.lit(True).alias("is_hot"))), "h", "left")
    by_hot = marked.where("is_hot")
    by_rest = marked.where("is_hot is null").select(*at, "h").join(rest.select("h", "first"), "h")
    found = by_hot.select(*at, "first").unionByName(by_rest.select(*at, "first"))
    if mode == "first":
        found = found.where(~F.struct("doc", "anon", "pos", "row").eqNullSafe(F.col("first")))
    word = F.shiftright("pos", 6)
    bits = found.groupBy("row", word.alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, pmod(pos, 64))")).alias("bits"))
    return bits.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("bitmap"))


def dense(bitmap: Column) -> Column:
    """The bitmap's words from the first to the last that has a bit, as an array of longs."""
    zero = F.lit(0).cast("long")
    gap = lambda x, i: x["word"] - F.coalesce(F.get(bitmap, i - 1)["word"], F.lit(-1)) - 1
    return F.flatten(F.transform(bitmap, lambda x, i: F.concat(F.array_repeat(zero, gap(x, i)), F.array(x["bits"]))))


def n_dropped(bitmap: Column) -> Column:
    return F.aggregate(bitmap, F.lit(0).cast("long"), lambda a, x: a + F.bit_count(x["bits"]))


def kept_text(text: Column, words: Column) -> Column:
    """The lines whose bit isn't set, joined again; ``words`` is a dense bitmap."""
    word = lambda p: F.get(words, F.shiftright(p, 6))
    is_set = lambda p: F.call_function("shiftright", word(p), F.pmod(p, F.lit(64)).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1
    return F.array_join(F.filter(lines_of(text), lambda line, p: ~F.coalesce(is_set(p), F.lit(False))), "\n")


def deduped(docs: DataFrame, min_docs: int = MIN_DOCS, mode: str = "frequent") -> DataFrame:
    """docs with _kept (the text without its dropped lines), _n_lines, _n_dropped and _bitmap (null if no line goes)."""
    bits = common.saved(dropped_bits(docs, min_docs, mode).select(F.col("row").alias("_row"), F.col("bitmap").alias("_bitmap")), "bitmaps")
    if (bits.agg(F.sum(F.size("_bitmap") + 1).alias("n")).first()["n"] or 0) <= MOST_WORDS:
        bits = F.broadcast(bits)
    out = numbered(docs).join(bits, "_row", "left").withColumn("_words", dense(F.col("_bitmap")))
    return (
        out.withColumn("_n_lines", F.size(lines_of(F.col("text"))).cast("long"))
        .withColumn("_n_dropped", F.coalesce(n_dropped(F.col("_bitmap")), F.lit(0).cast("long")))
        .withColumn("_kept", F.when(F.col("_bitmap").isNull(), F.coalesce("text", F.lit(""))).otherwise(kept_text(F.col("text"), F.col("_words"))))
        .drop("_row", "_words")
    )


def written(bitmap: Column) -> Column:
    """A bitmap as text: word:bits of each word with a bit, comma-joined; empty without one."""
    return F.coalesce(F.array_join(F.transform(bitmap, lambda x: F.concat_ws(":", x["word"].cast("string"), x["bits"].cast("string"))), ","), F.lit(""))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = deduped(docs)
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2("_kept", 256).alias("kept_sha256"), written(F.col("_bitmap")).alias("dropped_bits"))


def cleaned(docs: DataFrame, min_docs: int = MIN_DOCS, mode: str = "frequent") -> DataFrame:
    """``docs``, with its columns, without the dropped lines; n_chars, if there is such a column, follows the text."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_in"), F.col("doc_id").alias("doc_id"), F.col("text").alias("text"))
    out = deduped(packed, min_docs, mode)
    new = {"text": F.when(F.col("text").isNull(), F.col("text")).otherwise(F.col("_kept"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("_bitmap").isNull(), F.col("_in.n_chars")).otherwise(F.char_length("_kept").cast(docs.schema["n_chars"].dataType))
    return out.select(*[new.get(c, F.col(f"_in.`{c}`")).alias(c) for c in docs.columns])


OP4_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
m AS (SELECT k.*, f.key IS NOT NULL AS gone FROM k LEFT JOIN f ON k.key = f.key),
w AS (SELECT doc_id, (pos - 1) // 64 AS word, bit_or(CASE WHEN (pos - 1) % 64 = 63 THEN (-9223372036854775807 - 1)::BIGINT ELSE 1::BIGINT << ((pos - 1) % 64)::INT END) AS bits FROM m WHERE gone GROUP BY ALL),
b AS (SELECT doc_id, string_agg(word || ':' || bits, ',' ORDER BY word) AS dropped_bits FROM w GROUP BY doc_id),
t AS (SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id)
SELECT t.*, coalesce(b.dropped_bits, '') AS dropped_bits FROM t LEFT JOIN b USING (doc_id)
"""
