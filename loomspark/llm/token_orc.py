"""Token-ID output as ORC.

Documents are dealt into ranges of ascending ``doc_id`` (or lie in such ranges already), each range is one ORC file written in that order. ORC keeps the
ids in integer run-length encoding, with an index for every few thousand rows and a Bloom filter on ``doc_id``, so that
readers split by stripe and a look-up by document skips stripes by metadata. Every row holds the number of ids before it
in its file; the offset of a file is the sum of its predecessors, one number a file.

Ids come from the tokenizers library. Byte-level pre-tokenization never joins a space to the visible character before
it, so a text is cut at such spaces and each distinct cut is encoded by the library once and remembered, up to
``CACHE`` cuts. A text that holds one of the special tokens' strings goes to the library as a whole.

Defined results: a null or empty text has the end id alone; a null ``doc_id`` sorts first; rows with the same ``doc_id``
are ordered by text; extra columns are ignored, whatever their names; an empty table gives an empty file set.
"""

from __future__ import annotations

import gc
import json
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import blocks, common

#: Cuts that a worker remembers before the older half of what it knows goes.
CACHE = 400_000
_LETTERS, _MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", r"!-&(-/:-@\[-`{-~"
#: A word of letters, perhaps marks (no apostrophe); perhaps a line break and the same again.
_SIMPLE = re.compile(f"([{_LETTERS}]+)([{_MARKS}]*)(?:\n([{_LETTERS}]+)([{_MARKS}]*))?\\Z")


class _Written(dict):
    """How a byte-level vocabulary writes a character, learned as needed: visible bytes as they are, others from U+0100 on."""

    def __init__(self):
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        hidden = [b for b in range(256) if b not in shown]
        self.of = [chr(256 + hidden.index(b)) if b in hidden else chr(b) for b in range(256)]

    def __missing__(self, c: str) -> str:
        self[c] = out = "".join(self.of[b] for b in c.encode())
        return out


class Encoder:
    """Encodes whole texts as ``Tokenizer.encode(text, add_special_tokens=False)`` does, as little-endian uint32 bytes."""

    _of: dict[int, Encoder] = {}

    def __init__(self, model: bytes):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(model)
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        special = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        spec = json.loads(model)
        pre = spec.get("pre_tokenizer") or {}
        #: Only with this pre-tokenizer and no normalizer are cuts known; else every text goes to the library as a whole.
        cut = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer") and spec["model"]["type"] == "BPE"
        self.odd = "|".join([blocks.DOUBLE, *special]) if cut else ".|\n"
        self.tokenize = self.tokenizer.model.tokenize if cut else None
        self.written = _Written()
        self.units: dict[str, bytes] = {}

    @classmethod
    def get(cls, model: bytes) -> Encoder:
        """One encoder, with what it remembers, for all tasks of a worker."""
        key = zlib.crc32(model)
        if key not in cls._of:
            cls._of[key] = cls(model)
        return cls._of[key]

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def words(self, words: list[str]) -> list[bytes]:
        """The ids of words with a space before them."""
        found = list(map(self.cache.get, words))
        if missing := [i for i, x in enumerate(found) if x is None]:
            for i, x in zip(missing, self.learn([words[i] for i in missing]), strict=True):
                found[i] = x
        return found

    def unit(self, text: str) -> bytes:
        """The ids of what the pre-tokenizer takes as one unit, from the library's model."""
        return array("I", [t.id for t in self.tokenize("".join(map(self.written.__getitem__, text)))]).tobytes()

    def known(self, text: str) -> bytes:
        """``unit`` of marks and line breaks, remembered: there are few."""
        if (y := self.units.get(text)) is None:
            if len(self.units) > 10_000:
                self.units.clear()
            self.units[text] = y = self.unit(text)
        return y

    def firsts(self, words: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def learn(self, words: list[str]) -> list[bytes]:
        """Encodes distinct words (each with a space before it) that aren't in the cache.

        Letters are one unit of the pre-tokenizer, marks after them another, and so is a single line break before a letter;
        such units go to the library's model directly.
        """
        older = self.older
        if len(self.cache) > CACHE:
            self.older, self.cache = self.cache, {}
        out: list[bytes] = []
        cache, rest, simple, unit, tokenize, space = self.cache, [], _SIMPLE.match, self.unit, self.tokenize, self.written[" "]
        for x in words:
            y = older.get(x)
            if y is None:
                if x.isalpha():
                    y = array("I", [t.id for t in tokenize(space + x)]).tobytes() if x.isascii() else unit(" " + x)
                elif m := simple(x):
                    first, marks, second, more = m.groups()
                    y = cache.get(first) or older.get(first) or unit(" " + first)
                    if marks:
                        y += self.known(marks)
                    if second:
                        y += self.known("\n") + unit(second)
                        if more:
                            y += self.known(more)
                else:
                    rest.append((len(out), x))
                    y = b""
            cache[x] = y
            out.append(y)
        if rest:
            for (i, x), e in zip(rest, self.tokenizer.encode_batch_fast([" " + x for _, x in rest], add_special_tokens=False), strict=True):
                cache[x] = out[i] = array("I", e.ids).tobytes()
        return out

    def encode(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and ids of a block of texts; equal texts are encoded once."""
        coded = pc.fill_null(texts, "").dictionary_encode()
        own = coded.dictionary
        odd = pc.match_substring_regex(own, self.odd).to_numpy(zero_copy_only=False)
        offsets, ids = blocks.encode(own, odd, self.words, self.firsts, self.whole, end)
        if len(own) == len(texts):
            return offsets, ids
        index = coded.indices.to_numpy()
        sizes = np.diff(offsets)[index]
        ends = np.cumsum(sizes)
        place = np.repeat(offsets[:-1][index] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)
        return np.concatenate(([0], ends)), ids[place]


def _is_scan(docs: DataFrame) -> bool:
    """Whether the plan is one scan of files with nothing but steps above that keep rows where they are."""
    node = docs._jdf.queryExecution().executedPlan()
    while not node.nodeName().startswith("Scan "):
        if node.children().size() != 1 or "Exchange" in node.nodeName() or "Sort" in node.nodeName():
            return False
        node = node.children().head()
    return True


def in_order(docs: DataFrame) -> bool:
    """Whether the partitions of ``docs``, a plain scan of files, hold ranges of strictly ascending doc_id already.

    Reads that column only; a row for each partition reaches the driver.
    """
    if not docs.inputFiles() or not _is_scan(docs):
        return False

    def ends(batches):
        first = last = None
        ok = True
        for b in batches:
            if b.num_rows:
                x = b.column(0)
                v = x.to_numpy(zero_copy_only=False)
                ok = ok and not x.null_count and bool((v[1:] > v[:-1]).all()) and (last is None or v[0] > last)
                if not ok:
                    break
                first, last = v[0] if first is None else first, v[-1]
        if not ok or last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([None if not ok else int(first)], pa.int64()), pa.array([None if not ok else int(last)], pa.int64())], ["a", "b"])

    found = docs.select(F.col("doc_id").cast("long")).mapInArrow(ends, "a long, b long").collect()
    if any(r["a"] is None for r in found):
        return False
    found = sorted((r["a"], r["b"]) for r in found)
    return all(x[1] < y[0] for x, y in zip(found, found[1:], strict=False))


def write(docs: DataFrame, path: str, model: bytes, end_id: int = 0, stripe_mb: int = 16) -> None:
    """Writes doc_id, local_start (ids before it in its file), n_tokens and ids of every document to ORC files under ``path``.

    Texts move to their range unless they lie in order already. Should a scan deal rows otherwise than the one that was looked at, the tasks
    notice, and all is written again by range.
    """
    if in_order(docs):
        try:
            return _write(docs, path, model, end_id, stripe_mb, True)
        except Exception as e:  # noqa: BLE001  Spark wraps what a task raises
            if OTHERWISE not in str(e):
                raise
    _write(docs, path, model, end_id, stripe_mb, False)


#: What a task says whose rows aren't in order after all.
OTHERWISE = "rows came in another order than before"


def _write(docs: DataFrame, path: str, model: bytes, end_id: int, stripe_mb: int, ordered: bool) -> None:
    spark = common.ship(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))

    def encode(batches):
        enc, start, last = Encoder.get(shared.value), 0, None
        gc.disable()  # nothing here is cyclic, and the caches are large
        for b in batches:
            ids, texts = b.column(0), b.column(1)
            if ordered and b.num_rows:
                v = ids.to_numpy(zero_copy_only=False)
                if ids.null_count or not ((v[1:] > v[:-1]).all() and (last is None or v[0] > last)):
                    raise ValueError(OTHERWISE)
                last = v[-1]
            for i, size in blocks.slices(texts):
                offsets, tokens = enc.encode(texts.slice(i, size), end_id)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, size), pa.array(start + offsets[:-1]), pa.array(np.diff(offsets)), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(tokens.view(np.int32)))],
                    ["doc_id", "local_start", "n_tokens", "ids"],
                )
                start += int(offsets[-1])

    if not ordered:
        rows = rows.repartitionByRange(common.partitions_for(docs), "doc_id").sortWithinPartitions("doc_id", "text")
    (
        rows.mapInArrow(encode, "doc_id long, local_start long, n_tokens long, ids array<int>")
        .write.mode("overwrite")
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", "2000")
        .option("orc.stripe.size", str(stripe_mb << 20))
        .option("compression", "lz4")
        .orc(path)
    )


#: Files (a row of some 100 bytes each) whose starts are broadcast; those of more are joined as any table is.
MOST_FILES = 100_000


def read(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows with ``start``, the ids of all documents before; a filter on doc_id skips stripes.

    ``write`` makes a file for each range it deals or, of ordered input, for each partition that is read.
    """
    rows = spark.read.schema("doc_id long, local_start long, n_tokens long, ids array<int>").orc(path)
    n_files = len(rows.inputFiles())
    rows = rows.withColumn("_file", F.col("_metadata.file_path"))
    before = starts(rows)
    return rows.join(F.broadcast(before) if n_files <= MOST_FILES else before, F.col("_file") == F.col("_of"), "left").select("doc_id", (F.col("_before") + F.col("local_start")).alias("start"), "n_tokens", "ids")


def starts(rows: DataFrame) -> DataFrame:
    """For every file (a row each, so the one window task reads no more rows than there are files) the ids in files before it."""
    files = rows.groupBy(F.col("_file").alias("_of")).agg(F.sum("n_tokens").alias("_n"), F.min(F.struct(F.col("doc_id"), F.col("_file"))).alias("_first"))
    before = Window.orderBy("_first").rowsBetween(Window.unboundedPreceding, -1)
    return files.select("_of", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))


def checksums(rows: DataFrame) -> DataFrame:
    """ids replaced by ids_crc32, the unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""

    def crc(batches):
        for b in batches:
            ids = b.column(b.schema.get_field_index("ids"))
            offsets, values = ids.offsets.to_numpy(), ids.values.to_numpy().astype("<u4", copy=False)
            sums = [zlib.crc32(values[i:j].tobytes()) for i, j in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in range(3)], pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    common.ship(rows.sparkSession)
    return rows.select("doc_id", "start", "n_tokens", "ids").mapInArrow(crc, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op3_token_orc(spark: SparkSession, sf_dir: str, model_file: str = common.tokenizer("byte_bpe_50k.json")) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files read back."""
    with open(model_file, "rb") as f:
        model = f.read()
    write(common.table(spark, sf_dir, "documents"), path := common.new_path(spark, "tokens"), model)
    return checksums(read(spark, path))
