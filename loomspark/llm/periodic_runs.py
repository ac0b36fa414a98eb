r"""Periodic runs of words by Lyndon arrays over an ordered alphabet, and texts without their repetitions.

A run is a maximal stretch of words with smallest period q that is at least 2 * q long. Every run holds a longest Lyndon word
of length q for one of two opposite orders of the alphabet, and that word's next smaller suffix starts q words later. So
for both orders ``edges`` scans a text from left to right with a stack, which gives each suffix's next smaller one and
how far the two match. Comparisons never start over: a match goes on from where the stack's next candidate is known to
match, and within the farthest match so far (which copies an earlier stretch) the pair is looked up at its earlier
place, or goes on from that match's end. So each comparison of equal words moves the farthest end, and the scan is linear
in the words; it compares words, nothing else: no suffix structure, no fingerprints. What matches to the left of a run's first
Lyndon word is shorter than its period and is measured directly.

Words become numbers in order (their bytes up to seven, ranks beyond). Texts in which no two compared suffixes match for
``SHALLOW`` words (most, in prose) are scanned together in numpy, by pointers to the next candidate that jump over what
is known to be larger; that gives the same edges, and any text that goes deeper, or takes too many jumps, is scanned by ``edges``.

Defined results: a null or empty text has no words, no runs and collapses to an empty text; a text of one word repeated
is one run of period 1; runs ascend by start, then period; rows that repeat are each scanned; an empty table gives no rows;
other columns pass by, but for those of the names ``runs`` and ``collapsed``, which are replaced. Texts of any length are
scanned whole, in memory of a few numbers a word.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Runs of fewer words aren't reported.
LEAST = 12
#: Suffixes that match so far are left to the linear scan, and so are texts with more jumps than these.
SHALLOW, JUMPS = 24, 64
#: Bytes of texts that are scanned together.
TOGETHER = 2 << 20
_WORD = "[^\\x20\\x09-\\x0D]+"


def edges(w: list[int], n: int) -> tuple[list[int], list[int]]:
    """next: for each suffix of ``w[:n]`` the start of the next smaller one (n: none); right: how many words the two share. w[n] is less than all."""
    smaller, right = [n] * n, [0] * n  # next smaller suffix
    before, left = [-1] * n, [0] * n  # previous smaller suffix
    stack: list[int] = []
    y = end = shift = 0  # w[y:end] equals w[y - shift : end - shift], and no match has come farther than end
    for j in range(n):
        same = 0
        while stack:
            i = stack[-1]
            go_on = True
            if j + same < end:  # the pair lies in a copy
                jj = j - shift
                if i >= y:
                    ii = i - shift
                    if smaller[ii] == jj and jj + right[ii] < end - shift:
                        same, go_on = right[ii], False
                    elif before[jj] == ii and jj + left[jj] < end - shift:
                        same, go_on = left[jj], False
                    else:
                        same = end - j
                elif before[jj] == i and jj + left[jj] < end - shift:
                    same, go_on = left[jj], False
                else:
                    same = end - j
            if go_on:
                a, b = i + same, j + same
                while w[a] == w[b]:
                    a += 1
                    b += 1
                same = b - j
                if b > end:
                    y, end, shift = j, b, j - i
            if w[j + same] > w[i + same]:
                before[j], left[j] = i, same
                break
            # suffix j is smaller than i, and than those below with which i shares more than with j
            stack.pop()
            smaller[i], right[i] = j, same
            while stack and left[i] > same:
                i = stack.pop()
                smaller[i], right[i] = j, same
            if stack and left[i] < same:
                before[j], left[j] = stack[-1], left[i]
                break
        stack.append(j)
    return smaller, right


def runs_of(words: list[int], least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of at least ``least`` numbers, by start and period."""
    n, top = len(words), max(words, default=0)
    found = set()
    for w in (words, [top - x for x in words]):
        w = [*w, -1]
        smaller, right = edges(w, n)
        for i in range(n):
            r = right[i]
            if r:
                j = smaller[i]
                p = j - i
                if i >= p and smaller[i - p] == i and right[i - p] >= p:
                    continue  # an earlier Lyndon word of the same run
                a, b = i - 1, j - 1
                while a >= 0 and w[a] == w[b]:
                    a -= 1
                    b -= 1
                k = i - 1 - a
                if k + r >= p and k + r + p >= least:
                    found.add((i - k, k + r + p, p))
    return sorted(found, key=lambda x: (x[0], x[2]))


def numbers(words: list[bytes], lengths: np.ndarray) -> np.ndarray:
    """A number above zero for each word, equal only for equal words: bytes up to seven, else a rank among the longer ones, told apart by the last byte."""
    raw = b"".join(words)
    starts = np.cumsum(lengths) - lengths
    eight = np.ndarray((len(raw) + 1,), ">u8", raw + bytes(8), strides=(1,))
    cut = (8 - np.minimum(lengths, 7)).astype(np.uint64) * np.uint64(8)
    out = (eight[starts].astype(np.uint64) >> cut) << cut
    odd = lengths > 16
    if b"\0" in raw:
        odd |= np.fromiter((b"\0" in x for x in words), bool, len(words))
    middle = np.flatnonzero((lengths > 7) & ~odd)
    if len(middle):
        rest = lengths[middle] - 8
        cut = (8 - np.maximum(rest, 1)).astype(np.uint64) * np.uint64(8)
        high = eight[starts[middle]].astype(np.uint64)
        low = np.where(rest > 0, (eight[starts[middle] + 8].astype(np.uint64) >> cut) << cut, np.uint64(0))
        order = np.lexsort((low, high))
        new = np.ones(len(middle), np.uint64)
        new[1:] = (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])
        out[middle[order]] = (np.cumsum(new, dtype=np.uint64) << np.uint64(8)) | np.uint64(1)
    rank, last = 0, None
    for i in sorted(np.flatnonzero(odd).tolist(), key=words.__getitem__):
        rank, last = rank + (words[i] != last), words[i]
        out[i] = rank << 8 | 2
    return out


def _shallow_edges(w: np.ndarray, doc: np.ndarray, deep: np.ndarray) -> np.ndarray:
    """Each word's next smaller suffix, for all texts at once; marks those in ``deep`` that it leaves to ``edges``."""
    to = np.arange(1, len(w) + 1, dtype=np.int32)
    active = np.flatnonzero((w != 0) & ~deep[doc]).astype(np.int32)
    for _ in range(JUMPS):
        if not len(active):
            return to
        at = to[active]
        mine, other = w[active], w[at]
        less = other < mine
        tied = np.flatnonzero(other == mine)
        if len(tied):
            a, b = active[tied], at[tied]
            for k in range(1, SHALLOW):
                va, vb = w[a + k], w[b + k]
                less[tied[vb < va]] = True
                again = np.flatnonzero(va == vb)
                if not len(again):
                    break
                tied, a, b = tied[again], a[again], b[again]
            else:
                deep[doc[a]] = True
        over = ~less
        active, at = active[over], at[over]
        to[active] = to[at]  # all between are larger than the suffix that is larger itself
        if len(tied) and deep[doc[active]].any():
            active = active[~deep[doc[active]]]
    deep[doc[active]] = True
    return to


def _same(w: np.ndarray, a: np.ndarray, b: np.ndarray, step: int) -> np.ndarray:
    """Words that a and b share from there on, by ``step``, up to SHALLOW."""
    out = np.zeros(len(a), np.int32)
    on = np.arange(len(a))
    for k in range(SHALLOW):
        on = on[w[a[on] + step * k] == w[b[on] + step * k]]
        if not len(on):
            break
        out[on] = k + 1
    return out


def runs_of_texts(texts: list[list[bytes]], least: int = LEAST) -> list[list[tuple[int, int, int]]]:
    """The runs of each text's words."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    words = [x for t in texts for x in t]
    ids = numbers(words, np.fromiter(map(len, words), np.int64, len(words))) if words else np.zeros(0, np.uint64)
    # before each text and after the last there is a zero
    first = np.cumsum(sizes + 1) - sizes
    doc = np.append(np.repeat(np.arange(len(texts), dtype=np.int32), sizes + 1), np.int32(len(texts) - 1))
    w = np.zeros(len(ids) + len(texts) + 1, np.uint64)
    w[np.arange(len(ids)) + np.repeat(np.arange(1, len(texts) + 1), sizes)] = ids
    deep, found = np.zeros(len(texts), bool), []
    for v in (w, np.where(w > 0, ~w, w)):
        to = _shallow_edges(v, doc, deep)
        i = np.flatnonzero((v != 0) & ~deep[doc])
        i = i[v[i] == v[to[i]]]
        j = to[i]
        r, k, p = _same(v, i, j, 1), _same(v, i - 1, j - 1, -1), j - i
        deep[doc[i[(k >= SHALLOW) | (r >= SHALLOW)]]] = True
        hit = np.flatnonzero((k + r >= p) & (k + r + p >= least))
        found += zip(doc[i[hit]].tolist(), (i[hit] - k[hit]).tolist(), (k + r + p)[hit].tolist(), p[hit].tolist(), strict=True)
    out: list = [set() for _ in texts]
    for d, start, length, period in found:
        if not deep[d]:
            out[d].add((start - int(first[d]), length, period))
    ends = np.cumsum(sizes)
    for d in np.flatnonzero(deep):
        out[d] = runs_of(np.unique(ids[ends[d] - sizes[d] : ends[d]], return_inverse=True)[1].tolist(), least)
    return [sorted(x, key=lambda r: (r[0], r[2])) for x in out]


def kept(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    depth = [0] * (len(words) + 1)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return [x for x, d in zip(words, accumulate(depth)) if not d]


def collapsed(docs: DataFrame, text: str = "text", least: int = LEAST) -> DataFrame:
    """``docs`` with runs (array of start, length, period, in words) and collapsed (the kept words, joined by one space)."""
    common.ship(docs.sparkSession)
    schema, stay = common.with_fields(docs, set(), "runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")
    at = docs.columns.index(text)
    run_type = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def run(batches):
        for b in batches:
            for lo, hi in _portions(b.column(at)):
                part = b.slice(lo, hi - lo)
                texts = [common.spaced_words(x, lower=False) for x in part.column(at).to_pylist()]
                runs = runs_of_texts(texts, least)
                told = pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in x] for x in runs], run_type)
                left = pa.array([b" ".join(kept(t, r)) for t, r in zip(texts, runs, strict=True)], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in stay), told, left], names=schema.names)

    return docs.mapInArrow(common.tidy(run), schema)


def _portions(texts: pa.Array):
    """Ranges of rows whose texts have TOGETHER bytes, one row at least."""
    lo = size = 0
    for i, x in enumerate(texts):
        size += len(x.as_buffer()) if x.is_valid else 0
        if size >= TOGETHER:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def planted(text: Column, doc_id: Column) -> Column:
    """The text of rows whose crc32(doc_id) ends with 0: from one word on, the words of one period again and again."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))
    n = F.size(words)
    a = g % n
    p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
    # the words are split once, as the argument of a function over an array of one
    again = F.element_at(
        F.transform(
            F.array(F.struct(words.alias("w"), a.cast("int").alias("a"), p.cast("int").alias("p"))),
            lambda x: F.array_join(F.transform(x["w"], lambda w, i: F.when(i < x["a"], w).otherwise(F.get(x["w"], x["a"] + (i - x["a"]) % x["p"]))), " "),
        ),
        1,
    )
    return F.when((h % 10 == 0) & F.regexp_like(text, F.lit(_WORD)), again).otherwise(text)


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = collapsed(docs.select("doc_id", planted(F.col("text"), F.col("doc_id")).alias("text")).select("doc_id", "text"))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    told = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    return out.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.floor(F.col("best.length") * 1000 / -F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(told, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
