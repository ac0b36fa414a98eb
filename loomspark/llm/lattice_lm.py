"""Language-model scores by a subword lattice.

The pieces and scores of an existing vocabulary weight every segmentation of a text: its probability is the sum, over
all ways to spell it with pieces, of the product of the pieces' probabilities, then of an end piece. A forward recursion
in log space gives that sum. No piece of the vocabulary reaches over a word's start, so a text's sum is the product of its
words' sums (a word with a space before it), and each distinct word is summed once, however often it occurs.

The vocabulary's scores are ranks; a piece of rank r starts with a probability in proportion to 1 / (r + ``RANK``). One
pass of expectation maximisation over the distinct words of all learning documents, weighted by their counts, then
re-estimates the probabilities, with the first ones as ``PRIOR`` pseudo-counts, so no piece is impossible. Characters
outside the vocabulary are spelled by byte pieces. Sums need those of the last few places only; a word of over ``BLOCK``
characters is gone through in blocks, forwards and back, with a few numbers kept for each.

Words are counted in the tasks and summed by word. Scores of the ``HEAD`` most frequent words (of at most ``HEAD_BYTES``
bytes, so that the broadcast is bounded) reach the documents by broadcast; the rest by a join on the word, which no
frequent word enters. Words of ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased, and one end a text are the tokens of the base.

Defined results: null and empty texts have the end token alone; null ids aren't held out; repeated rows count as often
as they occur and are returned as often; without learning rows the first probabilities hold and the base has c = N = V =
0; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks, common
from .sentencepiece_stream import MODEL, SPACE, Vocabulary, read_model

FOLDS = 10
RANK = 20.0
PRIOR = 1000.0
HEAD = 200_000
HEAD_BYTES = 64
#: Distinct words that a task counts, and bytes of them, before it passes them on.
FLUSH = 400_000
FLUSH_BYTES = 32 << 20
#: Characters of a word up to which its sums are made in one go; longer ones are made in blocks of as many.
BLOCK = 16_384
LN10 = math.log(10)


class Lattice:
    """Log-space sums over segmentations. ``logs``: log probability of each piece, the byte pieces and the end (last)."""

    def __init__(self, vocabulary: Vocabulary, logs: np.ndarray):
        self.v, self.logs = vocabulary, logs
        self.piece = {p: (float(logs[i]), i) for p, i in vocabulary.id.items()}
        self.log_of = {p: x[0] for p, x in self.piece.items()}
        self.longest = vocabulary.longest
        self.end = float(logs[-1])

    def unknown(self, c: str) -> tuple[float, tuple[int, ...]]:
        """Log probability and ids of the byte pieces of a character outside the vocabulary."""
        ids = tuple(self.v.id_of_byte[b] for b in spelled(c))
        return float(sum(self.logs[i] for i in ids)), ids

    def forward(self, text: str) -> float:
        """Log probability of ``text`` (a word with its space escaped) over all segmentations."""
        if len(text) > BLOCK:
            return self.states(text)[-1][-1]
        get, longest, exp, log = self.log_of.get, self.longest, math.exp, math.log
        alpha = [0.0]
        for end in range(1, len(text) + 1):
            terms = [alpha[start] + p for start in range(end - longest if end > longest else 0, end) if (p := get(text[start:end])) is not None]
            if text[end - 1] not in self.piece:
                terms.append(alpha[-1] + self.unknown(text[end - 1])[0])
            if len(terms) == 1:
                alpha.append(terms[0])
            else:
                top = max(terms)
                alpha.append(top + log(sum([exp(t - top) for t in terms])))
        return alpha[-1]

    def extend(self, alpha: list[float], text: str, start: int, stop: int) -> list[float]:
        """``alpha``, the sums of the last places up to ``start``, with those up to ``stop`` appended."""
        get, longest, exp, log = self.log_of.get, self.longest, math.exp, math.log
        base = start + 1 - len(alpha)  # the place of alpha[0]
        for end in range(start + 1, stop + 1):
            terms = [alpha[at - base] + p for at in range(end - longest if end - longest > base else base, end) if (p := get(text[at:end])) is not None]
            if text[end - 1] not in self.piece:
                terms.append(alpha[-1] + self.unknown(text[end - 1])[0])
            if len(terms) == 1:
                alpha.append(terms[0])
            else:
                top = max(terms)
                alpha.append(top + log(sum([exp(t - top) for t in terms])))
        return alpha

    def states(self, text: str) -> list[list[float]]:
        """The sums of the ``longest`` places before each block of ``BLOCK`` characters and, last, before the end.

        No piece reaches over more places, so these are all that the next block needs, and a word of any length takes a
        few numbers a block.
        """
        out, alpha = [[0.0]], [0.0]
        for start in range(0, len(text), BLOCK):
            alpha = self.extend(list(alpha), text, start, min(start + BLOCK, len(text)))[-self.longest :]
            out.append(alpha)
        return out

    def expect(self, text: str, weight: float, into: list[float]) -> None:
        """Adds the expected number of each piece in ``text``, times ``weight``."""
        if len(text) > BLOCK:
            states = self.states(text)
            total, beta = states[-1][-1], [0.0]
            for k in range(len(states) - 2, -1, -1):
                start, stop = k * BLOCK, min((k + 1) * BLOCK, len(text))
                beta = self.back(text, start, stop, self.extend(list(states[k]), text, start, stop), beta, total, weight, into)
            return
        get, longest, exp, log = self.piece.get, self.longest, math.exp, math.log
        alpha, arcs = [0.0], []
        for end in range(1, len(text) + 1):
            terms = []
            for start in range(end - longest if end > longest else 0, end):
                if (p := get(text[start:end])) is not None:
                    t = alpha[start] + p[0]
                    terms.append(t)
                    arcs.append((start, end, t, p[0], p[1]))
            if text[end - 1] not in self.piece:
                p, ids = self.unknown(text[end - 1])
                t = alpha[-1] + p
                terms.append(t)
                arcs.append((end - 1, end, t, p, ids))
            if len(terms) == 1:
                alpha.append(terms[0])
            else:
                top = max(terms)
                alpha.append(top + log(sum([exp(t - top) for t in terms])))
        beta: list[float | None] = [None] * len(alpha)
        beta[-1] = 0.0
        total = alpha[-1]
        for start, end, t, p, piece in reversed(arcs):  # all arcs from a place come before those to it
            b = beta[end]
            if b is None:
                continue
            q = weight * exp(t + b - total)
            if piece.__class__ is int:
                into[piece] += q
            else:
                for i in piece:
                    into[i] += q
            x, old = p + b, beta[start]
            if old is None:
                beta[start] = x
            else:
                d = x - old
                beta[start] = x + log(1 + exp(-d)) if d > 0 else old + log(1 + exp(d))

    def back(self, text: str, start: int, stop: int, alpha: list[float], beta: list[float | None], total: float, weight: float, into: list[float]) -> list[float | None]:
        """One block of the recursion from the end: all pieces that end in it are counted.

        ``alpha`` ends at ``stop``; ``beta`` are the sums behind of places up to ``stop``, complete at ``stop``. Returned are those
        up to ``start``, to which only pieces that end in the block have contributed yet.
        """
        get, longest, exp, log = self.piece.get, self.longest, math.exp, math.log
        base = stop + 1 - len(alpha)
        own: list[float | None] = [None] * (stop + 1 - base)
        own[len(own) - min(len(beta), len(own)) :] = beta[-len(own) :]
        for end in range(stop, start, -1):
            b = own[end - base]
            if b is None:
                continue
            arcs = [(at, p[0], p[1]) for at in range(end - longest if end - longest > base else base, end) if (p := get(text[at:end])) is not None]
            if text[end - 1] not in self.piece:
                arcs.append((end - 1, *self.unknown(text[end - 1])))
            for at, p, piece in arcs:
                x = p + b
                q = weight * exp(alpha[at - base] + x - total)
                if piece.__class__ is int:
                    into[piece] += q
                else:
                    for i in piece:
                        into[i] += q
                old = own[at - base]
                if old is None:
                    own[at - base] = x
                else:
                    d = x - old
                    own[at - base] = x + log(1 + exp(-d)) if d > 0 else old + log(1 + exp(d))
        return own[: start + 1 - base]


#: Stands for a literal U+2581, which is no word start; a noncharacter, in no vocabulary.
LITERAL = "\ufdd0"


def escaped(word: bytes) -> str:
    """The word as the lattice spells it."""
    return SPACE + word.decode("utf-8", "surrogatepass").replace(SPACE, LITERAL)


def spelled(c: str) -> bytes:
    """The bytes of a character outside the vocabulary."""
    return (SPACE if c == LITERAL else c).encode("utf-8", "surrogatepass")


def first_logs(v: Vocabulary) -> np.ndarray:
    """Log probabilities from the existing scores' ranks; byte pieces share the last rank, the end has the first."""
    p = np.zeros(v.size + 1)
    for piece, i in v.id.items():
        p[i] = 1.0 / (min(-v.score[piece], float(v.size)) + RANK)
    p[list(v.byte_id)] = 1.0 / (v.size + RANK)
    p[-1] = 1.0 / RANK
    with np.errstate(divide="ignore"):
        return np.log(p / p.sum())


def coded_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of a block of texts (binary; perhaps an empty one, which is no word), and for each word of the block its
    number among these and that of its text. A-Z are lower-cased; Arrow's ASCII white space is ``[\\x20\\x09-\\x0D]``."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    sizes = np.diff(lists.offsets.to_numpy())
    coded = lists.flatten().dictionary_encode()
    return coded.dictionary.cast(pa.binary()), coded.indices.to_numpy().astype(np.int64), np.repeat(np.arange(len(texts)), sizes)


def word_counts(docs: DataFrame) -> DataFrame:
    """word (binary), c (occurrences in learning documents, 0 for words of held-out ones only) of docs (held_out, text)."""

    def count(batches):
        seen: dict[bytes, int] = {}
        size_of = 0

        def flush():
            words, counts = list(seen), np.fromiter(seen.values(), np.int64, len(seen))
            step = 20_000 if size_of <= FLUSH_BYTES else 1_000
            for i in range(0, len(words), step):
                yield pa.RecordBatch.from_arrays([pa.array(words[i : i + step], pa.binary()), pa.array(counts[i : i + step])], ["word", "n"])
            seen.clear()

        for b in batches:
            learned = ~b.column(0).to_numpy(zero_copy_only=False)
            for i, size in blocks.slices(b.column(1)):
                distinct, index, owner = coded_words(b.column(1).slice(i, size))
                counts = np.bincount(index, learned[i : i + size][owner], len(distinct)).astype(np.int64)
                for x, c in zip(distinct.to_pylist(), counts.tolist(), strict=True):
                    if x:
                        seen[x] = seen.get(x, 0) + c
                size_of += distinct.nbytes
                if len(seen) > FLUSH or size_of > 8 * FLUSH_BYTES:
                    yield from flush()
                    size_of = 0
        yield from flush()

    return docs.select("held_out", "text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


def learned_logs(words: DataFrame, n_docs: int, model: bytes, rounds: int = 1) -> np.ndarray:
    """Log probabilities of the pieces after ``rounds`` of expectation maximisation over words (word, c)."""
    spark = words.sparkSession
    logs = first_logs(Vocabulary.get(model))
    first = np.exp(logs)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((model, logs))

        def expect(batches, shared=shared):
            model, logs = shared.value
            lattice = Lattice(Vocabulary.get(model), logs)
            got = [0.0] * len(logs)
            for b in batches:
                for word, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    lattice.expect(escaped(word), c, got)
            at = np.flatnonzero(got)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.asarray(got)[at])], ["piece", "n"])

        # at most one row for each piece of the vocabulary reaches the driver
        got = words.where("c > 0").select("word", "c").mapInArrow(expect, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
        n = first * PRIOR
        for r in got:
            n[r["piece"]] += r["n"]
        n[-1] += n_docs
        with np.errstate(divide="ignore"):
            logs = np.log(n / n.sum())
    return logs


def with_log10(words: DataFrame, model: bytes, logs: np.ndarray) -> DataFrame:
    """words (word, c) with lp, the log10 probability of the word."""
    shared = words.sparkSession.sparkContext.broadcast((model, logs))

    def run(batches):
        model, logs = shared.value
        lattice = Lattice(Vocabulary.get(model), logs)
        for b in batches:
            lp = [lattice.forward(escaped(w)) / LN10 for w in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lp, pa.float64())], ["word", "c", "lp"])

    return words.select("word", "c").mapInArrow(run, "word binary, c long, lp double")


def frequent(table: DataFrame, head: int) -> list:
    """The most frequent words, at most ``head``: all above a count that a histogram of at most 512 bins gives."""
    short = table.where((F.octet_length("word") <= HEAD_BYTES) & (F.col("c") > 0)).withColumn("bin", F.floor(F.log2("c") * 8).cast("int"))
    least, room = None, head
    for r in sorted(short.groupBy("bin").count().collect(), reverse=True):
        room -= r["count"]
        if room < 0:
            break
        least = r["bin"]
    return [] if least is None else short.where(F.col("bin") >= least).select("word", "c", "lp").collect()


def scores(docs: DataFrame, model: bytes, mod: int = FOLDS, head: int = HEAD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of docs (doc_id, text)."""
    spark = common.ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id"), common.held_out(F.col("doc_id"), mod).alias("held_out"), F.col("text").alias("text"))
    words = common.saved(word_counts(rows), "words")
    n_docs = rows.where("not held_out").count()
    total = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.coalesce(F.sum((F.col("c") > 0).cast("long")), F.lit(0)).alias("v")).first()
    n, v = int(total["n"]) + n_docs, int(total["v"]) + (n_docs > 0)
    logs = learned_logs(words, n_docs, model)
    table = common.saved(with_log10(words, model, logs), "word-scores")
    bound = math.log10(n + 0.1 * (v + 1))
    known_end, end_base, end_score = int(n_docs > 0), math.log10(n_docs + 0.1) - bound, float(logs[-1]) / LN10
    top = frequent(table, head)
    shared = spark.sparkContext.broadcast({bytes(r["word"]): i for i, r in enumerate(top)})
    values = spark.sparkContext.broadcast(np.array([(math.log10(r["c"] + 0.1) - bound, r["lp"], r["c"] > 0) for r in top]).reshape(-1, 3))

    def by_head(batches):
        get, of = shared.value.get, values.value
        for b in batches:
            for i, size in blocks.slices(b.column(2)):
                distinct, index, owner = coded_words(b.column(2).slice(i, size))
                words = distinct.to_pylist()
                place = np.fromiter((get(x, -1) for x in words), np.int64, len(words))
                v = np.zeros((len(words), 3))
                v[place >= 0] = of[place[place >= 0]]
                some = np.fromiter(map(bool, words), bool, len(words))
                base, score, known = (np.bincount(owner, v[index, k], size) for k in range(3))
                n_tokens = np.bincount(owner, some[index], size).astype(np.int64) + 1
                rare = ((place < 0) & some)[index]
                pairs, n = np.unique(owner[rare] * np.int64(max(len(words), 1)) + index[rare], return_counts=True)
                which, word = np.divmod(pairs, max(len(words), 1))
                offsets = np.searchsorted(which, np.arange(size + 1)).astype(np.int32)
                items = pa.StructArray.from_arrays([distinct.take(pa.array(word)), pa.array(n.astype(np.int64))], ["word", "n"])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, size), b.column(1).slice(i, size), pa.array(n_tokens), pa.array(known.astype(np.int64) + known_end), pa.array(base + end_base), pa.array(score + end_score), pa.ListArray.from_arrays(pa.array(offsets), items)],
                    ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "tail"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    heads = common.saved(
        rows.mapInArrow(by_head, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double, tail array<struct<word:binary,n:long>>")
        .withColumn("row", F.xxhash64("doc_id", "tail"))
        .withColumn("row2", F.xxhash64("doc_id", "n_tokens", "base_score", "score", F.lit(2))),
        "heads",
    )
    tail = heads.where(F.size("tail") > 0).select("row", "row2", F.size("tail").alias("size"), F.explode("tail").alias("t")).select("row", "row2", "size", "t.word", "t.n")
    joined = tail.join(table, "word")
    # equal rows are summed together: copies of a row bring each of its tail words as often
    copies = F.count(F.lit(1)) / F.first("size")
    sums = joined.groupBy("row", "row2").agg(
        (F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)) / copies).alias("k"),
        (F.sum(F.col("n") * (F.log10(F.col("c") + 0.1) - F.lit(bound))) / copies).alias("b"),
        (F.sum(F.col("n") * F.col("lp")) / copies).alias("s"),
    )
    return heads.drop("tail").join(sums, ["row", "row2"], "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce(F.round("k"), F.lit(0)).cast("long")).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("b", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("s", F.lit(0.0))).alias("score"),
    )


def op9_lattice_lm(spark: SparkSession, sf_dir: str, model_file: str = MODEL) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return scores(docs, read_model(model_file))
