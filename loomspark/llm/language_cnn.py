"""Language identification by a byte convolutional network.

Windows of ``WINDOW`` bytes of a text, one after another to its end, go through filters of several widths over byte
embeddings, a maximum over the window and a softmax. A text's distribution is the mean of its windows' log
probabilities, normalised. The network is trained in numpy on labelled documents of every language there is: at most
``PER_LANG`` of each, those with the smallest hashes of id and text, and at most ``MOST_DOCS`` in all (one of each language at
least), each of which gives at most ``WINDOWS_PER_DOC`` windows spread over its whole text. These are the only bounds:
every byte of every text is scored, and every learned language can be predicted.

A filter of width w is a sum of w rows, one for each byte value. For scoring, rows of neighbouring bytes are added
beforehand into tables of byte pairs, which gives the same sums.

Defined results: null texts, and texts without a letter, are ``und`` with score 0; with no labelled row, all are ``und``;
null ``lang`` labels and null ids never train a fold that is held out; ties go to the first language in order;
repeated rows are predicted one by one; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import blocks, common

WINDOW = 192
WIDTHS = (2, 3, 4)
FILTERS = 8
PER_LANG = 600
WINDOWS_PER_DOC = 6
MOST_DOCS = 30_000
FOLDS = 5


def windows(text: str) -> np.ndarray:
    """All windows of the whole text as rows of byte values; the last is filled up with zeros."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = max(1, -(-len(raw) // WINDOW))
    out = np.zeros(n * WINDOW, np.uint8)
    out[: len(raw)] = raw
    return out.reshape(n, WINDOW)


class ByteCNN:
    """conv(w) -> max over the window -> softmax, with the embedding folded into the filters: ``filters[w]`` is (w, 256, FILTERS)."""

    def __init__(self, langs: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.filters = {w: rng.normal(0, 0.3 / np.sqrt(w), (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS}
        self.out = rng.normal(0, 0.3, (len(WIDTHS) * FILTERS, len(langs))).astype(np.float32)
        self.bias = np.zeros(len(langs), np.float32)

    def forward(self, x: np.ndarray):
        """Largest response of each filter in each window, and where it was."""
        best, at = [], []
        for w in WIDTHS:
            f, n = self.filters[w], WINDOW - w + 1
            sums = f[0][x[:, :n]]
            for j in range(1, w):
                sums = sums + f[j][x[:, j : j + n]]
            top = sums.argmax(1)
            at.append(top)
            best.append(np.take_along_axis(sums, top[:, None], 1)[:, 0])
        return np.concatenate(best, 1), at

    def gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Of the mean cross entropy by filters, output weights and bias; those of a maximum go to the place where it was."""
        best, at = self.forward(x)
        hidden = np.maximum(best, 0)
        p = softmax(hidden @ self.out + self.bias)
        p[np.arange(len(y)), y] -= 1
        p /= len(y)
        back = (p @ self.out.T) * (best > 0)
        grads = []
        for i, w in enumerate(WIDTHS):
            g = np.zeros_like(self.filters[w])
            part = back[:, i * FILTERS : (i + 1) * FILTERS]
            cols = np.broadcast_to(np.arange(FILTERS), part.shape)
            for j in range(w):
                np.add.at(g[j], (np.take_along_axis(x, at[i] + j, 1), cols), part)
            grads.append(g)
        return [*grads, hidden.T @ p, p.sum(0)]

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 14, batch: int = 64, rate: float = 0.01, seed: int = 7) -> ByteCNN:
        """Adam on the cross entropy."""
        rng = np.random.default_rng(seed)
        params = [*self.filters.values(), self.out, self.bias]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(x))
            lr = rate * (0.3 if epoch >= epochs * 2 // 3 else 1)
            for k in range(0, len(x), batch):
                rows = order[k : k + batch]
                step += 1
                for q, g, a, b in zip(params, self.gradients(x[rows], y[rows]), m, v, strict=True):
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    q -= lr * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8) + lr * 1e-4 * q
        return self

    def compiled(self) -> dict:
        """Tables over byte pairs, side by side: width 2, first and last two bytes of widths 3 and 4."""
        f = self.filters
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, FILTERS)
        return {
            "langs": self.langs,
            "first": np.concatenate([pair(f[2][0], f[2][1]), pair(f[3][0], f[3][1]), pair(f[4][0], f[4][1])], 1),
            "third": f[3][2],
            "last": pair(f[4][2], f[4][3]),
            "out": self.out,
            "bias": self.bias,
        }


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def log_probs(model: dict, x: np.ndarray) -> np.ndarray:
    """log probabilities of each window's languages; the same sums as ``forward``."""
    pairs = x[:, :-1].astype(np.uint16) * 256 + x[:, 1:]
    first = np.take(model["first"], pairs, axis=0)
    f = FILTERS
    best = [first[:, :, :f].max(1)]
    best.append((first[:, :-1, f : 2 * f] + np.take(model["third"], x[:, 2:], axis=0)).max(1))
    best.append((first[:, :-2, 2 * f :] + np.take(model["last"], pairs[:, 2:], axis=0)).max(1))
    z = np.maximum(np.concatenate(best, 1), 0) @ model["out"] + model["bias"]
    z -= z.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


def train(docs: DataFrame, per_lang: int = PER_LANG, most: int = MOST_DOCS) -> dict | None:
    """The network for the languages of ``docs`` (doc_id, text, lang), or None without labelled text.

    At most ``per_lang`` documents of each language come to the driver, and ``most`` in all, but one of each.
    """
    rows = docs.where("lang is not null and text is not null and length(text) > 0").select("lang", "text", F.xxhash64("doc_id", "text").alias("_h"))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    counts = common.saved(counts, "languages")
    n_langs = counts.count()
    if not n_langs:
        return None
    each = max(1, min(per_lang, most // n_langs))
    # of each language the share of all hash values that holds somewhat more than is taken
    share = counts.select("lang", F.least(F.lit(1.0), (F.lit(1.2 * each + 20)) / F.col("n")).alias("_share"))
    some = rows.join(F.broadcast(share) if n_langs <= MOST_DOCS else share, "lang").where(F.pmod("_h", F.lit(1 << 30)) < F.col("_share") * (1 << 30))
    # of a long text, only the windows' texts travel
    size, step = F.length("text"), WINDOW * 4 // 5
    spread = [F.col("text").substr((F.lit(1) + (size - step) * i / (WINDOWS_PER_DOC - 1)).cast("int"), F.lit(step)) for i in range(WINDOWS_PER_DOC)]
    pieces = F.when(size <= step * WINDOWS_PER_DOC, F.array("text")).otherwise(F.array(*spread))
    once = some.groupBy("lang", "_h").agg(F.min(pieces).alias("_p"))  # rows that repeat are one
    w = Window.partitionBy("lang").orderBy(F.pmod("_h", F.lit(1 << 30)), "_p")
    got = once.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= each).select("lang", "_h", "_p").collect()
    langs = sorted({r["lang"] for r in got})
    number, x, y = {lang: k for k, lang in enumerate(langs)}, [], []
    for r in sorted(got, key=lambda r: (r["lang"], r["_h"] % (1 << 30), r["_p"])):
        for piece in r["_p"]:
            x.append(windows(piece)[:WINDOWS_PER_DOC])
            y.append(np.full(len(x[-1]), number[r["lang"]]))
    return ByteCNN(langs).fit(np.concatenate(x), np.concatenate(y)).compiled() if x else None


def predict(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of ``docs``."""
    spark = common.ship(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for b in batches:
            for i, size in blocks.slices(b.column(2), 128):
                part = b.column(2).slice(i, size).to_pylist()
                lang, score = ["und"] * len(part), np.zeros(len(part))
                use = [k for k, t in enumerate(part) if t and model and any(map(str.isalpha, t))]
                if use:
                    sums, counts = np.zeros((len(use), len(model["langs"]))), np.zeros(len(use))
                    parts = [windows(part[k]) for k in use]
                    owner = np.repeat(np.arange(len(use)), [len(p) for p in parts])
                    x = np.concatenate(parts)
                    for j in range(0, len(x), 256):
                        np.add.at(sums, owner[j : j + 256], log_probs(model, x[j : j + 256]))
                    np.add.at(counts, owner, 1)
                    p = softmax(sums / counts[:, None])
                    for k, q in zip(use, p, strict=True):
                        lang[k], score[k] = model["langs"][int(q.argmax())], float(q.max())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, len(part)), b.column(1).slice(i, len(part)), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.held_out(F.col("doc_id"), FOLDS).alias("held_out"), F.col("text").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op10_language_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return predict(docs, train(docs.where(~common.held_out(F.col("doc_id"), FOLDS))))
