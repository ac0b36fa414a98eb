"""Toxicity by class-conditional Kneser-Ney models.

Two interpolated Kneser-Ney bigram models, of toxic and of ordinary text. Counts are continuation counts: of words the
distinct words before them, of pairs likewise, so that copies of a text, and a text that repeats itself, don't weigh
more. Each order of each class has one absolute discount in (0, 1), n1 / (n1 + 2 n2) of its counts of counts. Pairs back
off to pairs that both classes share, scaled to the class's words (unigram marginals), these to the words of the class,
these to words that both share. All pairs are kept, and every distribution sums to 1 over the words learned and one for
all others.

An expression seen rarely says little of its class even after discounting, so class estimates are smoothed by the shared
ones in cells: of words (and of pairs) with like shared counts and like shares of the class, as much of the class
estimate's excess over the shared one is trusted as the other half of the learning texts bears out. Copies of a text fall
into the same half (by the least hash of those of their word triples that aren't in most texts), and pairs are borne out
by new contexts only, so neither copies nor copied passages bear each other out.

A text is scored by the length-normalised difference of its log-likelihoods under the two models over the ``SPAN``
consecutive words where that is largest (the whole text, if it is shorter), so that a few toxic words in a long text
count. The score is a logistic curve that rises with the difference, fitted on the halves, each scored by the other's
models, with the classes' true shares as weights. Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``, A-Z lower-cased.

The models learn from at most ``PER_CLASS`` labelled documents of each class, those with the smallest hashes of the ids
among documents with text, and of a text of over ``LONGEST`` characters from ``PIECES`` pieces spread over all of it, as
long together; so what reaches the driver and the tasks is bounded. Every text is scored as a whole.

Defined results: texts without words (null, empty) have score 0.0; without two different labelled texts of each class all
have score 0.0; null labels and labels of documents that aren't there aren't learned from; contradicting labels of a
document count as toxic; of rows that repeat an id the least text is learned from; repeated rows are scored one by one;
null ids aren't held out; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

PER_CLASS = 3000
LONGEST = 20_000
PIECES = 8
SPAN = 2
FOLDS = 5
#: Octaves of shared counts that are told apart, and of a class's share in them; then one for counts of 0.
OCTAVES = 6
_CELLS = (OCTAVES + 1) * (OCTAVES + 2)
#: Counts by which a cell's excess is lessened before it is trusted.
DOUBT = 2.0


class Counts:
    """Continuation counts of both classes: words by the distinct words before them, pairs likewise."""

    def __init__(self, texts: list[np.ndarray], toxic: np.ndarray, size: int):
        """``texts``: word numbers below ``size - 2``, which is the start of a text; ``size - 1`` stands for unknown words."""
        self.size, self.start = size, size - 2
        n = size
        made, classes = [np.zeros(0, np.int64)], [np.zeros(0, np.int8)]
        for ids, y in zip(texts, toxic, strict=True):
            made.append(np.unique(triples(ids, n)))
            classes.append(np.full(len(made[-1]), y, np.int8))
        made, classes = np.concatenate(made), np.concatenate(classes)
        #: Of each class, the distinct triples: a word with the two before it.
        self.triples = [np.unique(made[classes == y]) for y in (0, 1)]
        del made, classes
        pairs = [np.unique(k % n**2, return_counts=True) for k in self.triples]
        self.keys = np.union1d(pairs[0][0], pairs[1][0])
        self.pairs = []
        for keys, counts in pairs:
            self.pairs.append(np.zeros(len(self.keys), np.float32))
            self.pairs[-1][np.searchsorted(self.keys, keys)] = counts
        self.before, self.after = (self.keys // n).astype(np.int32), (self.keys % n).astype(np.int32)
        self.words = [np.bincount(self.after[c > 0], minlength=n).astype(np.float64) for c in self.pairs]
        self.shared = np.bincount(self.after, minlength=n).astype(np.float64)

    def borne_out(self, y: int, other: Counts) -> tuple[np.ndarray, np.ndarray]:
        """Counts of these pairs, and of all pairs by their first word, among the triples of class ``y`` that ``other`` has and
        these don't: what was copied from one text to another bears nothing out."""
        n, new = self.size, other.triples[y]
        for own in self.triples:
            if len(own):
                new = new[own[np.minimum(np.searchsorted(own, new), len(own) - 1)] != new]
        new = new % n**2
        keys, counts = np.unique(new, return_counts=True)
        at = np.searchsorted(self.keys, keys)
        known = (at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == keys)
        got = np.zeros(len(self.keys))
        got[at[known]] = counts[known]
        return got, np.bincount(keys // n, counts, n)


def triples(ids: np.ndarray, n: int) -> np.ndarray:
    """A number for each word of a text with the two before it."""
    padded = np.concatenate(([n - 2, n - 2], ids.astype(np.int64)))
    return (padded[:-2] * n + padded[1:-1]) * n + padded[2:]


def discount(counts: np.ndarray) -> float:
    """n1 / (n1 + 2 n2), within (0, 1) where one of them is 0."""
    once, twice = int((counts == 1).sum()), int((counts == 2).sum())
    return min(max(once / max(once + 2 * twice, 1), 0.05), 0.99)


def cells(shared: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The cell of each count: its octave, and how many octaves the class's share lies below."""
    octave = lambda x: np.floor(np.log2(np.maximum(x, 1))).astype(np.int64)
    low = np.where(own > 0, np.minimum(octave(shared) - octave(own), OCTAVES), OCTAVES + 1)
    return (np.minimum(octave(shared), OCTAVES) * (OCTAVES + 2) + low).astype(np.int8)


def trusted(got: np.ndarray, by_shared: np.ndarray, by_own: np.ndarray) -> np.ndarray:
    """By cell, how much of the excess of ``by_own`` over ``by_shared`` (expected counts) is in the counts ``got``, 0 to 1.

    Where less than ``DOUBT`` is expected, the cell of half the counts is asked.
    """
    more = by_own - by_shared
    out = np.clip((got - by_shared) * np.sign(more) / (np.abs(more) + DOUBT), 0, 1)
    for k in range(OCTAVES + 2, _CELLS):
        if abs(more[k]) < DOUBT:
            out[k] = out[k - OCTAVES - 2]
    return out


#: The cell of what one class has never and both hardly ever; what both have never is trusted likewise.
_UNSEEN = OCTAVES + 1


class ClassModels:
    """Both classes' distributions; ``word``, ``context`` and ``pair`` hold the log-ratios of toxic to ordinary for look-up."""

    def __init__(self, counts: Counts):
        self.counts = c = counts
        n = c.size
        d = discount(c.shared)
        p = (np.maximum(c.shared - d, 0) + d * (c.shared > 0).sum() / (n - 1)) / max(c.shared.sum(), 1)
        p[c.start] = 0  # no word
        self.shared = p / p.sum() if p.sum() else np.full(n, 1 / n)
        self.own = []
        for words in c.words:
            d, total = discount(words), max(words.sum(), 1)
            top = np.maximum(words - d, 0) / total
            self.own.append(top + (1 - top.sum()) * self.shared)
        both = c.pairs[0] + c.pairs[1]
        self.shared_pairs, self.shared_rest = self._pairs(both)
        self.own_pairs = [self._pairs(x) for x in c.pairs]
        self.word_cells = [cells(c.shared, x) for x in c.words]
        self.pair_cells = [cells(both, x) for x in c.pairs]

    def _pairs(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Discounted share of each pair among those of its first word, and what is left for other words, by first word."""
        c = self.counts
        top = np.maximum(counts.astype(np.float64) - discount(counts), 0) / np.maximum(np.bincount(c.before, counts, c.size)[c.before], 1)
        return top.astype(np.float32), np.clip(1 - np.bincount(c.before, top, c.size), 1e-12, 1)

    def set_words(self, trust: list[np.ndarray]) -> None:
        """P(word) of each class."""
        self.unigram = []
        for y in (0, 1):
            t = trust[y][self.word_cells[y]]
            p = t * self.own[y] + (1 - t) * self.shared
            self.unigram.append(p / p.sum())

    def by_pair(self, y: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """P(word | word before) of all seen pairs by the shared pairs, scaled to the class's words, and by the class's own
        on top; the first's share of the words unseen, by word before."""
        c, p = self.counts, self.unigram[y]
        scaled = self.shared_pairs * p[c.after] / self.shared[c.after]
        total = np.bincount(c.before, scaled, c.size) + self.shared_rest
        shared = (scaled + self.shared_rest[c.before] * p[c.after]) / total[c.before]
        top, rest = self.own_pairs[y]
        return shared, top + rest[c.before] * shared, self.shared_rest / total

    def set_pairs(self, trust: list[np.ndarray]) -> None:
        """P(word | word before) of each class, normalised for each word before; then the log-ratios."""
        c, n = self.counts, self.counts.size
        self.seen, self.rest = [], []
        for y in (0, 1):
            shared, own, rest = self.by_pair(y)
            t = trust[y][self.pair_cells[y]]
            p = t * own + (1 - t) * shared
            u = trust[y][_UNSEEN]
            rest = rest * (u * self.own_pairs[y][1] + 1 - u)
            del shared, own, t
            total = np.bincount(c.before, p, n) + rest * np.maximum(1 - np.bincount(c.before, self.unigram[y][c.after], n), 0)
            p /= total[c.before]
            self.seen.append(p)
            self.rest.append(rest / total)
        least = 1e-300
        self.word = (np.log(np.maximum(self.unigram[1], least)) - np.log(np.maximum(self.unigram[0], least))).astype(np.float32)
        self.context = (np.log(self.rest[1]) - np.log(self.rest[0])).astype(np.float32)
        self.pair = (np.log(np.maximum(self.seen[1], least)) - np.log(np.maximum(self.seen[0], least))).astype(np.float32)

    def probability(self, y: int, before: int, word: int) -> float:
        """P(word | word before) of class ``y``."""
        c = self.counts
        key = before * c.size + word
        at = int(np.searchsorted(c.keys, key))
        if at < len(c.keys) and c.keys[at] == key:
            return float(self.seen[y][at])
        return float(self.rest[y][before] * self.unigram[y][word])

    def lookup(self, number: dict[bytes, int]) -> Lookup:
        return Lookup(self, number)


class Lookup:
    """The log-ratios alone, as the tasks need them: pairs that differ from their backoff, words that differ from unknown ones."""

    def __init__(self, models: ClassModels, number: dict[bytes, int]):
        c = models.counts
        keep = np.abs(models.pair - models.context[c.before] - models.word[c.after]) >= 1e-3
        self.size, self.start = c.size, c.start
        self.word, self.context, self.keys, self.pair = models.word, models.context, c.keys[keep], models.pair[keep]
        same = (np.abs(self.word - self.word[-1]) < 1e-3) & (np.abs(self.context - self.context[-1]) < 1e-3)
        same[c.before[keep]] = same[c.after[keep]] = False
        self.number = {w: i for w, i in number.items() if not same[i]}

    def features(self, texts: list[list[bytes]]) -> np.ndarray:
        """Of each text the largest length-normalised difference of a span."""
        get, unknown = self.number.get, self.size - 1
        sizes = [len(t) for t in texts]
        return self.of_ids(np.fromiter((get(w, unknown) for t in texts for w in t), np.int64, sum(sizes)), sizes)

    def of_ids(self, ids: np.ndarray, sizes: list[int]) -> np.ndarray:
        out = np.zeros((len(sizes), 1))
        ends = np.cumsum(sizes)
        before = np.empty_like(ids)
        before[1:] = ids[:-1]
        before[[e - n for e, n in zip(ends, sizes, strict=True) if n]] = self.start
        ratio = self.context[before] + self.word[ids]
        if len(self.keys) and len(ids):
            want = before * self.size + ids
            at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
            ratio = np.where(self.keys[at] == want, self.pair[at], ratio)
        for i, (e, n) in enumerate(zip(ends, sizes, strict=True)):
            if n:
                total = np.concatenate(([0.0], np.cumsum(ratio[e - n : e], dtype=np.float64)))
                span = min(SPAN, n)
                out[i] = (total[span:] - total[:-span]).max() / span
        return out


def word_trusts(models: list[ClassModels], others: list[Counts]) -> list[np.ndarray]:
    """Trust of words, by class and cell: ``others[k]`` are the counts of texts that ``models[k]`` weren't made of."""
    out = []
    for y in (0, 1):
        sums = np.zeros((3, _CELLS))
        for m, o in zip(models, others, strict=True):
            n = o.words[y].sum()
            sums += [np.bincount(m.word_cells[y], x, _CELLS) for x in (o.words[y], n * m.shared, n * m.own[y])]
        out.append(trusted(*sums))
    return out


def pair_evidence(m: ClassModels, other: Counts) -> np.ndarray:
    """By class, what ``trusted`` takes, of the pairs of one half's models and the other half's counts."""
    out = np.zeros((2, 3, _CELLS))
    for y in (0, 1):
        got, by_first = m.counts.borne_out(y, other)
        before = by_first[m.counts.before]
        shared, own, _ = m.by_pair(y)
        out[y] = [np.bincount(m.pair_cells[y], x, _CELLS) for x in (got, before * shared, before * own)]
    return out


def halves(texts: list[np.ndarray], toxic: np.ndarray, size: int) -> np.ndarray:
    """0 or 1 for each text: of each class, texts with the same least hash of a triple together.

    Triples that over a quarter of the texts have (counted by 20 bits of their hash) are no sign of a copy and are left out.
    """

    def hashes(ids: np.ndarray) -> np.ndarray:
        h = np.unique(triples(ids, size)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))

    bits = np.uint64(44)
    found = np.zeros(1 << 20, np.int32)
    for ids in texts:
        found[np.unique(hashes(ids) >> bits)] += 1
    least = np.zeros(len(texts), np.uint64)
    for i, ids in enumerate(texts):
        h = hashes(ids)
        h = h[4 * found[h >> bits] <= len(texts)]
        least[i] = h.min() if len(h) else np.uint64(i) << np.uint64(40)
    out = np.zeros(len(texts), np.int64)
    for y in (0, 1):
        mine = np.flatnonzero(toxic == y)
        out[mine] = np.unique(least[mine], return_inverse=True)[1] % 2
    return out


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
    """Weighted ridge logistic regression by Newton's method."""
    mean, sd = x.mean(0), x.std(0) + 1e-6
    z = np.column_stack([(x - mean) / sd, np.ones(len(x))])
    b = np.zeros(z.shape[1])
    ridge = np.diag([1e-2] * x.shape[1] + [1e-6]) * len(x) / 100
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        h = (z * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + ridge
        step = np.linalg.solve(h, z.T @ (weight * (y - p)) - ridge @ b)
        b += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-6:
            break
    return {"mean": mean, "sd": sd, "b": b}


def sample(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> tuple[list, dict[int, int]]:
    """(text, toxic) of at most ``per_class`` labelled documents a class, and how many there are of each class."""
    size = F.length("text")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).where((size > 0) & F.col("doc_id").isNotNull())
    own = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    own = common.saved(own.join(texts.select("doc_id"), "doc_id", "left_semi"), "labelled")
    counts = {r["toxic"]: r["count"] for r in own.groupBy("toxic").count().collect()}
    if len(counts) < 2:
        return [], counts
    hashed = own.withColumn("_h", F.xxhash64("doc_id"))
    ids = None
    for y in (0, 1):  # at most 2 * per_class rows in all, so the broadcast is bounded
        part = hashed.where(F.col("toxic") == y).orderBy("_h", "doc_id").limit(per_class)
        ids = part if ids is None else ids.unionByName(part)
    step = LONGEST // PIECES
    pieces = [F.col("text").substr((F.lit(1) + (size - step) * i / (PIECES - 1)).cast("int"), F.lit(step)) for i in range(PIECES)]
    short = F.when(size <= LONGEST, F.col("text")).otherwise(F.concat_ws(" ", *pieces)).alias("text")
    found = texts.join(F.broadcast(ids.select("doc_id", "toxic")), "doc_id").select("doc_id", "toxic", short)
    rows = found.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect()
    first: dict[str, tuple] = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["text"])):
        first.setdefault(r["text"], (r["text"], r["toxic"]))
    return list(first.values()), counts


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> dict | None:
    """Look-up and curve; None without two labelled texts of each class."""
    rows, counts = sample(docs, labels, per_class)
    number: dict[bytes, int] = {}
    texts, y = [], []
    for text, label in rows:  # as numbers: the words themselves would take ten times the memory
        if words := common.folded_words(text):
            texts.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int32, len(words)))
            y.append(label)
    del rows
    y = np.asarray(y)
    if min((y == 0).sum(), (y == 1).sum()) < 2:
        return None
    out = fit(texts, y, number, np.array([counts[0], counts[1]]))
    del texts, number
    common.trim()
    return out


def fit(texts: list[np.ndarray], y: np.ndarray, number: dict[bytes, int], counts: np.ndarray) -> dict:
    """Look-up and curve of texts given as word numbers; ``counts``: documents of each class, learned from or not."""
    common.give_back_arrays()
    size = len(number) + 2
    weight = np.where(y == 1, counts[1] / (y == 1).sum(), counts[0] / (y == 0).sum())
    weight = weight / weight.mean()
    half = halves(texts, y, size)
    parts = [np.flatnonzero(half == k) for k in (0, 1)]
    x = None
    if all(len(set(y[p].tolist())) == 2 for p in parts):
        x = np.zeros((len(y), 1))
        learned = [Counts([texts[i] for i in p], y[p], size) for p in parts]
        words = word_trusts([ClassModels(c) for c in learned], learned[::-1])
        common.trim()
        evidence = np.zeros((2, 3, _CELLS))
        for own, other in (learned, learned[::-1]):  # one half's models at a time
            m = ClassModels(own)
            m.set_words(words)
            evidence += pair_evidence(m, other)
            del m
        pairs = [trusted(*e) for e in evidence]
        for other in parts[::-1]:
            m = ClassModels(learned.pop(0))
            m.counts.triples = []
            m.set_words(words)
            m.set_pairs(pairs)
            lookup = m.lookup({})
            del m
            x[other] = measured(lookup, [texts[i] for i in other])
            common.trim()
        del lookup, own
        common.trim()
    else:  # nothing to bear estimates out: half of each is trusted, and the curve sees texts that were learned from
        words = pairs = [np.full(_CELLS, 0.5)] * 2
    whole = ClassModels(Counts(texts, y, size))
    whole.counts.triples = []
    whole.set_words(words)
    whole.set_pairs(pairs)
    lookup = whole.lookup(number)
    del whole
    if x is None:
        x = measured(lookup, texts)
    return {"models": lookup, "curve": logistic(x, y, weight), "trust": (words, pairs)}


def measured(models: Lookup, texts: list[np.ndarray], block: int = 200) -> np.ndarray:
    """Features of texts given as word numbers."""
    parts = [texts[i : i + block] for i in range(0, len(texts), block)]
    return np.concatenate([models.of_ids(np.concatenate(p).astype(np.int64), [len(t) for t in p]) for p in parts] or [np.zeros((0, 1))])


def chance(x: np.ndarray, c: dict) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip((x - c["mean"]) / c["sd"] @ c["b"][:-1] + c["b"][-1], -60, 60)))


def scored(model: dict | None, texts: list[str | None]) -> np.ndarray:
    out = np.zeros(len(texts))
    words = [common.folded_words(t) for t in texts]
    use = [i for i, w in enumerate(words) if w]
    if model and use:
        out[use] = chance(model["models"].features([words[i] for i in use]), model["curve"])
    return out


def score(docs: DataFrame, model: dict | None, column: str = "score") -> DataFrame:
    """``docs`` with the column ``score`` added, or replaced if there is one."""
    spark = common.ship(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)
    schema, kept = common.with_fields(docs, {column}, f"`{column}` double")
    at = docs.columns.index("text")

    def run(batches):
        model = shared.value
        for b in batches:
            for i in range(0, b.num_rows, 128):
                part = b.slice(i, 128)
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in kept], pa.array(scored(model, part.column(at).to_pylist()))], schema.names)

    return docs.mapInArrow(common.tidy(run), schema)


def learn_rows(labels: DataFrame) -> DataFrame:
    return labels.where(~common.held_out(F.col("doc_id"), FOLDS))


def op6_toxicity_kn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, learn_rows(common.table(spark, sf_dir, "labels").select("doc_id", "toxic")))
    out = score(docs, model)
    return out.select("doc_id", common.held_out(F.col("doc_id"), FOLDS).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, with its columns, that aren't predicted toxic by models learned from ``labels``' rows of the learning folds."""
    model = train(docs, learn_rows(labels))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_in"), F.col("text").alias("text"))
    return score(packed, model).where("score < 0.5").select("_in.*")
