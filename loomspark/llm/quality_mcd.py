"""Quality rules by robust multivariate outliers.

Statistics of each text (words, characters, symbols, repeated lines and words) become a vector of ``FEATURES`` on scales
where ordinary text is about normal. For each language and source a minimum-covariance-determinant estimate is made over
all its documents: from the median and the median absolute deviations, concentration steps take the ``SUPPORT`` share of
documents nearest by Mahalanobis distance and compute mean and covariance of these, ``STEPS`` times. (Plain steps never
raise the determinant; here floors and the mixing below change the estimate after each, so that isn't promised.) The covariance is scaled so that the median distance is that of a normal distribution, and texts beyond
``CUTOFF`` are rejected.

Every step is two grouped aggregations with partial sums (a quantile sketch and moments) over a small table of vectors,
so one source may hold most rows. Small groups lean on larger ones: moments are mixed with those of the language and of
all documents as if these were ``PRIOR`` documents. ``FLOOR`` is the least standard deviation of each feature, well below
its range over the root of ``CUTOFF``, so each feature can reject by itself, but where it never varies a trace of it
doesn't.

Groups' parameters reach the rows by broadcast while there are at most ``MOST_GROUPS`` groups; beyond that by a join on
the group and a salt, with the parameters repeated for each of ``SALTS`` salts.

Defined results: texts without words (null, empty) fail the base rules; failed texts are no part of the estimates; null
language or source is a group of its own; repeated rows count as often as they occur; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

FEATURES = ("x0", "x1", "x2", "x3", "x4")
FLOOR = (0.8, 0.08, 0.6, 0.2, 0.02)
SUPPORT = 0.75
STEPS = 4
PRIOR = 60.0
#: Squared distance; of five normal variables about one in 10^5 lies beyond 30.
CUTOFF = 30.0
MEDIAN_CHI2 = 4.351
MOST_GROUPS = 10_000
SALTS = 64
MIN_WORDS = 20
WINDOW = 8
_SYMBOLS = b"#*$%&|<>"


def repeated_words(words: list[bytes], n: int = WINDOW) -> int:
    """Words in ``n``-word windows that the text has twice or more, the first included."""
    if len(words) <= n:
        return 0
    number = dict.fromkeys(words)
    if len(number) == len(words):
        return 0
    number = dict(zip(number, range(len(number)), strict=True))
    ids = np.fromiter(map(number.__getitem__, words), np.uint64, len(words))
    m = len(ids) - n + 1
    h = np.zeros(m, np.uint64)
    for i in range(n):
        h = (h ^ (ids[i : i + m] + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    order = np.argsort(h, kind="stable")
    equal = h[order][1:] == h[order][:-1]
    if not equal.any():
        return 0
    # equal hashes are confirmed word by word
    a, b = order[:-1][equal], order[1:][equal]
    same = np.ones(len(a), bool)
    for i in range(n):
        same &= ids[a + i] == ids[b + i]
    twice = np.zeros(m, bool)
    if same.all():
        twice[a] = twice[b] = True
    else:
        seen: dict[bytes, int] = {}
        for i in range(m):
            j = seen.setdefault(ids[i : i + n].tobytes(), i)
            if j != i:
                twice[i] = twice[j] = True
    change = np.zeros(len(ids) + 1, np.int64)
    np.add.at(change, np.flatnonzero(twice), 1)
    np.add.at(change, np.flatnonzero(twice) + n, -1)
    return int((np.cumsum(change) > 0).sum())


def statistics(text: str | None) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the number of lines with a word."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    blanks = len(raw) - len(raw.translate(None, b" \t\n\x0b\x0c\r"))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return len(words), len(text) - blanks, len(raw) - len(raw.translate(None, _SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words), len(lines)


def vector(s: np.ndarray) -> np.ndarray:
    """Rows of ``statistics`` as features: log length, log characters a word, and shares of symbols, repeated lines and words."""
    n, chars, symbols, dup, repeat, lines = s.T.astype(np.float64)
    n1 = np.maximum(n, 1)
    return np.column_stack([np.log1p(n), np.log(np.maximum(chars, 1) / n1), np.arcsinh(100 * symbols / np.maximum(chars, 1)), np.arcsinh(10 * dup / np.maximum(lines, 1)), repeat / n1])


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the statistics, base_failed and the features of docs (doc_id, lang, source, text)."""
    common.ship(docs.sparkSession)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                s = np.asarray([statistics(t) for t in part.column(3).to_pylist()], np.int64).reshape(-1, 6)
                x = vector(s)
                failed = (s[:, 0] < MIN_WORDS) | (100 * s[:, 4] > 30 * s[:, 0])
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in range(3)], *[pa.array(s[:, k]) for k in range(5)], pa.array(failed), *[pa.array(x[:, k]) for k in range(5)]], ["doc_id", "lang", "source", *names, "base_failed", *FEATURES])

    rows = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("text").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, lang string, source string, {', '.join(f'{n} long' for n in names)}, base_failed boolean, {', '.join(f'{f} double' for f in FEATURES)}")


PAIRS = [(i, j) for i in range(5) for j in range(i, 5)]
KEYS = ["lang", "source"]


def joined(rows: DataFrame, params: DataFrame) -> DataFrame:
    """rows with their group's parameters."""
    few = params.count() <= MOST_GROUPS
    renamed = params.withColumnsRenamed({k: f"_{k}" for k in KEYS})
    on = rows["lang"].eqNullSafe(renamed["_lang"]) & rows["source"].eqNullSafe(renamed["_source"])
    if few:
        return rows.join(F.broadcast(renamed), on).drop("_lang", "_source")
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id", *FEATURES), F.lit(SALTS)))
    renamed = renamed.withColumn("_s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    on = rows["lang"].eqNullSafe(renamed["_lang"]) & rows["source"].eqNullSafe(renamed["_source"]) & (rows["_salt"] == renamed["_s"])
    return rows.join(renamed, on).drop("_lang", "_source", "_salt", "_s")


def distance():
    """Squared Mahalanobis distance from the columns m0.. (mean) and p00.. (inverse covariance)."""
    d = [F.col(f) - F.col(f"m{i}") for i, f in enumerate(FEATURES)]
    terms = [F.col(f"p{i}{j}") * d[i] * d[j] * (1 if i == j else 2) for i, j in PAIRS]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def _params(found: DataFrame, spread) -> DataFrame:
    """lang, source, m0.., p00.. from rows (lang, source, ...); ``spread`` makes (mean, covariance) of a pandas row."""
    names = [*[f"m{i}" for i in range(5)], *[f"p{i}{j}" for i, j in PAIRS]]

    def run(frames):
        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                mean, cov = spread(r)
                cov = cov + np.diag([max(0.0, s * s - c) for s, c in zip(FLOOR, np.diag(cov), strict=True)])
                inv = np.linalg.inv(cov)
                out.append([r.lang, r.source, *mean, *[inv[i, j] for i, j in PAIRS]])
            yield f.__class__(out, columns=["lang", "source", *names])

    return found.mapInPandas(run, f"lang string, source string, {', '.join(f'{n} double' for n in names)}")


def first_params(rows: DataFrame, n_rows: int) -> DataFrame:
    """Medians and median absolute deviations of each group."""
    medians = rows.groupBy(*KEYS).agg(*[F.percentile_approx(f, 0.5, 2000).alias(f"m{i}") for i, f in enumerate(FEATURES)])
    medians = common.saved(few(medians, n_rows), "medians")
    near = joined(rows, medians)
    mads = near.groupBy(*KEYS).agg(*[F.first(f"m{i}").alias(f"m{i}") for i in range(5)], *[F.percentile_approx(F.abs(F.col(f) - F.col(f"m{i}")), 0.5, 2000).alias(f"d{i}") for i, f in enumerate(FEATURES)])
    return _params(mads, lambda r: (np.array([getattr(r, f"m{i}") for i in range(5)]), np.diag([(1.4826 * getattr(r, f"d{i}")) ** 2 for i in range(5)])))


MOMENTS = ["n", *[f"s{i}" for i in range(5)], *[f"q{i}{j}" for i, j in PAIRS]]


def few(groups: DataFrame, n_rows: int) -> DataFrame:
    """A table of groups; there are no more of them than rows."""
    return common.spread(groups, n_rows, 1_000_000)


def step(rows: DataFrame, params: DataFrame, n_rows: int) -> DataFrame:
    """One concentration step: parameters of the nearest documents of each group."""
    near = joined(rows, params).withColumn("d2", distance())
    limits = common.saved(few(near.groupBy(*KEYS).agg(F.percentile_approx("d2", SUPPORT, 5000).alias("limit")), n_rows), "limits")
    core = joined(near.drop(*[c for c in near.columns if c[0] in "mp"]), limits).where("d2 <= limit")
    sums = [F.count(F.lit(1)).cast("double").alias("n"), *[F.sum(f).alias(f"s{i}") for i, f in enumerate(FEATURES)], *[F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"q{i}{j}") for i, j in PAIRS]]
    own = common.saved(few(core.groupBy(*KEYS).agg(*sums), n_rows), "moments")
    add = [F.sum(c).alias(f"l_{c}") for c in MOMENTS]
    langs = own.groupBy(F.col("lang").alias("_lang")).agg(*add)
    every = own.agg(*[F.sum(c).alias(f"a_{c}") for c in MOMENTS]).first()
    total = np.array([every[f"a_{c}"] for c in MOMENTS])
    mixed = own.join(langs, F.col("lang").eqNullSafe(F.col("_lang"))).drop("_lang")

    def spread(r):
        s = np.array([getattr(r, c) for c in MOMENTS])
        lang = np.array([getattr(r, f"l_{c}") for c in MOMENTS])
        s = s + lang * (PRIOR / lang[0]) + total * (PRIOR / 4 / total[0])
        mean = s[1:6] / s[0]
        cov = np.zeros((5, 5))
        for (i, j), q in zip(PAIRS, s[6:], strict=True):
            cov[i, j] = cov[j, i] = q / s[0] - mean[i] * mean[j]
        return mean, cov

    return _params(mixed, spread)


def judged(docs: DataFrame) -> DataFrame:
    """What ``measured`` gives, with d2 (scaled squared distance; null if base_failed) and kept."""
    rows = common.saved(measured(docs), "statistics")
    good = rows.where("not base_failed").select(*KEYS, "doc_id", *FEATURES)
    if good.isEmpty():
        return rows.withColumn("d2", F.lit(None).cast("double")).withColumn("kept", F.lit(False))
    n_rows = rows.count()
    params = common.saved(few(first_params(good, n_rows), n_rows), "params")
    for _ in range(STEPS):
        params = common.saved(few(step(good, params, n_rows), n_rows), "params")
    middle = joined(good, params).withColumn("d2", distance()).groupBy(*KEYS).agg(F.percentile_approx("d2", 0.5, 5000).alias("middle"))
    scale = common.saved(few(middle, n_rows).select(*KEYS, F.greatest(F.lit(1.0), F.col("middle") / MEDIAN_CHI2).alias("scale")), "scales")
    known = params.withColumnsRenamed({k: f"_{k}" for k in KEYS}).join(scale, F.col("_lang").eqNullSafe(F.col("lang")) & F.col("_source").eqNullSafe(F.col("source"))).drop("_lang", "_source")
    failed = rows.where("base_failed").withColumn("d2", F.lit(None).cast("double"))
    passed = joined(rows.where("not base_failed"), common.saved(few(known, n_rows), "params")).withColumn("d2", distance() / F.col("scale")).select(*failed.columns)
    return passed.unionByName(failed).withColumn("kept", F.coalesce(F.col("d2") <= CUTOFF, F.lit(False)))


def op2_quality_mcd(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    return judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "d2")
