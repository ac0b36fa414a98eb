"""MinHash near-dedup with bottom-k sketches of one hash function.

Each text's set of word shingles is hashed by one function; the ``K`` smallest values are its sketch. Texts with equal
sets are one class from there on, so copies cost nothing more. Inverted lists of the retained values give overlaps: of
each class only the values that are rarest over all classes are listed, so many that two classes over the threshold share
one of them. Classes are compared through these lists, never as all pairs of a list:

1. Each list's members are compared to one of them, the hub, whose values are the most frequent ones; the share of the
   union's sketch that both have estimates the similarity, and members that are anything like their hub share its scope.
   Lists that still hold several scopes are compared inside a task, from which only pairs that pass the estimate (with
   ``slack`` for its error) and join scopes come out.
2. Within a scope each class's full set is compared to that of the scope's hub, exactly. The result is a link or not, and
   the set's difference from the hub's. Two sets differ from each other just as their differences do, so from here on the
   short differences stand for the sets. A list of a value of them holds few classes, however large the scope: what a
   group's copies share drops out, and what each has changed is its own.
3. Pairs that can be over the threshold must share one of the rarest values of their differences (prefix filter), and what
   follows that value must suffice (position filter). Those that pass both and the sketches' estimate are verified exactly
   on the differences. The components of all confirmed links are the groups.

So rows grow with a group's size and not with its square: one comparison with the hub a class, and pairs only where
classes outside the hub's reach have made like changes. Lists of over ``BLOCK`` members are dealt out as pairs of blocks,
so no task holds one whole. Tables between the steps are written to the shared folder; the full sets of the scopes'
classes are made anew from their texts.

Defined results: texts without words link with nothing, each row is its own component; fewer words than a shingle are
one shingle; a class's id is its smallest ``doc_id``, null if none has one; rows with a null id have no component_id unless they link to one that
has, and aren't kept then; rows that repeat id and text share their result; columns of other names pass by. ``one_each``
keeps null ids that link with nothing, and one row, of the least text hash, of a group without ids.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components

K = 64
#: Standard deviations of a sketch's error that are allowed for.
SIGMAS = 5.5
#: Estimated similarity to a hub from which on a class shares the hub's scope; it decides no link.
SCOPE = 0.3
#: Members of a list, or classes beside one copy of their hub, in a task's block.
BLOCK = 512
#: Up to so many classes (32 bytes each) are broadcast to pick the families' texts; beyond, the texts are joined by shuffle.
MOST_IDS = 500_000
_SIGN = np.uint64(1 << 63)


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Sorted hashes of the distinct ``n``-word shingles, as signed integers in the order of the unsigned ones."""
    words = common.spaced_words(text)
    if not words:
        return np.zeros(0, np.int64)
    number: dict[bytes, int] = dict.fromkeys(words)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, number), np.uint64, len(number))
    number = dict(zip(number, range(len(number)), strict=True))
    h = h[np.fromiter(map(number.__getitem__, words), np.int64, len(words))]
    n = min(n, len(words))
    z = np.full(len(h) - n + 1, np.uint64(n * 0xD6E8FEB86659FD93 % (1 << 64)))
    for i in range(n):
        z = (z ^ h[i : len(h) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        z ^= z >> np.uint64(29)
    z = (z ^ (z >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    return (np.unique(z) ^ _SIGN).view(np.int64)


def signature(values: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(values.tobytes()) if len(values) else None


def digests(docs: DataFrame, n: int, k: int = K) -> DataFrame:
    """doc_id, th (hash of the text), n_shingles, sig (of the whole set; null if empty), sketch of docs (doc_id, text)."""
    common.ship(docs.sparkSession)

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                sets = [shingle_set(t, n) for t in part.column(2).to_pylist()]
                sketches = [s[:k] for s in sets]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(s) for s in sketches]))).astype(np.int32)), pa.array(np.concatenate([*sketches, np.zeros(0, np.int64)])))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([signature(s) for s in sets], pa.binary()), lists], ["doc_id", "th", "n_shingles", "sig", "sketch"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.col("text").alias("text"))
    return rows.mapInArrow(common.tidy(run), "doc_id long, th long, n_shingles long, sig binary, sketch array<long>")


def slack(percent: int, k: int = K) -> float:
    """How far an estimate of ``percent`` may lie below it."""
    p = percent / 100
    return SIGMAS * math.sqrt(p * (1 - p) / k)


def least_shared(s: Column, percent: int, k: int = K) -> Column:
    """Retained values that a class with ``s`` of them shares, at least, with any class over the threshold.

    Where neither sketch can be cut off, that is what the threshold asks for; else the share's expectation less its error.
    """
    p = percent / 100
    cut = F.floor(s * p - F.sqrt(s * (p * (1 - p))) * SIGMAS)
    return F.greatest(F.lit(1), F.when(s <= p * k, F.ceil(s * percent / 100 - 1e-9)).otherwise(cut).cast("int"))


def listed(classes: DataFrame, percent: int, k: int = K) -> DataFrame:
    """v, c, w: the inverted lists of the values by which a class can meet one over the threshold; w tells how frequent its values are."""
    postings = classes.select("c", F.size("sketch").alias("s"), F.explode("sketch").alias("v"))
    often = postings.groupBy("v").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = postings.join(often, "v").groupBy("c").agg(F.first("s").alias("s"), F.collect_list(F.struct("df", "v")).alias("values"), F.sum(F.ln("df")).alias("w"))
    # two such classes share this many retained values at least, so one is among the rarest shared - least + 1 of each
    rare = F.slice(F.array_sort("values"), 1, F.greatest(F.lit(0), F.size("values") - least_shared(F.col("s"), percent, k) + 1))
    return shared.select("c", F.round(F.col("w") / F.col("s"), 4).alias("w"), F.explode(rare).alias("x")).select("x.v", "c", "w")


def estimate(a, b, k: int = K):
    """The share of the union's bottom-k sketch that is in both, of two sketch columns."""
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, k)
    return F.size(F.array_intersect(union, F.array_intersect(a, b))) / F.size(union)


def same_size(a, b, percent: int):
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def grouped(batches, keys: int):
    """Runs of rows with equal first ``keys`` columns, of batches sorted by them, each as a table."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        change = np.zeros(b.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), b.num_rows]
        for s, e in zip(starts[:-1], starts[1:], strict=True):
            key = tuple(c[s] for c in cols)
            if held and key != last:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(b.slice(s, e - s))
            last = key
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def overlaps(lists: list[np.ndarray], most: int = 4096) -> np.ndarray:
    """Sizes of all intersections, from products of membership matrices over values that more than one list has."""
    values = np.concatenate(lists)
    owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    _, inverse, counts = np.unique(values, return_inverse=True, return_counts=True)
    twice = counts > 1
    column = np.cumsum(twice) - 1
    use = twice[inverse]
    owner, column = owner[use], column[inverse[use]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(lists), len(lists)), np.float32)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, most):
        s, e = np.searchsorted(column, (low, low + most))
        m = np.zeros((len(lists), most), np.float32)
        m[owner[s:e], column[s:e] - low] = 1
        out += m @ m.T
    return out


class Forest:
    def __init__(self, labels):
        self.of = {x: x for x in labels}

    def find(self, x):
        while self.of[x] != x:
            self.of[x] = x = self.of[self.of[x]]
        return x

    def join(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        self.of[a] = b
        return a != b


def _arrays(t: pa.Table, name: str) -> list[np.ndarray]:
    col = t.column(name).combine_chunks()
    col = col.chunk(0) if isinstance(col, pa.ChunkedArray) else col
    values, offsets = col.values.to_numpy(), col.offsets.to_numpy()
    return [values[s:e] for s, e in zip(offsets[:-1], offsets[1:], strict=True)]


def blocked(members: DataFrame, keys: list[str], blocks) -> DataFrame:
    """members dealt to pairs of blocks: keys, i, j (i <= j) and the member's own block."""
    own = F.pmod(F.xxhash64("c", F.lit(5)), F.col("_n")).cast("int")
    out = members.withColumn("_n", blocks.cast("int")).withColumn("own", own).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    out = out.withColumn("i", F.least("own", "_k")).withColumn("j", F.greatest("own", "_k")).drop("_n", "_k")
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return out.repartition(n, *keys, "i", "j").sortWithinPartitions(*keys, "i", "j", "c")


def compare_lists(members: DataFrame, percent: int, k: int = K) -> DataFrame:
    """a, b: pairs that connect families within blocks of lists (v, i, j, own, c, fam, n, sketch) and pass the estimate."""
    p = percent / 100
    low = p - slack(percent, k)

    def run(batches):
        for t in grouped(batches, 3):
            own, c, fam, n = (t.column(x).to_numpy() for x in ("own", "c", "fam", "n"))
            if len(c) < 2 or (fam == fam[0]).all():
                continue
            across = t.column("i")[0].as_py() != t.column("j")[0].as_py()
            sketches = _arrays(t, "sketch")
            size = np.asarray([len(x) for x in sketches])
            shared = overlaps(sketches)
            fewest = np.minimum.outer(size, size)
            ok = (shared >= np.maximum(1, np.floor(fewest * p - SIGMAS * np.sqrt(fewest * (p * (1 - p)))))) & np.not_equal.outer(fam, fam)
            ok &= 100 * np.minimum.outer(n, n) >= percent * np.maximum.outer(n, n)
            if across:
                ok &= np.not_equal.outer(own, own)
            forest, a_out, b_out = Forest(fam.tolist()), [], []
            for a, b in zip(*(x.tolist() for x in np.nonzero(np.triu(ok, 1))), strict=True):
                if forest.find(fam[a].item()) != forest.find(fam[b].item()):
                    union = np.union1d(sketches[a], sketches[b])[:k]
                    both = np.intersect1d(sketches[a], sketches[b], assume_unique=True)
                    if np.isin(union, both, assume_unique=True).mean() >= low:
                        forest.join(fam[a].item(), fam[b].item())
                        a_out.append(c[a])
                        b_out.append(c[b])
            if a_out:
                yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], ["a", "b"])

    return members.select("v", "i", "j", "own", "c", "fam", "n", "sketch").mapInArrow(common.tidy(run), "a long, b long")


def full_sets(docs: DataFrame, members: DataFrame, n: int) -> DataFrame:
    """fam, salt, is_hub, c, values (the whole set) of members (c, sig, rep, th, fam, hub, salts), from the texts of the classes' rows.

    A hub is there once for each salt, any other class once; of rows that repeat id and text each task makes one set.
    """
    wanted = members.select("rep", "th", "c", "sig", "fam", (F.col("c") == F.col("hub")).alias("is_hub"), "salts")
    if members.count() <= MOST_IDS:
        wanted = F.broadcast(wanted)
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_th"), "text")
    found = texts.join(wanted, (F.col("_th") == F.col("th")) & F.col("_id").eqNullSafe(F.col("rep"))).select("c", "fam", "is_hub", "salts", "sig", "text")

    def run(batches):
        seen: set[int] = set()
        for b in batches:
            for i in range(0, b.num_rows, 128):
                part = b.slice(i, 128)
                at, sets = [], []
                for k, (c, sig, text) in enumerate(zip(*(part.column(x).to_pylist() for x in (0, 4, 5)), strict=True)):
                    if c not in seen and signature(own := shingle_set(text, n)) == sig:
                        seen.add(c)
                        at.append(k)
                        sets.append(own)
                part = part.take(pa.array(at, pa.int64()))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)), pa.array(np.concatenate([*sets, np.zeros(0, np.int64)])))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(4)), lists], ["c", "fam", "is_hub", "salts", "values"])

    sets = found.mapInArrow(common.tidy(run), "c long, fam long, is_hub boolean, salts int, values array<long>")
    salt = F.when(F.col("is_hub"), F.sequence(F.lit(0), F.col("salts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("c", F.lit(7)), F.col("salts")).cast("int")))
    return sets.select("fam", F.explode(salt).alias("salt"), "is_hub", "c", "values")


def differences(sets: DataFrame, percent: int) -> DataFrame:
    """fam, c, hub, n, nh (sizes of the class's and the hub's set), is_linked, delta (values in one of both sets only), hubs left out."""

    def run(batches):
        key = hub = last = None
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                rows, deltas = [], []
                fams, salts, is_hub, classes = (part.column(k).to_pylist() for k in range(4))
                col = part.column(4)
                offsets, values = col.offsets.to_numpy(), col.values.to_numpy()
                for k, (fam, salt, h, c) in enumerate(zip(fams, salts, is_hub, classes, strict=True)):
                    own = values[offsets[k] : offsets[k + 1]]
                    if h:
                        key, hub, last = (fam, salt), (c, own.copy()), None
                    elif c != last:
                        if key != (fam, salt):
                            raise RuntimeError(f"scope {fam} came without its hub")
                        last = c
                        delta = np.setxor1d(own, hub[1], assume_unique=True)
                        deltas.append(delta)
                        rows.append((fam, c, hub[0], len(own), len(hub[1]), (100 + percent) * len(delta) <= (100 - percent) * (len(own) + len(hub[1]))))
                if rows:
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(d) for d in deltas]))).astype(np.int32)), pa.array(np.concatenate(deltas)))
                    yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in zip(*rows, strict=True)), lists], ["fam", "c", "hub", "n", "nh", "is_linked", "delta"])

    n = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = sets.repartition(n, "fam", "salt").sortWithinPartitions("fam", "salt", F.col("is_hub").desc(), "c")
    return dealt.mapInArrow(common.tidy(run), "fam long, c long, hub long, n long, nh long, is_linked boolean, delta array<long>")


def prefixes(deltas: DataFrame, percent: int) -> DataFrame:
    """fam, v, c, comp, n, d, rest: lists of the rarest values of differences, and how many of the class's values come after.

    Two sets are linked if their differences' difference is small enough; with differences of sizes d and e and sets of n
    and m that asks for an overlap of (d + e - t * (n + m)) / 2, t = (100 - percent) / (100 + percent). The least that any
    partner outside the class's own component can ask for fixes how many of its values are listed: of classes linked to
    the hub, such partners are further from the hub than the threshold; of others, they may be as near as one value.
    """
    t = (100 - percent) / (100 + percent)
    d, n, nh = F.col("d"), F.col("n"), F.col("nh")
    least = F.when(F.col("is_linked"), (d + t * (nh - n)) / 2).otherwise((d + 1 - t * (n + nh)) / 2)
    least = F.greatest(F.lit(1), F.ceil(least - 1e-9).cast("int"))
    postings = deltas.select("fam", "c", F.explode("delta").alias("v"))
    often = postings.groupBy("fam", "v").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = postings.join(often, ["fam", "v"]).groupBy("c").agg(F.collect_list(F.struct("df", "v")).alias("values"))
    facts = deltas.select("fam", "c", F.when(F.col("is_linked"), F.col("hub")).otherwise(F.col("c")).alias("comp"), "n", "nh", "is_linked", F.size("delta").alias("d"))
    # values that no other class of the scope has come first
    alone = d - F.size("values")
    some = facts.join(shared, "c").withColumn("alone", alone).withColumn("listed", F.greatest(F.lit(0), d - least + 1 - F.col("alone")))
    out = some.select("fam", "c", "comp", "n", "d", "alone", F.posexplode(F.slice(F.array_sort("values"), F.lit(1), F.col("listed"))).alias("pos", "x"))
    return out.select("fam", "x.v", "c", "comp", "n", "d", (d - 1 - F.col("alone") - F.col("pos")).cast("long").alias("rest"))


def compare_prefixes(members: DataFrame, percent: int) -> DataFrame:
    """a, b (a < b): pairs of different components within blocks of lists (fam, v, i, j, own, c, comp, n, d, rest) that sizes and positions allow."""

    def run(batches):
        for t in grouped(batches, 4):
            own, c, comp, n, d, rest = (t.column(x).to_numpy() for x in ("own", "c", "comp", "n", "d", "rest"))
            if len(c) < 2 or (comp == comp[0]).all():
                continue
            ok = np.not_equal.outer(comp, comp) & (100 * np.minimum.outer(n, n) >= percent * np.maximum.outer(n, n))
            ok &= (100 + percent) * (np.add.outer(d, d) - 2 - 2 * np.minimum.outer(rest, rest)) <= (100 - percent) * np.add.outer(n, n)
            if t.column("i")[0].as_py() != t.column("j")[0].as_py():
                ok &= np.not_equal.outer(own, own)
            a, b = np.nonzero(np.triu(ok, 1))
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(c[a], c[b])), pa.array(np.maximum(c[a], c[b]))], ["a", "b"])

    return members.select("fam", "v", "i", "j", "own", "c", "comp", "n", F.col("d").cast("long").alias("d"), "rest").mapInArrow(common.tidy(run), "a long, b long").distinct()


def mixed(lists: DataFrame, keys: list[str], label: str) -> DataFrame:
    """keys and size of the lists whose members have several labels."""
    return lists.groupBy(*keys).agg(F.min(label).alias("x"), F.max(label).alias("y"), F.count(F.lit(1)).alias("size")).where("x <> y").select(*keys, "size")


def confirmed(pairs: DataFrame, deltas: DataFrame, sketches: DataFrame, percent: int, k: int = K) -> DataFrame:
    """a, b of pairs that pass the sketches' estimate and then, exactly, the differences."""
    side = deltas.select("c", "n", "delta").join(sketches.select("c", "sketch"), "c")
    left = side.select(F.col("c").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"), F.col("delta").alias("da"))
    right = side.select(F.col("c").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"), F.col("delta").alias("db"))
    both = pairs.join(left, "a").join(right, "b").where(estimate(F.col("sa"), F.col("sb"), k) >= percent / 100 - slack(percent, k))
    apart = F.size("da") + F.size("db") - 2 * F.size(F.array_intersect("da", "db"))
    return both.where((100 + percent) * apart <= (100 - percent) * (F.col("na") + F.col("nb"))).select("a", "b")


def groups(docs: DataFrame, n: int, percent: int, k: int = K) -> DataFrame:
    """doc_id, th (xxhash64 of the text), n_shingles, component_id, kept for each row of docs (doc_id, text)."""
    return numbered(docs, n, percent, k).drop("grp")


def numbered(docs: DataFrame, n: int, percent: int, k: int = K) -> DataFrame:
    """What ``groups`` gives, with grp, the number of the row's group; null without words."""
    rows = common.saved(digests(docs, n, k), "digests")
    one = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "th")).alias("one")
    classes = rows.where("sig is not null").groupBy("sig").agg(one, F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    n_rows = rows.count()
    classes = common.saved(common.spread(classes, n_rows, 15_000).select(F.monotonically_increasing_id().alias("c"), "sig", F.col("one.doc_id").alias("rep"), F.col("one.th").alias("th"), "n", "sketch"), "classes")
    lists = common.saved(common.spread(listed(classes, percent, k), n_rows, 15_000), "lists")
    n_listed = lists.count()
    some = common.saved(common.spread(classes.select("c", "n", "sketch").join(lists.groupBy("c").agg(F.first("w").alias("w")), "c"), n_listed, 50_000), "listed")

    # 1: every member against the hub of its list; then lists that still hold several scopes
    rank = F.struct("w", -F.col("c"))
    hubs = lists.groupBy("v").agg(F.max_by("c", rank).alias("b"))
    pairs = lists.join(hubs, "v").where("c <> b").select(F.col("c").alias("a"), "b").distinct()
    left = some.select(F.col("c").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    right = some.select(F.col("c").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    near = pairs.join(left, "a").join(right, "b").where(same_size(F.col("na"), F.col("nb"), percent)).where(estimate(F.col("sa"), F.col("sb"), k) >= SCOPE)
    scopes = components(near.select("a", "b"), n_listed)
    of = scopes.select(F.col("node").alias("c"), F.col("comp").alias("fam"))
    placed = lists.select("v", "c").join(of, "c", "left").withColumn("fam", F.coalesce("fam", "c"))
    members = placed.join(mixed(placed, ["v"], "fam"), "v").join(some, "c")
    more = compare_lists(blocked(members, ["v"], F.ceil(F.col("size") / BLOCK)), percent, k)
    scopes = components(scopes.select(F.col("node").alias("a"), F.col("comp").alias("b")).unionByName(more), n_listed)

    # 2: full sets against that of their scope's hub
    own = classes.drop("sketch").join(scopes.select(F.col("node").alias("c"), F.col("comp").alias("fam")), "c").join(some.select("c", "w"), "c")
    heads = own.groupBy("fam").agg(F.max_by("c", rank).alias("hub"), F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("salts"))
    own = common.saved(common.spread(own.join(heads, "fam"), n_listed, 200_000), "scope-classes")
    deltas = common.saved(differences(full_sets(docs, own, n), percent), "differences")

    # 3: pairs by what they share of their differences
    ranked = common.saved(common.spread(prefixes(deltas, percent), n_listed, 200_000), "prefixes")
    met = compare_prefixes(blocked(ranked.join(mixed(ranked, ["fam", "v"], "comp"), ["fam", "v"]), ["fam", "v"], F.ceil(F.col("size") / BLOCK)), percent)
    links = deltas.where("is_linked").select(F.col("c").alias("a"), F.col("hub").alias("b")).unionByName(confirmed(met, deltas, some, percent, k))
    linked = components(links, n_listed)

    named = own.join(linked.select(F.col("node").alias("c"), "comp"), "c")
    ids = named.groupBy("comp").agg(F.min("rep").alias("component_id"))
    special = named.join(ids, "comp").select("c", "comp", "component_id")
    final = classes.select("c", "sig", "rep").join(special.withColumn("is_linked", F.lit(True)), "c", "left").select("sig", F.coalesce("comp", "c").alias("grp"), F.when(F.col("is_linked"), F.col("component_id")).otherwise(F.col("rep")).alias("component_id"))
    return (
        rows.drop("sketch")
        .join(final, "sig", "left")
        .withColumn("component_id", F.when(F.col("sig").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
        .select("doc_id", "th", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"), "grp")
    )


def op7_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return groups(docs, 3, 85).drop("th")


def one_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, with its columns, without those that another document of their group stands for."""
    lost = common.saved(numbered(docs.select("doc_id", "text"), n, percent).where("not kept").select("doc_id", "th", "component_id", "grp"), "lost")
    gone = lost.where("doc_id is not null or grp is not null").select(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_in"), F.xxhash64("text").alias("_t"), F.col("doc_id").cast("long").alias("_d"))
    on = (F.col("_t") == F.col("_th")) & F.col("_d").eqNullSafe(F.col("_id"))
    nameless = lost.where("doc_id is null and component_id is null and grp is not null")
    out = rows.join(gone, on, "left_anti")
    if not nameless.isEmpty():
        least = nameless.groupBy("grp").agg(F.min("th").alias("_s")).select("_s")
        out = out.unionByName(rows.where("_d is null").join(least, F.col("_t") == F.col("_s"), "left_semi").dropDuplicates(["_t"]))
    return out.select("_in.*")


OP7_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 0) + 2)) AS i FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g FROM p),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM x JOIN n m ON m.doc_id = a JOIN n o ON o.doc_id = b WHERE 100 * i >= 85 * (m.n + o.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (WITH RECURSIVE t(id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.b, t.c FROM t JOIN e ON e.a = t.id) SELECT id, min(c) AS c FROM t GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, r.c AS component_id, d.doc_id = r.c AS kept FROM d JOIN r ON r.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
