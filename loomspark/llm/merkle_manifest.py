"""Merkle manifest of a dataset: distributed block reduction, a small top tree on the driver, folds in the tasks.

A row's leaf is the SHA-256 of its columns; leaves of a group ascend by id, and every ``FAN`` consecutive nodes become their
hash until one is left, the group's subroot. The subroots, by group, become the root likewise.

1. Leaves (32 bytes, not texts) are dealt by range of (group, id, leaf), sorted, written and numbered within their
   partition; a row for each partition tells how far its first group had come before, which makes the numbers positions in the group.
2. Blocks of ``FAN ** k`` positions are each hashed in a task to their one node. While more than ``most_top`` nodes are left,
   blocks are made of these nodes again; once every group has come to its subroot, of the subroots. So each round leaves
   one in ``FAN ** k``, and a third of all rows in one group are as many blocks as they need.
3. The driver builds the rest of the tree over at most ``most_top`` nodes and broadcasts each one's suffix: siblings up to the root.
4. Round by round downwards, tasks hash their blocks again, now with the suffix at hand: broadcast for the last round,
   for earlier ones dealt along with the block's rows. At the leaves each row's proof is complete and is folded.

Positions are written once and only read afterwards, so a task that runs again hashes the same blocks.

Defined results: rows with a null id come first in their group, rows without a group first among groups; ties of group and
id go by leaf, equal leaves get neighbouring places (which of them gets which doesn't matter); a null column is ``-`` in the leaf, so
null and empty differ; a null id isn't tampered with; texts of any length are hashed whole where they lie; an empty table gives no
rows; other columns take no part, whatever their names.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

FAN = 8
#: Positions of a block: FAN to this power.
LEVELS = 3
#: Nodes that the driver builds the top tree over, at most. Each has some 4 kB of suffix at a thousand groups.
MOST_TOP = 4096
#: Leaves of a task.
ROWS = 200_000


def hashed(*columns: Column) -> Column:
    """SHA-256 of ``-`` for a null, else octets, ``:`` and value, of each column, as 32 bytes."""
    parts = []
    for c in columns:
        text = c.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def _up(nodes: list[bytes]) -> list[bytes]:
    """The next level: hex digests of every FAN consecutive ones."""
    return [sha256(b"".join(nodes[i : i + FAN])).hexdigest().encode() for i in range(0, len(nodes), FAN)]


def tree(nodes: list[bytes], most: int | None = None) -> list[list[bytes]]:
    """Levels from ``nodes`` up to the single one, or ``most`` levels above them."""
    out = [nodes]
    while len(out[-1]) > 1 and (most is None or len(out) <= most):
        out.append(_up(out[-1]))
    return out


def path(levels: list[list[bytes]], i: int) -> list[tuple[bytes, bytes]]:
    """(hex of the siblings on the left, on the right) of node i, a pair for each level that has one above."""
    out = []
    for nodes in levels[:-1]:
        at = i - i % FAN
        out.append((b"".join(nodes[at:i]), b"".join(nodes[i + 1 : at + FAN])))
        i //= FAN
    return out


def folded(leaf: bytes, siblings: list[tuple[bytes, bytes]]) -> bytes:
    for left, right in siblings:
        leaf = sha256(left + leaf + right).hexdigest().encode()
    return leaf


def _packed(siblings: list[tuple[bytes, bytes]]) -> bytes:
    """A path as bytes: for each level the numbers of siblings on both sides and their digests."""
    return b"".join(bytes((len(a) // 64, len(b) // 64)) + bytes.fromhex((a + b).decode()) for a, b in siblings)


def _unpacked(raw: bytes) -> list[tuple[bytes, bytes]]:
    out, at = [], 0
    while at < len(raw):
        a, b = raw[at], raw[at + 1]
        text = raw[at + 2 : at + 2 + 32 * (a + b)].hex().encode()
        out.append((text[: 64 * a], text[64 * a :]))
        at += 2 + 32 * (a + b)
    return out


def positions(nodes: DataFrame, group: str, order: list[str], rows: int) -> DataFrame:
    """``nodes`` with pos (long), the place in its group by ``order``; the rows as they were dealt are written once."""
    spark, at = nodes.sparkSession, nodes.columns.index(group)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), -(-rows // ROWS))
    dealt = nodes.repartitionByRange(n, group, *order).sortWithinPartitions(group, *order).withColumn("_part", F.spark_partition_id())
    schema = T.StructType([*dealt.schema.fields, T.StructField("_run", T.IntegerType()), T.StructField("_seq", T.LongType())])

    def numbered(batches):
        run = seq = 0
        last = None
        started = False
        for b in batches:
            runs, seqs = [], []
            for g in b.column(at).to_pylist():
                if not started:
                    started, last = True, g
                elif g != last:
                    run, seq, last = run + 1, 0, g
                runs.append(run)
                seqs.append(seq)
                seq += 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(runs, pa.int32()), pa.array(seqs, pa.int64())], names=[*b.schema.names, "_run", "_seq"])

    done = common.saved(dealt.mapInArrow(numbered, schema), "merkle-dealt")
    key = F.struct("_run", "_seq")
    ends = done.groupBy("_part").agg(F.min_by(group, key).alias("first"), F.max_by(group, key).alias("last"), F.max("_run").alias("runs"), F.max_by("_seq", key).alias("seq"))
    offsets, carried, so_far = [], None, 0
    for r in ends.orderBy("_part").collect():  # a row for each partition
        offset = so_far if offsets and r["first"] == carried else 0
        offsets.append((r["_part"], offset))
        so_far = r["seq"] + 1 + (offset if r["runs"] == 0 else 0)
        carried = r["last"]
    moved = spark.createDataFrame(offsets, "_part int, _offset long")
    placed = done.join(F.broadcast(moved), "_part").withColumn("pos", F.col("_seq") + F.when(F.col("_run") == 0, F.col("_offset")).otherwise(F.lit(0)))
    return placed.drop("_part", "_run", "_seq", "_offset")


def _blocks(rows: DataFrame, group: str, size: int, n: int) -> DataFrame:
    """Rows dealt by block and sorted by position."""
    return rows.withColumn("block", F.floor(F.col("pos") / size).cast("long")).repartition(n, group, "block").sortWithinPartitions(group, "block", "pos")


def _streamed(batches, group: int, block: int):
    """(key, columns as lists) of each block of sorted rows; a block is some hundreds of rows."""
    key, kept = None, None
    for b in batches:
        columns = [c.to_pylist() for c in b.columns]
        n, at = b.num_rows, 0
        while at < n:
            here, end = (columns[group][at], columns[block][at]), at + 1
            while end < n and (columns[group][end], columns[block][end]) == here:
                end += 1
            part = [c[at:end] for c in columns]
            if kept is not None and key == here:
                for a, more in zip(kept, part, strict=True):
                    a.extend(more)
            else:
                if kept is not None:
                    yield key, kept
                key, kept = here, part
            at = end
    if kept is not None:
        yield key, kept


def _levels(block: int, digests: list[bytes], most: int) -> list[list[bytes]]:
    """A block's levels: ``most`` of them, but for a group's only block, which ends with the single node."""
    nodes = [d.hex().encode() for d in digests]
    if block == 0 and len(nodes) < FAN**most:
        return tree(nodes, most)
    out = [nodes]
    for _ in range(most):
        out.append(_up(out[-1]))
    return out


def reduced(nodes: DataFrame, levels: int, n: int, label: str) -> DataFrame:
    """g, pos, digest of the blocks of nodes (g, pos, digest)."""

    def run(batches):
        out = []
        for (g, block), (_, _, digests, _) in _streamed(batches, 0, 3):
            out.append((g, block, bytes.fromhex(_levels(block, digests, levels)[-1][0].decode())))
            if len(out) >= 10_000:
                yield _batch(out, nodes_schema)
                out = []
        yield _batch(out, nodes_schema)

    nodes_schema = pa.schema([("g", pa.string()), ("pos", pa.int64()), ("digest", pa.binary())])
    return common.saved(_blocks(nodes.select("g", "pos", "digest"), "g", FAN**levels, n).mapInArrow(run, "g string, pos long, digest binary"), label)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)


def _top(rows: list, one_group: bool) -> tuple[dict, bytes]:
    """The suffix of each of the nodes (g, pos, digest): packed path and subroot (None where the nodes are subroots' ancestors); the root."""
    groups: dict = {}
    for g, _, digest in sorted(rows, key=lambda r: (r[0] is not None, (r[0] or "").encode(), r[1])):
        groups.setdefault(g, []).append(bytes(digest).hex().encode())
    trees = {g: tree(x) for g, x in groups.items()}
    if not trees:
        return {}, b""
    above = tree([t[-1][0] for t in trees.values()])
    out = {}
    for k, (g, levels) in enumerate(trees.items()):
        rest = [] if one_group else path(above, k)
        for i in range(len(levels[0])):
            out[g, i] = (_packed(path(levels, i) + rest), None if one_group else bytes.fromhex(levels[-1][0].decode()))
    return out, bytes.fromhex(above[-1][0].decode())


def _suffixes(rows: DataFrame, levels: int, n: int, above, given: DataFrame | None, is_subroot: bool) -> DataFrame:
    """g, pos, suffix, subroot of nodes (g, pos, digest): their path in the block followed by the block's suffix, which is broadcast
    (``above``) or comes with the rows (``given``). ``is_subroot``: the nodes are subroots themselves."""
    schema = pa.schema([("g", pa.string()), ("pos", pa.int64()), ("suffix", pa.binary()), ("subroot", pa.binary())])

    def run(batches):
        for (_, block), suffix, subroot, (gs, pos, digests) in _with_suffix(batches, 3, above):
            tower = _levels(block, digests, levels)
            out = [(g, p, _packed(path(tower, i)) + suffix, d if is_subroot else subroot) for i, (g, p, d) in enumerate(zip(gs, pos, digests, strict=True))]
            yield _batch(out, schema)

    return _joined(rows.select("g", "pos", "digest"), given, FAN**levels, n).mapInArrow(run, "g string, pos long, suffix binary, subroot binary")


def _joined(rows: DataFrame, given: DataFrame | None, size: int, n: int) -> DataFrame:
    """rows (g, pos, ...) by block with the columns suffix and subroot; a block's first row brings what is given of it."""
    if given is not None:
        given = given.select("g", (F.col("pos") * size).alias("pos"), "suffix", "subroot", F.lit(0).alias("_nth"))
        rows = rows.withColumn("_nth", F.lit(1)).unionByName(given, allowMissingColumns=True)
        return rows.withColumn("block", F.floor(F.col("pos") / size).cast("long")).repartition(n, "g", "block").sortWithinPartitions("g", "block", "pos", "_nth").drop("_nth")
    empty = F.lit(None).cast("binary")
    return _blocks(rows.withColumns({"suffix": empty, "subroot": empty}), "g", size, n)


def _with_suffix(batches, width: int, above):
    """(group, block), suffix, subroot and the first ``width`` columns of each block."""
    for key, columns in _streamed(batches, 0, width + 2):
        if above is None:  # the first row is the block's own
            suffix, subroot = columns[width][0], columns[width + 1][0]
            yield key, suffix, subroot, [c[1:] for c in columns[:width]]
        else:
            suffix, subroot = above.value[key]
            yield key, suffix, subroot, columns[:width]


def manifest(leaves: DataFrame, levels: int = LEVELS, most_top: int = MOST_TOP) -> DataFrame:
    """For leaves (g string, id, leaf binary, other binary: the leaf to be folded in its place, or null): id, leaf, subroot, root, proof (the
    siblings' hex digests, level by level, as one text), folded (the root that the row leads to); digests as bytes."""
    spark = common.ship(leaves.sparkSession)
    size = FAN**levels
    leaves = common.saved(leaves.select("g", "id", "leaf", "other", F.monotonically_increasing_id().alias("nth")), "merkle-leaves")
    rows = leaves.count()
    least = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    parts = lambda n: max(least, -(-n // ROWS))
    # identical leaves are told apart by where they were read, so that no range has to hold them all
    placed = positions(leaves, "g", ["id", "leaf", "nth"], rows).select("g", "pos", "id", "leaf", "other")
    rounds, n = [(placed.select("g", "pos", F.col("leaf").alias("digest")), False)], rows
    own = subroots = None
    while True:
        nodes = reduced(rounds[-1][0], levels, parts(n), "merkle-nodes")
        n = nodes.count()
        if n <= most_top:
            break
        if own is None and nodes.where("pos > 0").isEmpty():  # all groups have come to their subroots, and these are many
            own = len(rounds)
            subroots = common.saved(positions(nodes.select(F.lit("").alias("one"), F.col("g").alias("name"), "digest"), "one", ["name"], n).select(F.lit("").alias("g"), "pos", "digest", "name"), "merkle-subroots")
            nodes = subroots.select("g", "pos", "digest")
        rounds.append((nodes, own is not None and len(rounds) == own))
    top, root = _top([tuple(r) for r in nodes.select("g", "pos", "digest").collect()], own is not None)
    above, given = spark.sparkContext.broadcast(top), None
    for k in range(len(rounds) - 1, 0, -1):
        given = _suffixes(rounds[k][0], levels, parts(n), above, given, rounds[k][1])
        if rounds[k][1]:  # below, groups have their names again
            given = given.join(subroots.select("pos", "name"), "pos").select(F.col("name").alias("g"), F.lit(0).cast("long").alias("pos"), "suffix", "subroot")
        given, above = common.saved(given, "merkle-suffixes"), None
    id_type = pa.int64() if dict(placed.dtypes)["id"] == "bigint" else pa.string()
    out_schema = pa.schema([("id", id_type), *[(c, pa.binary()) for c in ("leaf", "subroot", "root")], ("proof", pa.string()), ("folded", pa.binary())])

    def run(batches):
        for (_, block), suffix, subroot, (_, _, ids, leaf, other) in _with_suffix(batches, 5, above):
            tower, rest = _levels(block, leaf, levels), _unpacked(suffix)
            out = []
            for i, (key, mine, changed) in enumerate(zip(ids, leaf, other, strict=True)):
                siblings = path(tower, i) + rest
                proof = b"".join(x for pair in siblings for x in pair).decode()
                out.append((key, mine, subroot, root, proof, bytes.fromhex(folded((mine if changed is None else changed).hex().encode(), siblings).decode())))
            yield _batch(out, out_schema)

    kind = dict(placed.dtypes)["id"]
    return _joined(placed, given, size, parts(rows)).mapInArrow(run, f"id {kind}, leaf binary, subroot binary, root binary, proof string, folded binary")


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    row = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = F.when(common.held_out(F.col("doc_id"), 3) & F.col("text").isNotNull(), hashed(*row, common.ascii_lower(F.col("text"))))
    out = manifest(docs.select(F.col("lang").alias("g"), F.col("doc_id").alias("id"), hashed(*row, F.col("text")).alias("leaf"), tampered.alias("other")))
    text = lambda c: F.lower(F.hex(c)).alias(c)
    return out.select(
        F.col("id").alias("doc_id"), text("leaf"), text("subroot"), text("root"), F.sha2("proof", 256).alias("proof_sha256"), F.lower(F.hex("folded")).alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified")
    )


_LEAF = "sha256({}||{}||{}||{}||{})"
_PART = "coalesce(strlen({0}::VARCHAR)::VARCHAR||':'||({0}::VARCHAR),'-')"
_COLUMNS = [_PART.format(c) for c in ("doc_id", "source", "lang", "n_chars")]
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_CRC = (
    "list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)), "
    "lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)::UBIGINT[]), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))"
)
OP12_SQL = rf"""
WITH RECURSIVE d AS (SELECT coalesce('=' || lang, '') AS g, doc_id, {_LEAF.format(*_COLUMNS, _PART.format("text"))} AS leaf,
    CASE WHEN xor({_CRC}, 4294967295) % 3 = 0 AND text IS NOT NULL THEN {_LEAF.format(*_COLUMNS, _PART.format(f"({_LOWER})"))} END AS other FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
t AS (SELECT g, 0 AS lvl, pos, leaf AS h, count(*) OVER (PARTITION BY g) AS n FROM p
  UNION ALL SELECT g, any_value(lvl) + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 7) // 8 FROM t WHERE n > 1 GROUP BY g, pos // 8),
s AS (SELECT g, h AS subroot, lvl AS top, row_number() OVER (ORDER BY g) - 1 AS k FROM t WHERE n = 1),
u AS (SELECT 0 AS lvl, k AS pos, subroot AS h, count(*) OVER () AS n FROM s
  UNION ALL SELECT any_value(lvl) + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 7) // 8 FROM u WHERE n > 1 GROUP BY pos // 8),
a AS (SELECT g, lvl, pos, h, n FROM t WHERE n > 1 UNION ALL SELECT s.g, s.top + u.lvl, u.pos, u.h, u.n FROM u, s WHERE u.n > 1),
w AS (SELECT p.g, p.pos AS leaf_pos, l.lvl, CASE WHEN l.lvl < s.top THEN p.pos ELSE s.k END AS start, CASE WHEN l.lvl < s.top THEN l.lvl ELSE l.lvl - s.top END AS up
  FROM p JOIN s USING (g) JOIN (SELECT DISTINCT g, lvl FROM a) l USING (g)),
v AS (SELECT *, start // (8 ** up)::BIGINT AS here FROM w),
b AS (SELECT v.g, v.leaf_pos, v.lvl, coalesce(string_agg(a.h, '' ORDER BY a.pos) FILTER (a.pos < v.here), '') AS lft, coalesce(string_agg(a.h, '' ORDER BY a.pos) FILTER (a.pos > v.here), '') AS rgt
  FROM v JOIN a ON a.g = v.g AND a.lvl = v.lvl AND a.pos // 8 = v.here // 8 GROUP BY ALL),
f AS (SELECT g, pos AS leaf_pos, 0 AS lvl, coalesce(other, leaf) AS h FROM p
  UNION ALL SELECT f.g, f.leaf_pos, f.lvl + 1, sha256(b.lft || f.h || b.rgt) FROM f JOIN b ON f.g = b.g AND f.leaf_pos = b.leaf_pos AND f.lvl = b.lvl),
e AS (SELECT g, leaf_pos, arg_max(h, lvl) AS folded_root FROM f GROUP BY ALL),
q AS (SELECT g, leaf_pos, sha256(string_agg(lft || rgt, '' ORDER BY lvl)) AS proof_sha256 FROM b GROUP BY ALL)
SELECT p.doc_id, p.leaf, s.subroot, r.h AS root, coalesce(q.proof_sha256, sha256('')) AS proof_sha256, e.folded_root, e.folded_root = r.h AS verified
FROM p JOIN s USING (g) JOIN e ON e.g = p.g AND e.leaf_pos = p.pos LEFT JOIN q ON q.g = p.g AND q.leaf_pos = p.pos CROSS JOIN (SELECT h FROM u WHERE n = 1) r
"""
