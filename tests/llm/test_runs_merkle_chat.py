"""Periodic runs, the Merkle manifest and chat formatting against brute force, on random and odd rows."""

import hashlib
import random
import re
import time
import zlib

import pytest
from pyspark.sql import functions as F

from loomspark.llm import chat_format, common, line_dedup, merkle_manifest, periodic_runs, token_orc

from .test_llm_ops import DOC, docs, empty, odd, rows  # noqa: F401  fixtures

# --- 11 --------------------------------------------------------------------------------------------------------------


def brute_runs(w, least=12):
    """Maximal stretches of each period, kept where no smaller period holds."""
    n, out = len(w), []
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if w[i] != w[i + p]:
                i += 1
                continue
            s = i
            while i + p < n and w[i] == w[i + p]:
                i += 1
            size, part = i + p - s, w[s : i + p]
            if size >= max(least, 2 * p) and not any(part[q:] == part[:-q] for q in range(1, p)):
                out.append((s, size, p))
    return sorted(out, key=lambda r: (r[0], r[2]))


def some_words(rng):
    n, letters, kind = rng.randrange(80), rng.choice([1, 2, 2, 3, 4, 20]), rng.randrange(6)
    w = [rng.randrange(letters) for _ in range(n)]
    if kind == 0 and n:
        a, p = rng.randrange(n), rng.randrange(1, n + 1)
        w = [w[i] if i < a else w[min(n - 1, a + (i - a) % p)] for i in range(n)]
    if kind == 1:  # Fibonacci words
        a, w = [0], [0, 1]
        while len(w) < n:
            a, w = w, w + a
        w = w[:n]
    if kind == 2:  # without overlaps
        w = [i.bit_count() % 2 for i in range(n)]
    if kind == 3:
        x, w = [rng.randrange(3) for _ in range(9)], []
        while len(w) < n:
            w += x + [rng.randrange(5)] * rng.randrange(3)
    return w


def test_linear_scan_equals_brute_force():
    rng = random.Random(5)
    for _ in range(1500):
        w, least = some_words(rng), rng.choice([2, 5, 12])
        assert periodic_runs.runs_of(w, least) == brute_runs(w, least)


def test_edges_are_next_smaller_suffixes_and_their_matches():
    rng = random.Random(6)
    for _ in range(500):
        w = some_words(rng)
        n = len(w)
        smaller, right = periodic_runs.edges([*w, -1], n)
        for i in range(n):
            j = next((j for j in range(i + 1, n) if w[j:] < w[i:]), n)
            k = next((k for k in range(n - j) if w[i + k] != w[j + k]), n - j)
            assert (smaller[i], right[i]) == (j, k)


class Counted(int):
    """A number that counts how often it is found equal to another."""

    equal = 0

    def __eq__(self, other):
        same = int(self) == int(other)
        Counted.equal += same
        return same

    __hash__ = int.__hash__


@pytest.mark.parametrize("w", [[0] * 4000, [0, 1] * 2000, [0] * 2000 + [1] + [0] * 1999, list(range(50)) * 80, [i.bit_count() % 2 for i in range(4096)], ([0, 0, 1] * 30 + [2]) * 40])
def test_matches_are_never_compared_again(w):
    """Each comparison that finds two words equal moves the farthest match by one."""
    Counted.equal = 0
    periodic_runs.edges([*map(Counted, w), Counted(-1)], len(w))
    assert Counted.equal <= len(w)


@pytest.mark.parametrize("shallow, jumps", [(2, 64), (6, 2), (24, 64)])
def test_texts_together_equal_brute_force(monkeypatch, shallow, jumps):
    monkeypatch.setattr(periodic_runs, "SHALLOW", shallow)
    monkeypatch.setattr(periodic_runs, "JUMPS", jumps)
    names = [b"a", b"b\0", b"b", b"abcdefg", b"abcdefgh", b"abcdefghi", b"abcdefgh\0", b"x" * 16, b"x" * 17, b"x" * 17 + b"y", b"\xff" * 9, b"zz" * 40, *(str(i).encode() for i in range(10))]
    rng = random.Random(shallow)
    for _ in range(60):
        texts = [[names[x % len(names)] for x in some_words(rng)] for _ in range(rng.randrange(1, 30))]
        assert periodic_runs.runs_of_texts(texts, 5) == [brute_runs(t, 5) for t in texts]
    assert periodic_runs.runs_of_texts([[], []]) == [[], []]


def brute_row(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    runs = brute_runs(w) if n < 3000 else [tuple(r) for r in periodic_runs.runs_of([sorted(set(w)).index(x) for x in w])]
    gone = {i for s, size, p in runs for i in range(s + p, s + size)}
    best = max(((size, -s, -p) for s, size, p in runs), default=None)
    told = (-best[1], best[0], -best[2], 1000 * best[0] // -best[2]) if best else (None,) * 4
    sha = lambda x: hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest()
    return (doc_id, len(runs), *told, sha("".join(f"{s},{size},{p}\n" for s, size, p in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_runs_query_equals_brute_force(spark, data, rows):  # noqa: F811
    got = {r.doc_id: tuple(r) for r in periodic_runs.op11_runs(spark, data).collect()}
    assert got == {r.doc_id: brute_row(r.doc_id, r.text) for r in rows}
    assert any(r[1] for r in got.values())


def test_runs_of_odd_rows(odd, empty):  # noqa: F811
    out = periodic_runs.collapsed(odd.withColumn("runs", F.lit("taken")))
    got = out.collect()
    assert len(got) == odd.count() and set(odd.columns) < set(out.columns) and out.columns.count("runs") == 1
    by = {(r.doc_id, r.text): r for r in got}
    long = by[6, "word " * 60_000 + "\n" + "A line.\n" * 500]
    assert [(r.start, r.length, r.period) for r in long.runs] == [(0, 60_000, 1), (60_000, 1000, 2)] and long.collapsed == "word A line."
    assert by[1, None].collapsed == "" and by[1, None].runs == [] and by[3, " \t\n "].collapsed == ""
    assert all(r.score == "kept" for r in got)
    assert periodic_runs.collapsed(empty).count() == 0


# --- 12 --------------------------------------------------------------------------------------------------------------


def sha(*x):
    return hashlib.sha256("".join(x).encode("utf-8", "surrogatepass")).hexdigest()


def climbed(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][k : k + 8]) for k in range(0, len(levels[-1]), 8)])
    return levels


def brute_manifest(leaves):
    groups = {}
    for g, i, leaf, other in sorted(leaves, key=lambda r: (r[0] is not None, (r[0] or "").encode(), r[1] is not None, r[1] or 0, r[2])):
        groups.setdefault(g, []).append((i, leaf, other))
    trees = {g: climbed([x[1] for x in v]) for g, v in groups.items()}
    above = climbed([t[-1][0] for t in trees.values()])
    out = []
    for k, (g, members) in enumerate(groups.items()):
        for at, (i, leaf, other) in enumerate(members):
            siblings, f = "", other or leaf
            for levels, q in ((trees[g], at), (above, k)):
                for nodes in levels[:-1]:
                    left, right = "".join(nodes[q // 8 * 8 : q]), "".join(nodes[q + 1 : q // 8 * 8 + 8])
                    siblings, f, q = siblings + left + right, sha(left, f, right), q // 8
            out.append((i, leaf, trees[g][-1][0], above[-1][0], siblings, f))
    return sorted(out, key=repr)


@pytest.mark.parametrize("groups, n, levels, most_top", [(3, 700, 1, 4), (90, 300, 1, 10), (1, 1, 3, 100), (40, 900, 2, 20), (2, 513, 3, 4096), (1, 512, 3, 4096), (1, 64, 1, 7)])
def test_manifest_equals_brute_force(spark, groups, n, levels, most_top):
    """Also where blocks are made of blocks, and where there are more groups than the top tree holds."""
    rng = random.Random(n)
    leaves = [(rng.choice([None, *(f"l{x}" for x in range(groups))]) if groups > 1 else "x", rng.choice([None, *range(n)]), sha(str(rng.randrange(n))), None) for _ in range(n)]
    leaves = [(g, i, leaf, sha(leaf) if leaf[0] < "5" else None) for g, i, leaf, _ in leaves]
    df = spark.createDataFrame([(g, i, bytes.fromhex(a), bytes.fromhex(b) if b else None) for g, i, a, b in leaves], "g string, id long, leaf binary, other binary")
    got = [(r.id, r.leaf.hex(), r.subroot.hex(), r.root.hex(), r.proof, r.folded.hex()) for r in merkle_manifest.manifest(df, levels, most_top).collect()]
    assert sorted(got, key=repr) == brute_manifest(leaves)


def test_manifest_of_odd_rows(spark, odd, tmp_path):  # noqa: F811
    """The query on nulls, repeats, empty texts and clashing names; a changed letter shows."""
    odd.coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    got = merkle_manifest.op12_merkle(spark, str(tmp_path)).collect()
    cut = lambda v: "-" if v is None else f"{len(str(v).encode('utf-8', 'surrogatepass'))}:{v}"
    lower = lambda t: t if t is None else re.sub("[A-Z]", lambda m: m[0].lower(), t)
    leaves = []
    for r in odd.collect():
        leaf = lambda t, r=r: sha(*map(cut, (r.doc_id, r.source, r.lang, r.n_chars, t)))
        changed = r.doc_id is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0
        leaves.append((r.lang, r.doc_id, leaf(r.text), leaf(lower(r.text)) if changed else None))
    want = [(i, leaf, sub, root, sha(proof), f, f == root) for i, leaf, sub, root, proof, f in brute_manifest(leaves)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_manifest_of_no_rows(spark):
    none = spark.createDataFrame([], "g string, id long, leaf binary, other binary")
    assert merkle_manifest.manifest(none).count() == 0


# --- 13 --------------------------------------------------------------------------------------------------------------

ALPHABET = ["\\", "#", "##", "###", "</turn>", "<", "/turn>", ": ", ":", " ", "\n", "a", "é", "😀", "### user: ", "\x00"]


def parser(text):
    """The grammar, character by character; None where it doesn't hold."""

    def until(at, end, controls):
        out = ""
        while True:
            if text[at] == "\\":
                hit = next((c for c in ["\\", *controls] if text.startswith(c, at + 1)), "")
                out, at = out + (hit or "\\"), at + 1 + len(hit)
            elif text.startswith(end, at):
                return out, at + len(end)
            elif any(text.startswith(c, at) for c in controls):
                raise ValueError(at)
            else:
                out, at = out + text[at], at + 1

    at, turns = 0, []
    while at < len(text):
        assert text.startswith("### ", at)
        role, at = until(at + 4, ": ", ["###", "</turn>", ": "])
        body, at = until(at, "</turn>\n", ["###", "</turn>"])
        turns.append((role, body))
    return turns


def test_chats_come_back(spark):
    rng = random.Random(13)
    text = lambda: rng.choice([None, "", "plain", "".join(rng.choice(ALPHABET) for _ in range(rng.randrange(12)))])
    turns = [(rng.choice([None, *range(60)]), rng.choice([None, 0, 1, 2, 3]), rng.choice(["user", "assistant", "assistant", text()]), text()) for _ in range(400)]
    turns += [(99, 0, "user", "w " * 300_000 + "\\" * 50_000 + "###" * 50_000 + "\n"), (99, 1, "assistant", "</turn>\n" * 20_000)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("x") for c in ("level", "formatted", "back", "loss", "source")})
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.formatted(df)).collect()}
    want = {}
    for conv, turn, role, body in sorted(turns, key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or "")):
        want.setdefault(conv, []).append((role or "", body or ""))
    assert set(got) == set(want)
    for conv, told in want.items():
        r = got[conv]
        assert [(t.role, t.text) for t in r.turns] == told and parser(r.formatted) == told
        assert r.loss_text == "".join(b for a, b in told if a == "assistant")
        assert [s.turn for s in r.loss] == [i for i, (a, _) in enumerate(told) if a == "assistant"]


def test_chats_escape_no_more_than_needed(spark):
    texts = {"a\\b # ## <turn>": 0, "### x": 1, "x </turn>": 1, "\\### x": 2, "ends with \\": 2, "\\\\": 2}
    df = spark.createDataFrame([(i, 0, "user", t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string")
    assert {r.text: r.level for r in chat_format.levels(df).collect()} == texts


def test_a_chat_that_does_not_come_back_is_an_error(spark, monkeypatch):
    df = spark.createDataFrame([(1, 0, "user", "### x")], "conv_id long, turn long, role string, text string")
    monkeypatch.setattr(chat_format, "levels", lambda turns: turns.withColumn("level", F.lit(0).cast("tinyint")))
    with pytest.raises(Exception, match="does not come back"):
        chat_format.formatted(df).collect()


def test_no_chats(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_format.read_back(chat_format.formatted(none)).count() == 0


# --- earlier operators ----------------------------------------------------------------------------------------------------


def test_orc_is_written_by_range_if_rows_come_otherwise(spark, docs, tmp_path, monkeypatch):  # noqa: F811
    """Rows that a first look took to be in order and that aren't: the same files' content as by range, and no error."""
    model = open(common.tokenizer("byte_bpe_50k.json"), "rb").read()
    some = docs.select("doc_id", "text").where("doc_id < 60").orderBy(F.desc("doc_id"))
    told = {}
    for name, first_look in (("wrong", True), ("right", False)):
        monkeypatch.setattr(token_orc, "in_order", lambda df, is_=first_look: is_)
        token_orc.write(some, f"{tmp_path}/{name}", model)
        told[name] = sorted(tuple(r) for r in token_orc.checksums(token_orc.read(spark, f"{tmp_path}/{name}")).collect())
    assert told["wrong"] == told["right"] and len(told["right"]) == some.count()


def test_a_path_with_a_plan_s_words_is_a_plain_scan(spark, docs, tmp_path):  # noqa: F811
    at = f"{tmp_path}/Exchange Sort"
    docs.select("doc_id", "text").coalesce(1).sortWithinPartitions("doc_id").write.parquet(at)
    assert token_orc.in_order(spark.read.parquet(at)) and not token_orc.in_order(spark.read.parquet(at).repartition(3))


def test_bitmaps_of_a_long_text_expand_in_linear_time(spark):
    """Words of sparse bitmaps, gaps filled; four times as many take no more than some times as long."""
    sparse = spark.createDataFrame([([(2, 5), (3, 1), (7, -1)],), ([(0, 1)],), ([],)], "b array<struct<word:int,bits:bigint>>")
    assert [r[0] for r in sparse.select(line_dedup.dense(F.col("b"))).collect()] == [[0, 0, 5, 1, 0, 0, 0, -1], [1], []]
    took = []
    for n in (20_000, 80_000):
        one = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct((i * 2).alias("word"), i.cast("bigint").alias("bits"))).alias("b"))
        one = one.select(F.when(F.rand() < 2, F.col("b")).alias("b"))  # not folded when the plan is made
        start = time.perf_counter()
        assert one.select(F.size(line_dedup.dense(F.col("b")))).first()[0] == 2 * n - 1
        took.append(time.perf_counter() - start)
    assert took[1] < 6 * took[0] + 3


def test_runs_query_on_odd_rows(spark, tmp_path):
    """Rows whose id plants a period: empty, null, blank, of one word, repeated; ids that are null."""
    ids = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 10 == 0][:5]
    some = [(ids[0], ""), (ids[1], None), (ids[2], " \n "), (ids[3], "one"), (ids[4], "a b c d e f g h i j k l m n o p " * 3), (ids[4], "a b c d e f g h i j k l m n o p " * 3), (None, "x y"), (None, None), (1, "")]
    spark.createDataFrame(some, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in periodic_runs.op11_runs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted((brute_row(*r) for r in some), key=repr)
