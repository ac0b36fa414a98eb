import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark.llm import common, components, decontaminate, language_cnn, lattice_lm, license_scan, line_dedup, near_dups, quality_mcd, queries, sentencepiece_stream, token_orc, toxicity_kn

DOC = "doc_id long, text string, lang string, source string, n_chars long"
#: Nulls, empty and odd texts, repeated ids and rows, a very long text.
ODD = [
    (1, None, "en", "s", None),
    (2, "", None, "s", 0),
    (3, " \t\n ", "en", None, 4),
    (None, "null id here", "en", "s", 12),
    (4, "same words in here", "de", "s", 18),
    (4, "same words in here", "de", "s", 18),
    (4, "other words under this id", "de", "t", 25),
    (5, "▁x ▁  y\r\n<|endoftext|> 日本 😀\x00\x85 ﷐", "fr", "s", 10),
    (6, "word " * 60_000 + "\n" + "A line.\n" * 500, "en", "s", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows with extra columns whose names the operators use themselves."""
    df = spark.createDataFrame(ODD, DOC)
    for c in ("score", "spans", "_row", "a", "pos", "n_words", "tail", "values", "x0"):
        df = df.withColumn(c, F.lit("kept"))
    return df


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return docs.collect()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, data, same, name):
    same(queries.queries()[name](spark, data), queries.oracle_sql()[name])


# --- 1 ---------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model():
    return sentencepiece_stream.read_model()


def best_score(v, text):
    best = [0.0] + [-math.inf] * len(text)
    for end in range(1, len(text) + 1):
        for start in range(max(0, end - v.longest), end):
            s = v.score.get(text[start:end])
            if s is None and end - start == 1:
                s = v.unknown
            if s is not None:
                best[end] = max(best[end], best[start] + s)
    return best[-1]


def test_streaming_viterbi_is_optimal(model, rows):
    v = sentencepiece_stream.Vocabulary(model)
    for text in [r.text[:300].replace("\n", " ") for r in rows[:30]] + ["a" * 500, "un known 日本 x"]:
        escaped = "▁" + text.replace(" ", "▁")
        ids = list(v.search(escaped))
        known = sum(v.score[v.pieces[i]] for i in ids if i not in v.byte_id)
        unknown = sum(1 for c in escaped if c not in v.chars)
        assert math.isclose(known + unknown * v.unknown, best_score(v, escaped), rel_tol=1e-9)
        assert np.frombuffer(v.encode(text), "<i4").tolist() == ids


def score_of(v, ids, escaped):
    return sum(v.score[v.pieces[i]] for i in ids if i not in v.byte_id) + v.unknown * sum(1 for c in escaped if c not in v.chars)


def test_streaming_viterbi_is_optimal_on_whole_texts(model, rows):
    """Through the texts' ends, line breaks and all; with remembered words and without."""
    v, fresh = sentencepiece_stream.Vocabulary(model), sentencepiece_stream.Vocabulary(model)
    texts = [r.text for r in rows if r.text][:40] + [ODD[-1][1][:30_000], "日本" * 300 + " é" * 50, " two  blanks ", "x\n\n y", "QUJD" * 500]
    import pyarrow as pa

    offsets, ids = v.block(pa.array(texts))
    for text, a, b in zip(texts, offsets[:-1], offsets[1:], strict=True):
        escaped = "▁" + text.replace(" ", "▁")
        whole = list(fresh.search(escaped))
        assert math.isclose(score_of(v, whole, escaped), best_score(v, escaped), rel_tol=1e-9)
        assert ids[a:b].tolist() == whole
        assert np.frombuffer(b"".join(fresh.stream(text)), "<i4").tolist() == whole


def test_streaming_search_commits_early_and_holds_little(model):
    import tracemalloc

    v = sentencepiece_stream.Vocabulary(model)
    rng = np.random.default_rng(5)

    class Watched(str):
        furthest = 0

        def __getitem__(self, k):
            end = k.stop if isinstance(k, slice) else k + 1
            self.furthest = max(self.furthest, end)
            return str.__getitem__(self, k)

    text = Watched("▁" + "".join(rng.choice(list("abcdefgh日"), 5000)))
    at, lag = 0, 0
    for i in v.search(text):
        at += len(v.pieces[i]) if i not in v.byte_id else 0
        lag = max(lag, text.furthest - at)
    assert lag < 60 * v.longest  # long before the end
    peak = []
    for n in (30_000, 240_000):
        text = "".join(rng.choice(list("abcdefgh"), n))
        tracemalloc.start()
        assert sum(1 for _ in v.search(text)) > n / 10
        peak.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peak[1] < peak[0] + 300_000


def test_segmentations_are_the_librarys(model, rows):
    """Both search the same scores. Two pieces of the file have -1e9, beside which the library's sums are rounded; they get
    -40,000 here, below all others."""
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    import sentencepiece

    proto = pb.ModelProto()
    proto.ParseFromString(model)
    proto.trainer_spec.model_type = 1  # the same pieces, searched as a unigram model
    for p in proto.pieces:
        p.score = max(p.score, -40_000.0)
    v, library = sentencepiece_stream.Vocabulary(proto.SerializeToString()), sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    lines = [x for r in rows if r.text for x in r.text.split("\n")][:3000]
    for line in lines:
        if line and not re.search("▁|\\s\\s|^\\s|\\s$", line) and all(c in v.chars or c == " " for c in line):
            ours, theirs = np.frombuffer(v.encode(line), "<i4").tolist(), library.encode(line)
            escaped = "▁" + line.replace(" ", "▁")
            assert ours == theirs or math.isclose(score_of(v, ours, escaped), score_of(v, theirs, escaped), rel_tol=1e-7), line


def test_sentencepiece_round_trip(odd, empty, model, docs):
    got = sentencepiece_stream.encode(odd, model, check="ok").collect()
    assert len(got) == len(ODD) and all(r.ok for r in got)
    assert {r.ids is None for r in got if r.doc_id == 1} == {True} and all(r.score == "kept" for r in got)
    back = sentencepiece_stream.decode(sentencepiece_stream.encode(docs, model), model)
    assert back.where(~F.col("decoded").eqNullSafe(F.col("text"))).count() == 0
    assert sentencepiece_stream.encode(empty, model).count() == 0


# --- 2 ---------------------------------------------------------------------------------------------------------------


def brute_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    places = collections.defaultdict(list)
    for i in range(len(words) - 7):
        places[tuple(words[i : i + 8])].append(i)
    hit = {j for p in places.values() if len(p) > 1 for i in p for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit)


def test_quality_statistics(rows):
    for r in rows[:80]:
        assert quality_mcd.statistics(r.text)[:5] == brute_statistics(r.text)
    for text in ("a b c d e f g h " * 3, "x " * 30, "\n\n a\n a\na\n\n", "<|#"):
        assert quality_mcd.statistics(text)[:5] == brute_statistics(text)


def brute_mcd(x, groups):
    """The same concentration steps in numpy; exact quantiles."""
    floor = np.array(quality_mcd.FLOOR)
    lang = {g: g[0] for g in set(groups)}
    index = {g: np.array([i for i, h in enumerate(groups) if h == g]) for g in set(groups)}
    params = {}
    floored = lambda c: np.linalg.inv(c + np.diag(np.maximum(0, floor**2 - np.diag(c))))
    lower = lambda a, q: np.sort(a)[max(0, math.ceil(q * len(a)) - 1)]
    for g, i in index.items():
        m = np.array([lower(x[i, k], 0.5) for k in range(5)])
        d = np.array([lower(np.abs(x[i, k] - m[k]), 0.5) for k in range(5)])
        params[g] = (m, floored(np.diag((1.4826 * d) ** 2)))
    dist = lambda g, i: np.einsum("ij,jk,ik->i", x[i] - params[g][0], params[g][1], x[i] - params[g][0])
    for _ in range(quality_mcd.STEPS):
        own = {}
        for g, i in index.items():
            d = dist(g, i)
            y = x[i[d <= lower(d, quality_mcd.SUPPORT)]]
            own[g] = (len(y), y.sum(0), y.T @ y)
        total = [sum(o[k] for o in own.values()) for k in range(3)]
        for g in index:
            part = [sum(o[k] for h, o in own.items() if lang[h] == lang[g]) for k in range(3)]
            n, s, q = (own[g][k] + part[k] * quality_mcd.PRIOR / part[0] + total[k] * quality_mcd.PRIOR / 4 / total[0] for k in range(3))
            params[g] = (s / n, floored(q / n - np.outer(s / n, s / n)))
    out = np.zeros(len(x))
    for g, i in index.items():
        d = dist(g, i)
        out[i] = d / max(1.0, lower(d, 0.5) / quality_mcd.MEDIAN_CHI2)
    return out


def test_quality_outliers_equal_brute_force(docs):
    got = quality_mcd.judged(docs.select("doc_id", "lang", F.lit("s").alias("source"), "text")).toPandas()
    good = got[~got.base_failed].reset_index(drop=True)
    want = brute_mcd(good[list(quality_mcd.FEATURES)].to_numpy(), list(zip(good.lang, good.source, strict=True)))
    assert np.allclose(good.d2, want, rtol=1e-3, atol=1e-3)
    assert ((want <= quality_mcd.CUTOFF) == good.kept).mean() > 0.99 and good.kept.mean() > 0.85
    assert not got[got.base_failed].kept.any()


def test_quality_salted_join_and_odd_rows(spark, odd, empty, docs, monkeypatch):
    cols = ["doc_id", "lang", "source", "text"]
    assert quality_mcd.judged(empty.select(*cols)).count() == 0
    got = quality_mcd.judged(odd.select(*cols).unionByName(docs.select(*cols))).collect()
    assert len(got) == len(ODD) + docs.count() and not any(r.kept for r in got if r.doc_id in (1, 2, 3) and r.n_words == 0)
    plain = {r.doc_id: r.kept for r in quality_mcd.judged(docs.select(*cols)).collect()}
    monkeypatch.setattr(quality_mcd, "MOST_GROUPS", 0)
    assert {r.doc_id: r.kept for r in quality_mcd.judged(docs.select(*cols)).collect()} == plain


def test_quality_groups_ties_and_clashing_names(spark, odd, docs):
    """Several languages and sources, each with its own estimate; equal rows are judged alike; columns of any name are ignored."""
    rng = np.random.default_rng(11)
    rows = []
    for i in range(900):
        lang, source = ("en", "de", None)[i % 3], ("a", "b")[i // 3 % 2]
        n = {"a": 60, "b": 300}[source]
        rows.append((i, " ".join("w" * int(rng.integers(2, 9)) + str(rng.integers(900)) for _ in range(int(n * rng.uniform(0.8, 1.25)))), lang, source, 0))
    rows += [(1000 + i, rows[0][1], "en", "a", 0) for i in range(50)]  # ties in all features
    rows.append((2000, rows[3][1].replace(" ", " #$%& "), "en", "b", 0))
    df = spark.createDataFrame(rows, DOC)
    got = quality_mcd.judged(df.select("doc_id", "lang", "source", "text")).toPandas()
    good = got[~got.base_failed].reset_index(drop=True)
    groups = [(g.lang, g.source) for g in good.itertuples()]
    want = brute_mcd(good[list(quality_mcd.FEATURES)].to_numpy(), groups)
    assert len(set(groups)) == 6 and np.allclose(good.d2, want, rtol=2e-3, atol=2e-3)
    same = good[good.doc_id.isin([0, *range(1000, 1050)])]
    assert same.d2.nunique() == 1 and same.kept.nunique() == 1
    assert not good[good.doc_id == 2000].kept.any() and good.kept.mean() > 0.95
    named = df.withColumn("x0", F.lit("kept")).withColumn("n_words", F.lit("kept")).withColumn("d2", F.lit(1)).withColumn("_s", F.lit(2)).withColumn("limit", F.lit(3)).withColumn("m0", F.lit(4))
    assert {r.doc_id: r.kept for r in quality_mcd.judged(named).collect()} == dict(zip(got.doc_id, got.kept, strict=True))
    assert quality_mcd.judged(odd).count() == len(ODD)
    alike = spark.createDataFrame([(i, rows[0][1], "en", "a", 0) for i in range(30)], DOC)  # nothing varies at all
    assert quality_mcd.judged(alike).where("kept").count() == 30


def test_each_quality_feature_rejects_by_itself(spark):
    rng = np.random.default_rng(5)
    line = lambda k: " ".join(rng.choice([f"w{i}" for i in range(500)], k))
    rows = [(i, "\n".join(line(4) for _ in range(25)), "en", "s", 0) for i in range(300)]
    twice = line(14)
    rows.append((301, "\n".join([twice, *(line(4) for _ in range(18)), twice]), "en", "s", 0))
    got = {r.doc_id: r for r in quality_mcd.judged(spark.createDataFrame(rows, DOC)).collect()}
    assert not got[301].base_failed and not got[301].kept and got[301].n_dup_lines == 1
    assert sum(got[i].kept for i in range(300)) > 290
    s = np.array([[100, 400, 0, 24, 0, 25], [100, 400, 0, 0, 30, 25], [100, 400, 0, 0, 0, 25]])
    x = quality_mcd.vector(s)
    assert (((x[:2] - x[2]) / quality_mcd.FLOOR) ** 2).max(1).min() > 2 * quality_mcd.CUTOFF


# --- 3 ---------------------------------------------------------------------------------------------------------------


def test_token_files(spark, odd, empty, docs, tmp_path):
    from tokenizers import Tokenizer

    path = common.tokenizer("byte_bpe_50k.json")
    model, lib = open(path, "rb").read(), Tokenizer.from_file(path)
    both = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    token_orc.write(both, str(tmp_path / "t"), model)
    got = token_orc.checksums(token_orc.read(spark, str(tmp_path / "t"))).collect()
    rows = sorted(((r.doc_id if r.doc_id is not None else -1, r.text is not None, r.text or "") for r in both.collect()))
    start, want = 0, []
    for doc, _, text in rows:
        ids = np.array([*lib.encode(text, add_special_tokens=False).ids, 0], "<u4")
        want.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.start, r.n_tokens, r.ids_crc32) for r in got) == sorted(want)
    token_orc.write(empty, str(tmp_path / "e"), model)
    assert token_orc.read(spark, str(tmp_path / "e")).count() == 0


def test_token_files_of_ordered_input_need_no_exchange(spark, docs, tmp_path):
    model = open(common.tokenizer("byte_bpe_50k.json"), "rb").read()
    docs.orderBy("doc_id").coalesce(1).write.option("maxRecordsPerFile", 70).parquet(str(tmp_path / "in"))
    one = spark.read.parquet(str(tmp_path / "in")).select("doc_id", "text")
    mixed = docs.orderBy(F.hash("doc_id")).select("doc_id", "text")
    assert not token_orc.in_order(mixed) and not token_orc.in_order(one.unionByName(one))
    out = {}
    for name, df in (("a", one), ("b", mixed)):
        token_orc.write(df, str(tmp_path / name), model)
        out[name] = sorted(map(tuple, token_orc.checksums(token_orc.read(spark, str(tmp_path / name))).collect()))
    assert out["a"] == out["b"] and len(out["a"]) == docs.count()
    assert token_orc.in_order(docs.select("doc_id", "text"))
    looked = token_orc.read(spark, str(tmp_path / "a")).where("doc_id = 7")
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,7)]" in looked._jdf.queryExecution().executedPlan().toString()


def test_orc_files_have_stripes_indexes_run_lengths_and_bloom_filters(spark, docs, odd, tmp_path):
    model = open(common.tokenizer("byte_bpe_50k.json"), "rb").read()
    many = docs.select((F.col("doc_id") * 2).alias("doc_id"), "text").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(60)))).select((F.col("doc_id") + F.col("k") * 1000).alias("doc_id"), "text", F.lit("x").alias("ids"), F.lit(1).alias("local_start"))
    token_orc.write(many.coalesce(1), str(tmp_path / "t"), model, stripe_mb=1)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    kinds, encodings, stripes, rows = set(), set(), 0, 0
    for path in (tmp_path / "t").glob("*.orc"):
        orc = jvm.org.apache.orc.OrcFile
        reader = orc.createReader(jvm.org.apache.hadoop.fs.Path(str(path)), orc.readerOptions(conf))
        assert reader.getRowIndexStride() == 2000
        parts = reader.rows()
        for stripe in reader.getStripes():
            footer = parts.readStripeFooter(stripe)
            stripes += 1
            rows += stripe.getNumberOfRows()
            kinds |= {str(x.getKind()) for x in footer.getStreamsList()}
            encodings |= {str(x.getKind()) for x in footer.getColumnsList()}
        parts.close()
    assert rows == docs.count() * 61 and stripes > 1
    assert {"ROW_INDEX", "BLOOM_FILTER_UTF8", "DATA", "LENGTH"} <= kinds and "DIRECT_V2" in encodings  # run lengths of the second kind
    read = token_orc.read(spark, str(tmp_path / "t"))
    assert read.where("doc_id = 1999").count() == 0 and read.where("doc_id = 2").count() == many.where("doc_id = 2").count() > 0
    # an absent id within the range of all is skipped by the filters: far fewer rows are read than there are
    plan = spark.read.schema("doc_id long, ids array<int>").orc(str(tmp_path / "t")).where("doc_id = 1999")
    plan.collect()
    scanned = plan._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numOutputRows").value()
    assert scanned < rows / 2
    token_orc.write(odd, str(tmp_path / "o"), model)
    assert sorted(r.doc_id or 0 for r in token_orc.read(spark, str(tmp_path / "o")).collect()) == sorted(r[0] or 0 for r in ODD)


def test_token_starts_join_when_there_are_many_files(spark, docs, tmp_path, monkeypatch):
    model = open(common.tokenizer("byte_bpe_50k.json"), "rb").read()
    token_orc.write(docs.select("doc_id", "text"), str(tmp_path / "t"), model)
    want = sorted(map(tuple, token_orc.checksums(token_orc.read(spark, str(tmp_path / "t"))).collect()))
    monkeypatch.setattr(token_orc, "MOST_FILES", 0)
    assert sorted(map(tuple, token_orc.checksums(token_orc.read(spark, str(tmp_path / "t"))).collect())) == want


def test_tokens_of_other_pretokenizers_go_whole():
    model = open(common.tokenizer("word_bpe_49k.json"), "rb").read()
    import pyarrow as pa

    e = token_orc.Encoder(model)
    texts = ["Some Text, here", "", "a  b\nc"]
    offsets, ids = e.encode(pa.array(texts))
    assert [ids[s:t].tolist() for s, t in zip(offsets[:-1], offsets[1:], strict=True)] == [e.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


# --- 4 ---------------------------------------------------------------------------------------------------------------


def key_of(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def test_line_dedup_modes_and_odd_rows(spark, odd, empty):
    texts = [("Head \nbody %d\n\nHEAD\nÀ end" % i) for i in range(12)] + ["x\n" * 130 + "head"]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOC)
    got = {r.doc_id: r for r in line_dedup.cleaned(df).collect()}
    assert got[3].text == "body 3\n" and got[3].n_chars == 7
    assert got[12].text == "\n".join(["x"] * 130)
    first = {r.doc_id: r.text for r in line_dedup.cleaned(df, mode="first").collect()}
    assert first[0] == "Head \nbody 0\n\nÀ end" and first[1] == "body 1\n"
    with pytest.raises(ValueError):
        line_dedup.dropped_bits(df, mode="other")
    kept = line_dedup.cleaned(odd, min_docs=2)
    assert kept.columns == odd.columns
    back = sorted((r.doc_id or 0, r.text or "") for r in kept.collect())
    assert len(back) == len(ODD) and sum(t == "same words in here" for _, t in back) == 2  # one document, so its line is in one
    assert line_dedup.cleaned(empty).count() == 0


def test_line_dedup_hot_and_rest_agree(docs, monkeypatch):
    want = {r.doc_id: r._kept for r in line_dedup.deduped(docs.select("doc_id", "text"), 3).collect()}
    for hot in (1, 10**9):
        monkeypatch.setattr(line_dedup, "HOT", hot)
        assert {r.doc_id: r._kept for r in line_dedup.deduped(docs.select("doc_id", "text"), 3).collect()} == want
    count = collections.Counter(k for r in docs.collect() for k in {key_of(x) for x in r.text.split("\n")} if k)
    assert all(want[r.doc_id] == "\n".join(x for x in r.text.split("\n") if count[key_of(x)] < 3) for r in docs.collect())


#: Both have the same xxhash64, whatever is hashed after them.
COLLIDING = ("shared footer li", "'t?wj~o1cgbo%y;7")


def test_lines_of_equal_short_hashes_stay_apart(spark, monkeypatch):
    texts = [f"{COLLIDING[0]}\nbody {i}" for i in range(10)] + [f"{COLLIDING[1]}\nown body"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert df.select(F.xxhash64(F.lit(COLLIDING[0])) == F.xxhash64(F.lit(COLLIDING[1]))).first()[0]
    for mode in ("frequent", "first"):
        for most in (0, 1000):
            monkeypatch.setattr(line_dedup, "MOST_WORDS", most)
            got = {r.doc_id: (r._kept, r._n_dropped) for r in line_dedup.deduped(df, mode=mode).collect()}
            assert got[10] == (texts[10], 0) and got[3] == ("body 3", 1)
            assert got[0] == (("body 0", 1) if mode == "frequent" else (texts[0], 0))
    # rows of one id whose texts collide are two rows
    both = spark.createDataFrame([*enumerate(texts[:10]), (77, COLLIDING[0]), (77, COLLIDING[1])], "doc_id long, text string")
    assert sorted(r._kept for r in line_dedup.deduped(both).collect() if r.doc_id == 77) == ["", COLLIDING[1]]


def test_line_hot_by_lines_of_few_documents(spark, monkeypatch):
    df = spark.createDataFrame([(i, "again\n" * 300 + f"own {i}") for i in range(10)] + [(None, "again"), (None, "again")], "doc_id long, text string")
    for hot in (2, 10**9):
        monkeypatch.setattr(line_dedup, "HOT", hot)
        assert sorted(r._kept for r in line_dedup.deduped(df).collect()) == ["", "", *(f"\nown {i}"[1:] for i in range(10))]


# --- 5 ---------------------------------------------------------------------------------------------------------------


def brute_license(text, signatures):
    w = [x.decode() for x in common.folded_words(text)]
    norm = "".join(" " + x for x in w) + " "
    found = []
    have = {"license" if x == "licence" else x for x in w}
    for i, r in enumerate(signatures):
        if r.keyword in have:
            for m in re.finditer(f" {r.pattern}(?= )", norm):
                s = norm[: m.start()].count(" ")
                found.append((s, -(s + m.group().count(" ")), -r.priority, i, r.label))
    found.sort()
    kept = [x for j, x in enumerate(found) if not any(y[0] <= x[0] and y[1] <= x[1] and y[2] <= x[2] for y in found[:j])]
    base = [x for x in found if x[3] < 4]
    score = {3: 1.0, 2: 0.9, 1: 0.5, 0: 0.0}[max([-x[2] for x in kept], default=0)]
    labels = {x[4] for x in base + kept}
    labels = labels - {"unknown"} or labels
    return len(w), len(base), min([x[0] for x in base], default=None), max([x[0] for x in base], default=None), ",".join(sorted({x[4] for x in base})), ",".join(sorted(labels)), score


def test_license_scan(spark, odd, empty, docs):
    signatures = license_scan.rules()
    assert len(signatures) > 300
    texts = ["GNU General Public License, CC BY-SA 4.0! mit licence MIT License. apache license version 2.0 or later gpl v3 cc by cc by", "License", "aé MIT  license\x00\n see the license file all rights reserved", "apache license " * 700, "Redistribution and use in source and binary forms, with or without modification, are permitted"]
    df = spark.createDataFrame([(100 + i, t, "en", "s", 0) for i, t in enumerate(texts)], DOC).unionByName(docs).unionByName(odd.select(*docs.columns))
    got = collections.Counter((r.doc_id, *tuple(r)[1:]) for r in license_scan.report(license_scan.scan(df)).collect())
    want = collections.Counter((r.doc_id, *brute_license(r.text, signatures)) for r in df.collect())
    assert got == want
    assert license_scan.report(license_scan.scan(empty)).count() == 0
    assert license_scan.scan(odd).where("score = 'kept'").count() == len(ODD)


def test_every_hand_written_signature_finds_its_text(spark):
    from loomspark.llm.license_signatures import SIGNATURES, SPDX

    signatures = license_scan.rules()
    assert len(SIGNATURES) > 250 and len(signatures) > 700 and len({s[3] for s in SIGNATURES}) == len(SIGNATURES)
    assert not any("'" in x for s in SIGNATURES for x in s[:1] + s[3:4])
    cases = [(label, text or pattern, pattern) for label, _, _, pattern, text in SIGNATURES]
    cases += [(x.lower(), f"// SPDX-License-Identifier: {x}\n", None) for x in SPDX]
    rows = [(i, f"Some words before. {text} And words after.") for i, (_, text, _) in enumerate(cases)]
    place = {r.pattern: i for i, r in enumerate(signatures)}
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    said = {r.doc_id: r for r in license_scan.report(license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    for i, (label, text, pattern) in enumerate(cases):
        if pattern is None:
            assert label in said[i].labels.split(",") and said[i].score == 1.0, text
        else:
            assert place[pattern] in {d.rule for d in got[i].found}, text
        want = brute_license(rows[i][1], signatures)
        assert tuple(said[i])[1:] == want, text


# --- 6 ---------------------------------------------------------------------------------------------------------------


def test_toxicity(spark, odd, empty):
    base = "the cat sat on a mat and saw {} tree while {} went by the river for {} days"
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(300)]
    texts, labels = [], []
    for i in range(600):
        y = int(i % 4 == 0)
        t = base.format(*rng.choice(words, 3)) + " " + " ".join(rng.choice(words, 60))
        texts.append((i, t + (" you vile toad " if y else " my kind friend ") + " ".join(rng.choice(words, 20)), "en", "s", 0))
        labels.append((i, y))
    df, lab = spark.createDataFrame(texts, DOC), spark.createDataFrame(labels + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity_kn.train(df, toxicity_kn.learn_rows(lab))
    truth = dict(labels)
    got = toxicity_kn.score(df.unionByName(odd.select(*df.columns)).where("doc_id is null or doc_id > 6 or doc_id in (1, 2)"), model).collect()
    held = [r for r in got if r.doc_id in truth and len(r.text or "") > 20 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(held) > 50 and np.mean([(r.score >= 0.5) == truth[r.doc_id] for r in held]) > 0.95
    assert {r.score for r in got if not (r.text or "").strip()} == {0.0}
    assert toxicity_kn.train(empty, lab) is None and toxicity_kn.train(df, lab.where("toxic = 0")) is None
    assert toxicity_kn.score(df, None).where("score <> 0").count() == 0
    kept = toxicity_kn.accepted(odd, lab)
    assert kept.columns == odd.columns and kept.count() == len(ODD)  # nothing to learn from: nothing goes


def toxic_corpus(seed=6, n=60):
    rng = np.random.default_rng(seed)
    texts = [[int(x) for x in rng.choice(9, int(rng.integers(1, 14)), p=np.arange(9, 0, -1) / 45)] for _ in range(n)]
    y = np.array([int(i % 3 == 0) for i in range(n)])
    return [np.array(t + [9] * (2 * k)) for t, k in zip(texts, y, strict=True)], y, {b"w%d" % i: i for i in range(10)}


def brute_counts(texts, y, label):
    """Distinct words before each word, and before each pair, in the texts of a label (both if None)."""
    triples = {(*p, w) for t, k in zip(texts, y, strict=True) if label in (None, k) for *p, w in zip(["s", "s", *t], ["s", *t], t, strict=False)}
    pairs = collections.Counter((b, w) for _, b, w in triples)
    return pairs, collections.Counter(w for _, w in pairs)


def brute_discount(counts):
    once, twice = sum(x == 1 for x in counts), sum(x == 2 for x in counts)
    return min(max(once / max(once + 2 * twice, 1), 0.05), 0.99)


def test_kneser_ney_probabilities():
    texts, y, number = toxic_corpus()
    n = len(number) + 2
    counts = toxicity_kn.Counts(texts, y, n)
    m = toxicity_kn.ClassModels(counts)
    words, unknown = list(range(10)), n - 1
    shared_pairs = collections.Counter()
    own = [brute_counts(texts, y, k) for k in (0, 1)]
    for pairs, _ in own:
        shared_pairs.update(pairs)
    shared_words = collections.Counter(w for _, w in shared_pairs)
    d = brute_discount(shared_words.values())
    total = sum(shared_words.values())
    base = {w: (max(shared_words[w] - d, 0) + d * len(shared_words) / (n - 1)) / total for w in [*words, unknown]}
    ones = [np.ones(toxicity_kn._CELLS)] * 2
    m.set_words(ones)
    m.set_pairs(ones)
    for k, (pairs, uni) in enumerate(own):
        du, dp, ds = brute_discount(uni.values()), brute_discount(pairs.values()), brute_discount(shared_pairs.values())
        assert 0 < du < 1 and 0 < dp < 1
        p1 = {w: max(uni[w] - du, 0) / sum(uni.values()) + du * len(uni) / sum(uni.values()) * base[w] for w in base}

        def bigrams(pairs, d, before, lower, scale):
            row = {x: c for (b, x), c in pairs.items() if b == before}
            if not row:
                return lower
            out = {w: max(row.get(w, 0) - d, 0) / sum(row.values()) * scale[w] + d * len(row) / sum(row.values()) * p for w, p in lower.items()}
            return {w: p / sum(out.values()) for w, p in out.items()}

        for before in ["s", *words]:
            row = bigrams(pairs, dp, before, bigrams(shared_pairs, ds, before, p1, {w: p1[w] / base[w] for w in p1}), dict.fromkeys(p1, 1))
            b = counts.start if before == "s" else before
            assert math.isclose(sum(row.values()), 1, rel_tol=1e-9)
            for w, p in row.items():
                assert math.isclose(m.probability(k, b, w), p, rel_tol=1e-6)


def test_smoothed_probabilities_sum_to_one_and_features_are_their_ratios():
    texts, y, number = toxic_corpus(7, 90)
    model = toxicity_kn.fit(texts, y, number, np.bincount(y))
    m = toxicity_kn.ClassModels(toxicity_kn.Counts(texts, y, len(number) + 2))
    words, pairs = model["trust"]
    assert all(0 <= t.min() and t.max() <= 1 for t in (*words, *pairs)) and max(t.max() for t in pairs) > 0
    m.set_words(words)
    m.set_pairs(pairs)
    every = [*range(10), m.counts.size - 1]
    for k in (0, 1):
        for before in [*range(10), m.counts.start, m.counts.size - 1]:
            assert math.isclose(sum(m.probability(k, before, w) for w in every), 1, rel_tol=1e-9)
    for t in ([3], [9, 9, 1, 2, 9, 9, 9], [0, 5, 10, 4, 4]):
        ids = [w if w < 10 else m.counts.size - 1 for w in t]
        ratio = [math.log(m.probability(1, b, w) / m.probability(0, b, w)) for b, w in zip([m.counts.start, *ids], ids, strict=False)]
        size = min(toxicity_kn.SPAN, len(t))
        want = max(sum(ratio[i : i + size]) / size for i in range(len(t) - size + 1))
        got = model["models"].features([[b"w%d" % w for w in t]])[0]
        assert math.isclose(got[0], want, abs_tol=5e-3)


def test_score_rises_with_the_difference():
    texts, y, number = toxic_corpus(8, 200)
    model = toxicity_kn.fit(texts, y, number, np.bincount(y))
    score = toxicity_kn.chance(np.linspace(-2, 5, 200)[:, None], model["curve"])
    assert (np.diff(score) >= 0).all() and score[0] < 0.01 and score[-1] > 0.99


def test_toxicity_is_learned_from_documents_that_exist(spark):
    rows = [(i, f"{'vile ' if i % 4 == 0 else ''}plain text {i} " + "words " * (i % 7)) for i in range(80)]
    df = spark.createDataFrame([*rows, (4, "another text of this id"), (4, "another text of this id")], "doc_id long, text string")
    real = [(i, int(i % 4 == 0)) for i in range(80)]
    foreign = spark.range(1000, 60_000).selectExpr("id as doc_id", "cast(id % 2 as int) as toxic")
    labels = spark.createDataFrame(real, "doc_id long, toxic int")
    got, counts = toxicity_kn.sample(df, labels.unionByName(foreign), 50)
    assert len(got) == 70 and counts == {0: 60, 1: 20}
    assert got == toxicity_kn.sample(df, labels, 50)[0]


def test_toxicity_of_long_repeated_and_clashing_rows(spark, odd):
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(100)]
    rows, labels = [], []
    for i in range(10, 410):
        y = int(i % 4 == 0)
        w = list(rng.choice(words, 30))
        if y:
            w.insert(int(rng.integers(30)), "vile")
        rows.append((i, " ".join(w) if i != 12 else " ".join(list(rng.choice(words, 40_000)) + ["vile"]), "en", "s", 0))
        labels.append((i, y))
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    df = spark.createDataFrame(rows, DOC)
    assert max(len(t) for t, _ in toxicity_kn.sample(df, lab)[0]) <= toxicity_kn.LONGEST + toxicity_kn.PIECES
    model = toxicity_kn.train(df, lab)
    assert model["models"].features([b"w1 w2 w3 vile w4".split()])[0, 0] > model["models"].features([b"w1 w2 w3 w5 w4".split()])[0, 0] + 0.1
    many = df.where("doc_id < 20").unionByName(df.where("doc_id < 20")).unionByName(odd.select(*df.columns))
    got = toxicity_kn.score(many, model).collect()
    assert len(got) == 20 + len(ODD) and len({(r.doc_id, r.score) for r in got if (r.doc_id or 0) >= 10}) == 10
    assert all(0 <= r.score <= 1 for r in got)
    scored = toxicity_kn.score(odd, model)
    assert sorted(scored.columns) == sorted(odd.columns) and scored.where("spans = 'kept' and score >= 0").count() == len(ODD)
    assert toxicity_kn.accepted(odd, lab).columns == odd.columns


def test_toxicity_of_an_expression_of_ordinary_words(spark):
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(40)]
    texts, labels = [], []
    for i in range(400):
        y = int(i % 4 == 0)
        w = list(rng.choice(words, 24))
        for at, part in enumerate(["silver lamp"] if y else ["silver", "lamp"]):  # only toxic texts have both in a row
            w.insert(int(rng.integers(1 + 12 * at, 12 + 12 * at)), part)
        texts.append((i, " ".join(w), "en", "s", 0))
        labels.append((i, y))
    df, lab = spark.createDataFrame(texts, DOC), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity_kn.train(df, toxicity_kn.learn_rows(lab))
    held = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    score = toxicity_kn.scored(model, [texts[i][1] for i in held])
    truth = np.array([labels[i][1] for i in held]) == 1
    assert truth.sum() > 10 and (score[truth] >= 0.5).mean() > 0.9 and (score[~truth] < 0.5).mean() > 0.9


def test_toxicity_of_few_texts(spark):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(200)]
    texts, labels = [], []
    for i in range(2400):
        y = int(i % 200 < 2)  # one in a hundred, each with a word that 16 different words precede at most
        w = list(rng.choice(words, 20))
        if y:
            w.insert(10, "vile")
        texts.append((i, " ".join(w), "en", "s", 0))
        labels.append((i, y))
    model = toxicity_kn.train(spark.createDataFrame(texts, DOC), spark.createDataFrame(labels, "doc_id long, toxic int"))
    score = toxicity_kn.scored(model, ["w1 w2 w3 w4 w5 vile w6 w7 w8 w9 w10 w11", "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12"])
    assert score[0] >= 0.5 > score[1]


# --- 7 ---------------------------------------------------------------------------------------------------------------


def brute_groups(rows, n, percent):
    sets = []
    for r in rows:
        w = [x.decode() for x in common.spaced_words(r[1])]
        sets.append({tuple(w[i : i + n]) for i in range(max(len(w) - n, 0) + 1)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    out = {}
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.setdefault((r[0], len(sets[i]), min(ids, default=None) if sets[i] else r[0]), 0)
        out[(r[0], len(sets[i]), min(ids, default=None) if sets[i] else r[0])] += 1
    return out


def families(seed=3):
    """Families of copies with growing edits, chains of links, short texts and texts that share a passage."""
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(2000)]
    out, passage = [], list(rng.choice(words, 60))
    for f in range(12):
        base = list(rng.choice(words, int(rng.integers(3, 150))))
        for c in range(10):
            t = list(base)
            for _ in range(int(len(t) * 0.008 * c)):
                t[int(rng.integers(len(t)))] = str(rng.choice(words))
            out.append(" ".join(t))
            base = t if f % 3 == 0 else base
    out += [" ".join(passage + list(rng.choice(words, 30))) for _ in range(40)] + ["One", "one", "one two", "ONE TWO", "x", None, "", " "]
    return [(i * 3 % 1009, t, "en", "s", 0) for i, t in enumerate(out)]


@pytest.mark.parametrize("n, percent, block", [(3, 85, 512), (5, 80, 4)])
def test_near_dups_equal_brute_force(spark, monkeypatch, n, percent, block):
    monkeypatch.setattr(near_dups, "BLOCK", block)
    if block < 10:
        monkeypatch.setattr(near_dups, "MOST_IDS", 0)
    rows = families()
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in near_dups.groups(spark.createDataFrame(rows, DOC).select("doc_id", "text"), n, percent).collect())
    assert got == collections.Counter(brute_groups(rows, n, percent))


def test_near_dups_odd_rows(odd, empty):
    got = near_dups.groups(odd.select("doc_id", "text"), 3, 85).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == collections.Counter(brute_groups(ODD, 3, 85))
    kept = near_dups.one_each(odd)
    assert kept.columns == odd.columns
    assert near_dups.groups(empty.select("doc_id", "text"), 3, 85).count() == 0 and near_dups.one_each(empty).count() == 0


def heavy(members, seed=8):
    """One text's copies with up to a fifth of the words changed, or left out, and some copies of these copies."""
    rng = np.random.default_rng(seed)
    base = [f"b{i}" for i in range(120)]
    out = []
    for i in range(members):
        t = list(base) if i % 9 or not out else out[int(rng.integers(len(out)))].split(" ")
        for _ in range(int(rng.integers(0, 9))):
            at = int(rng.integers(len(t)))
            t[at : at + 1] = [f"w{rng.integers(1 << 40)}"] if i % 3 else []
        out.append(" ".join(t))
    return [(i, t) for i, t in enumerate(out)]


def matrix_groups(rows, n, percent):
    """Components of all links, by the product of the whole membership matrix."""
    number, sets = {}, []
    for _, t in rows:
        w = t.split(" ")
        sets.append({number.setdefault(tuple(w[i : i + n]), len(number)) for i in range(len(w) - n + 1)})
    m = np.zeros((len(rows), len(number)), np.float32)
    for i, s in enumerate(sets):
        m[i, list(s)] = 1
    inter, size = (m @ m.T).astype(np.int64), m.sum(1).astype(np.int64)
    link = 100 * inter >= percent * (np.add.outer(size, size) - inter)
    label = np.arange(len(rows))
    while True:
        new = np.array([label[x].min() for x in link])
        if (new == label).all():
            return {r[0]: rows[k][0] for r, k in zip(rows, label, strict=True)}
        label = new


def test_near_dups_of_one_large_group_grow_with_its_size(spark, monkeypatch):
    made = []
    plain = near_dups.blocked
    monkeypatch.setattr(near_dups, "blocked", lambda *a: (made.append((out := plain(*a)).count()), out)[1])
    rows = {}
    for members in (1000, 2000):
        docs = heavy(members)
        got = {r.doc_id: r.component_id for r in near_dups.groups(spark.createDataFrame(docs, "doc_id long, text string"), 3, 85).collect()}
        want = matrix_groups(docs, 3, 85)
        assert got == want and len(set(want.values())) > members / 20
        rows[members] = sum(made)
        made.clear()
    assert rows[2000] < 3 * rows[1000], rows


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (102, 101), (7, 7), (50, 50)]
    got = {r.node: r.comp for r in components.components(spark.createDataFrame(chain, "a long, b long"), 10).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}
    assert components.components(spark.createDataFrame([], "a long, b long"), 0).count() == 0


# --- 8 ---------------------------------------------------------------------------------------------------------------


def brute_hits(words, items, n=13):
    hit, found = set(), set()
    for name, w in items:
        size = min(n, len(w))
        for i in range(max(len(w) - n, 0) + 1 if w else 0):
            g = w[i : i + size]
            for j in range(len(words) - size + 1):
                if words[j : j + size] == g:
                    hit.update(range(j, j + size))
                    found.add(name)
    return hit, found


def test_decontaminate_short_items_batches_and_odd_rows(spark, odd, empty):
    items = [("i1", "one two three"), ("i2", "a"), ("i3", " ".join(f"k{i}" for i in range(30))), ("i4", ""), ("i5", None), ("i6", "ONE two, three!"), (None, "lost item"), ("i7", "é ü")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    texts = ["zero one two THREE one two three four", "a-b a", "x " + " ".join(f"k{i}" for i in range(5, 25)) + " y", "k1 k2", "É é ü é ü", "aa", None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    words = [(n, [x.decode() for x in common.folded_words(t)]) for n, t in items if n and t]
    for batch in (1 << 20, 40):
        got = {r.doc_id: r for r in decontaminate.report(decontaminate.find(df, bench, batch_bytes=batch)).collect()}
        for i, t in enumerate(texts):
            w = [x.decode() for x in common.folded_words(t)]
            hit, found = brute_hits(w, words)
            sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
            assert (got[i].n_words, got[i].n_hit, got[i].n_items, got[i].items_sha256, got[i].contaminated) == (len(w), len(hit), len(found), sha, bool(hit) and 20 * len(hit) >= len(w))
    kept = decontaminate.decontaminated(odd, bench)
    assert kept.columns == odd.columns and kept.count() == len(ODD)
    assert decontaminate.decontaminated(empty, bench).count() == 0
    assert decontaminate.find(df, bench.where("false")).where("size(items) > 0").count() == 0


def test_texts_of_equal_short_hashes_take_their_own_hits(spark):
    bench = spark.createDataFrame([("i1", "shared footer li"), ("i2", "some other item"), (None, "lost item")], "item_id string, text string")
    df = spark.createDataFrame([(0, COLLIDING[0]), (1, COLLIDING[1]), (2, "a lost item here")], "doc_id long, text string")
    for batch in (1 << 20, 10):
        got = {r.doc_id: r for r in decontaminate.report(decontaminate.find(df, bench, batch_bytes=batch)).collect()}
        assert [(got[i].n_hit, got[i].n_items, got[i].contaminated) for i in range(3)] == [(3, 1, True), (0, 0, False), (2, 1, True)]
        assert got[2].items_sha256 == hashlib.sha256(b"").hexdigest()


# --- 9 ---------------------------------------------------------------------------------------------------------------


def brute_sum(lattice, text):
    p = [1.0] + [0.0] * len(text)
    for end in range(1, len(text) + 1):
        for start in range(end):
            if (x := lattice.piece.get(text[start:end])) is not None:
                p[end] += p[start] * math.exp(x[0])
        if text[end - 1] not in lattice.piece:
            p[end] += p[end - 1] * math.exp(lattice.unknown(text[end - 1])[0])
    return math.log(p[-1])


def test_lattice_sums(model):
    v = sentencepiece_stream.Vocabulary(model)
    lattice = lattice_lm.Lattice(v, lattice_lm.first_logs(v))
    for w in ("the", "threlyes", "日本", "a😀b", "x"):
        text = "▁" + w
        assert math.isclose(lattice.forward(text), brute_sum(lattice, text), rel_tol=1e-9)
        got = [0.0] * (v.size + 1)
        lattice.expect(text, 2.0, got)
        spelled = sum(got[i] * len(v.pieces[i]) for i in np.flatnonzero(got) if i not in v.byte_id)
        unknown = sum(1 for c in text if c not in v.chars)
        assert math.isclose(spelled, 2.0 * (len(text) - unknown), rel_tol=1e-6)


def test_lattice_scores(docs, odd, empty, model):
    both = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    whole = {(r.doc_id, r.n_tokens): r for r in lattice_lm.scores(both, model, head=50).collect()}
    plain = {(r.doc_id, r.n_tokens): r for r in lattice_lm.scores(both, model, head=10**6).collect()}
    rows = both.collect()
    train = [r for r in rows if r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 10]
    c = collections.Counter(w for r in train for w in [*common.spaced_words(r.text), None])
    n, v = sum(c.values()), len(c)
    for r in rows:
        w = [*common.spaced_words(r.text), None]
        want = sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        for got in (whole[r.doc_id, len(w)], plain[r.doc_id, len(w)]):
            assert got.train_tokens == n and got.n_known == sum(c[x] > 0 for x in w)
            assert math.isclose(got.base_score, want, rel_tol=1e-9)
            assert math.isclose(got.score, whole[r.doc_id, len(w)].score, rel_tol=1e-9) and got.score < 0
    assert lattice_lm.scores(both, model, head=50).count() == len(rows)
    assert lattice_lm.scores(empty.select("doc_id", "text"), model).count() == 0


def segmentations(v, text):
    """All ways to spell a text: lists of ids, with the number of byte pieces' characters spelled in full."""
    if not text:
        return [[]]
    out = []
    for end in range(1, len(text) + 1):
        if text[:end] in v.id:
            out += [[v.id[text[:end]], *rest] for rest in segmentations(v, text[end:])]
    if text[0] not in v.id:
        spelled = [v.id_of_byte[b] for b in lattice_lm.spelled(text[0])]
        out += [[*spelled, *rest] for rest in segmentations(v, text[1:])]
    return out


def test_lattice_scores_and_learning_equal_brute_force(spark, model):
    """Every segmentation of every word, one step of expectation maximisation over the learning rows, then all texts' sums."""
    v = sentencepiece_stream.Vocabulary(model)
    texts = ["the cat sat", "a Cat \U0001f600 x", "", None, "threes the", "the the ▁a", "日本 cat", "sat", "unseen zq", "cats", "x", "the end"] * 2
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("lp", F.lit("kept")).withColumn("word", F.lit(1)).withColumn("row", F.lit(2))
    p = np.exp(lattice_lm.first_logs(v))
    held = [zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(texts))]
    assert 0 < sum(held) < len(held)
    words = [[lattice_lm.escaped(w) for w in common.spaced_words(t)] for t in texts]
    ways = {w: segmentations(v, w) for ws in words for w in ws}
    n = p * lattice_lm.PRIOR
    for ws, h in zip(words, held, strict=True):
        if not h:
            n[-1] += 1
            for w in ws:
                weights = [math.prod(p[i] for i in way) for way in ways[w]]
                for way, x in zip(ways[w], weights, strict=True):
                    for i in way:
                        n[i] += x / sum(weights)
    q = n / n.sum()
    for head in (0, 3, 10**6):
        got = {r.doc_id: r for r in lattice_lm.scores(df, model, head=head).collect()}
        for i, ws in enumerate(words):
            want = math.log10(q[-1]) + sum(math.log10(sum(math.prod(q[j] for j in way) for way in ways[w])) for w in ws)
            assert math.isclose(got[i].score, want, rel_tol=1e-9) and got[i].held_out == held[i]


def test_long_words_take_bounded_memory(model, monkeypatch):
    import tracemalloc

    v = sentencepiece_stream.Vocabulary(model)
    lattice = lattice_lm.Lattice(v, lattice_lm.first_logs(v))
    rng = np.random.default_rng(3)
    word = "".join(rng.choice(list("abcdeXYZ019+/é日😀"), 900))
    want, whole = [0.0] * (v.size + 1), lattice.forward(word)
    lattice.expect(word, 2.0, want)
    for block in (1, 7, 16, 100, 899):
        monkeypatch.setattr(lattice_lm, "BLOCK", block)
        got = [0.0] * (v.size + 1)
        lattice.expect(word, 2.0, got)
        assert math.isclose(lattice.forward(word), whole, rel_tol=1e-12) and np.allclose(got, want, rtol=1e-9, atol=1e-12)
    monkeypatch.setattr(lattice_lm, "BLOCK", 2000)
    peak = []
    for n in (20_000, 160_000):
        word = "".join(rng.choice(list("abcdeXYZ019+/"), n))
        tracemalloc.start()
        lattice.expect(word, 1.0, [0.0] * (v.size + 1))
        peak.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peak[1] < peak[0] + 200_000


def test_a_text_of_one_long_word(spark, model):
    rows = [(1, "QUJD" * 30_000), (2, "日本" * 20_000), (3, "plain words")]
    got = {r.doc_id: r for r in lattice_lm.scores(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert [got[i].n_tokens for i in (1, 2, 3)] == [2, 2, 3] and all(math.isfinite(got[i].score) for i in got) and got[1].score < -10_000


# --- 10 --------------------------------------------------------------------------------------------------------------


def test_language_network(docs, odd, empty):
    truth = {r.doc_id: r.lang for r in docs.collect()}
    net = language_cnn.train(docs.where(~common.held_out(F.col("doc_id"), 5)))
    got = language_cnn.predict(docs, net).collect()
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in got if r.held_out]) > 0.9 and all(0 <= r.score <= 1 for r in got)
    again = language_cnn.predict(odd, net).collect()
    assert len(again) == len(ODD) and {r.lang_pred for r in again if r.doc_id in (1, 2, 3)} == {"und"}
    assert language_cnn.train(empty) is None and language_cnn.predict(empty, net).count() == 0
    assert {r.lang_pred for r in language_cnn.predict(odd, None).collect()} == {"und"}


def test_every_language_is_learned(spark):
    rows = [(i, f"{chr(0x4E00 + i // 4) * 3} l{i // 4} text {i}", f"l{i // 4:03d}") for i in range(1200)]
    net = language_cnn.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), most=300)
    assert net["langs"] == [f"l{k:03d}" for k in range(300)] and net["out"].shape[1] == 300
    few = spark.createDataFrame([(1, "one text", "aa"), (1, "one text", "aa"), (2, "der text", "bb"), (None, "le text", "cc"), (3, None, "dd"), (4, "x", None)], "doc_id long, text string, lang string")
    net = language_cnn.train(few.unionByName(few))
    assert net["langs"] == ["aa", "bb", "cc"]


def brute_network(net, x):
    """Largest sum of each filter over each window, place by place, then the softmax."""
    out = []
    for row in x:
        best = []
        for w in language_cnn.WIDTHS:
            for k in range(language_cnn.FILTERS):
                best.append(max(sum(float(net.filters[w][j, row[i + j], k]) for j in range(w)) for i in range(len(row) - w + 1)))
        z = [float(net.bias[c]) + sum(max(b, 0.0) * float(net.out[i, c]) for i, b in enumerate(best)) for c in range(len(net.langs))]
        e = [math.exp(v - max(z)) for v in z]
        out.append([v / sum(e) for v in e])
    return np.array(out)


def test_network_equals_brute_force_and_its_gradients_are_right():
    net = language_cnn.ByteCNN(["a", "b", "c"], seed=3)
    x = language_cnn.windows("Ein kurzer Text, é 日本 and more of it" * 9)[:2]
    want = brute_network(net, x)
    assert np.allclose(np.exp(language_cnn.log_probs(net.compiled(), x)), want, atol=1e-5)
    y = np.array([2, 0])
    for p in (*net.filters.values(), net.out, net.bias):
        p[...] = p.astype(np.float32)
    loss = lambda: -np.log(brute_network(net, x)[np.arange(2), y]).mean()
    grads = net.gradients(x, y)
    params = [*net.filters.values(), net.out, net.bias]
    rng = np.random.default_rng(1)
    for p, g in zip(params, grads, strict=True):
        at = [np.unravel_index(k, p.shape) for k in np.argsort(-np.abs(g), axis=None)[:2]] + [tuple(rng.integers(s) for s in p.shape)]
        for k in at:
            old, step = p[k].copy(), 1e-2
            p[k] = old + step
            up = loss()
            p[k] = old - step
            down = loss()
            p[k] = old
            assert abs((up - down) / (2 * step) - g[k]) < 2e-3


def test_ties_go_to_the_first_language_and_long_texts_to_their_end(spark):
    net = language_cnn.ByteCNN(["aa", "bb"])
    net.out[:], net.bias[:] = 0, 0
    df = spark.createDataFrame([(1, "word"), (2, "x" * 2_000_000), (2, "x" * 2_000_000)], "doc_id long, text string")
    assert {(r.lang_pred, r.score) for r in language_cnn.predict(df, net.compiled()).collect()} == {("aa", 0.5)}
    assert len(language_cnn.windows("é" * 1000)) == -(-2000 // language_cnn.WINDOW)


def test_compiled_tables_equal_the_filters():
    net = language_cnn.ByteCNN(["a", "b"])
    x = language_cnn.windows("some text é 日本" * 30)
    hidden = np.maximum(net.forward(x)[0], 0)
    want = np.log(language_cnn.softmax(hidden @ net.out + net.bias))
    assert np.allclose(language_cnn.log_probs(net.compiled(), x), want, atol=1e-5)
