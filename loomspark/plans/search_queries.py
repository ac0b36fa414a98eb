"""Search over stored state: postings of all documents, and vectors by repository."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ann, embedding, embedding_store, grams, postings, retrieval, vectors
from ..sources.tables import new_folder as _new_folder
from ..sources.tables import table
from . import proxies as P
from .catalog import query
from .sql import EDGES, bm_sql, cosine_sql

WORDS = ["license", "the", "und"]
_INDEXES: dict[tuple, postings.LexicalIndex] = {}
_STORES: dict[tuple, vectors.VectorStore] = {}


def indexed(spark: SparkSession, d: str) -> postings.LexicalIndex:
    """The documents' lexical index: built when a session first searches them, and again when their files change."""
    key = (spark.sparkContext.applicationId, postings.state_of(spark, f"{d}/documents.parquet"))
    if key not in _INDEXES:
        at = _new_folder(spark, "postings")
        _INDEXES[key] = postings.LexicalIndex(spark, at)
        _INDEXES[key].add(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return _INDEXES[key]


def _first_vector(spark, d):
    return list(table(spark, d, "embeddings").where("vec_id = 0").first()["embedding"])


_TOKENS = """i AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS x FROM documents),
p AS (SELECT doc_id, x, list_filter(string_split(lower(regexp_replace(regexp_replace(x, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+', ' ', 'g')), ' '), lambda w: w <> '') AS w FROM i),
tk AS (SELECT doc_id, unnest(w) AS token FROM p UNION ALL SELECT doc_id, lower(x) FROM p WHERE regexp_matches(x, '[a-z0-9][A-Z]|_'))"""


@query(f"WITH {_TOKENS}, n AS (SELECT doc_id, count(*) AS len FROM tk GROUP BY 1) SELECT tk.doc_id AS id, token, count(*) AS tf, max(len)::INT AS len FROM tk JOIN n ON n.doc_id = tk.doc_id GROUP BY ALL")
def postings_index(spark, d):
    """All stored rows: token, document, count and length."""
    blocks = indexed(spark, d).live_postings()
    return blocks.select("id", "token", F.col("tf").cast("long").alias("tf"), "len")


@query(f"WITH {bm_sql(WORDS)} SELECT doc_id, score FROM bm ORDER BY score DESC, doc_id LIMIT 10")
def bm25_topk(spark, d) -> DataFrame:
    return indexed(spark, d).topk(WORDS, 10).select(F.col("id").alias("doc_id"), "score")


_CHANGED = "CASE WHEN doc_id % 7 = 0 THEN 'the license of getUserById ' || doc_id ELSE text END"


@query(f"WITH d AS (SELECT doc_id, {_CHANGED} AS text FROM documents WHERE doc_id % 11 <> 0), {bm_sql(WORDS).replace('FROM documents', 'FROM d')} SELECT doc_id, score FROM bm ORDER BY score DESC, doc_id LIMIT 50")
def bm25_updated(spark, d) -> DataFrame:
    """Top-k of an index of which documents were changed and others removed, each change a new segment, merged at last."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    ix = postings.LexicalIndex(spark, _new_folder(spark, "postings"))
    ix.add(docs.where("doc_id % 2 = 0"), "doc_id")
    ix.add(docs.where("doc_id % 2 = 1"), "doc_id")
    ix.add(docs.where("doc_id % 7 = 0").withColumn("text", F.concat(F.lit("the license of getUserById "), F.col("doc_id").cast("string"))), "doc_id")
    ix.remove(docs.where("doc_id % 11 = 0").select(F.col("doc_id").alias("id")))
    ix.merge(3, ratio=100)
    return ix.topk(WORDS, 50).select(F.col("id").alias("doc_id"), "score")


@query(f"WITH {cosine_sql(50)}, {bm_sql(WORDS)}, a AS (SELECT vec_id AS id, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM top), c AS (SELECT doc_id AS id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM (SELECT * FROM bm ORDER BY score DESC, doc_id LIMIT 50)), x AS (SELECT id, 1.0 / (60 + rank) AS s FROM a UNION ALL SELECT id, 0.7 / (60 + rank) FROM c) SELECT id, round(sum(s), 8)::DOUBLE AS score FROM x GROUP BY id")
def rrf_fuse(spark, d):
    dense = retrieval.cosine_topk(table(spark, d, "embeddings"), _first_vector(spark, d), 50, "vec_id")
    sparse = indexed(spark, d).topk(WORDS, 50)
    return retrieval.fuse([(retrieval.ranked(dense, "vec_id", 50), 1.0), (retrieval.ranked(sparse, "id", 50), 0.7)])


@query("""WITH x AS (SELECT p_partkey, replace(p_name, ' ', '_') || 'ById' || replace(p_brand, '#', '') AS n FROM part)
SELECT p_partkey, list_concat(list_filter(string_split(lower(regexp_replace(regexp_replace(n, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+', ' ', 'g')), ' '), lambda w: w <> ''), [lower(n)]) AS tokens FROM x""")
def code_tokens(spark, d):
    n = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("ById"), F.replace("p_brand", F.lit("#"), F.lit("")))
    return table(spark, d, "part").select("p_partkey", postings.code_tokens(n).alias("tokens"))


_GRAMS = "list_distinct(list_transform(range(1, length({0}) - 1), lambda i: substr({0}, i, 3)))"


@query(f"""WITH n AS (SELECT DISTINCT p_name AS name, '  ' || lower(p_name) || ' ' AS p FROM part), a AS (SELECT DISTINCT replace(p_name, 'e', '') || (p_partkey % 3) AS query FROM part), b AS (SELECT query, '  ' || lower(query) || ' ' AS q FROM a),
t AS (SELECT query, name, {_GRAMS.format('p')} AS x, {_GRAMS.format('q')} AS y FROM n, b), s AS (SELECT query, name, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 5) AS score FROM t) SELECT * FROM s WHERE score >= 0.4""")
def fuzzy_many(spark, d):
    """Names similar to any of many misspelt ones, by the rare grams they share."""
    part = table(spark, d, "part")
    ix = grams.GramIndex.build(part.select(F.col("p_name").alias("name")), _new_folder(spark, "grams"))
    asked = part.select(F.concat(F.replace("p_name", F.lit("e"), F.lit("")), (F.col("p_partkey") % 3).cast("string")).alias("query"))
    return ix.search(asked, 0.4)


# --- vectors: the label's remainder is the repository, the label the path ----------------------------------------------

_STORE = "repo_id long, id long, path string, embedding array<double>"
_V = "v AS (SELECT label % 3 AS repo_id, vec_id AS id, label::VARCHAR AS path, embedding::DOUBLE[] AS e FROM embeddings)"
_SUM = "round(list_sum(e), 6) AS total"


def _vectors(spark, d):
    e = table(spark, d, "embeddings")
    return e.select((F.col("label") % 3).cast("long").alias("repo_id"), F.col("vec_id").alias("id"), F.col("label").cast("string").alias("path"), F.col("embedding").cast("array<double>").alias("embedding"))


def _store(spark, d) -> vectors.VectorStore:
    store = vectors.VectorStore(spark, _new_folder(spark, "vectors"), _STORE)
    rows = _vectors(spark, d)
    store.upsert(rows.drop("embedding"), rows.select("id", "embedding"))
    return store


def _stored(spark, d) -> vectors.VectorStore:
    """The session's store of these vectors, which nothing changes; made when they are first searched."""
    key = (spark.sparkContext.applicationId, postings.state_of(spark, f"{d}/embeddings.parquet"))
    if key not in _STORES:
        _STORES[key] = _store(spark, d)
    return _STORES[key]


_ANN: dict[tuple, tuple[ann.AnnIndex, int]] = {}


def _ann(spark, d) -> tuple[ann.AnnIndex, int]:
    """The session's inverted file of all vectors, with their labels, and the probes that find most of the nearest."""
    key = (spark.sparkContext.applicationId, postings.state_of(spark, f"{d}/embeddings.parquet"))
    if key not in _ANN:
        rows = table(spark, d, "embeddings").select("vec_id", "label", "embedding")
        ix = ann.AnnIndex.build(rows, _new_folder(spark, "ann"), id_col="vec_id")
        _ANN[key] = ix, ix.probes_for(rows, id_col="vec_id")
    return _ANN[key]


def _asked(spark, d):
    return table(spark, d, "embeddings").where("vec_id % 100 = 0")


@query()
def ann_topk(spark, d):
    """The ten nearest of every hundredth vector, in the cells nearest to it; approximate, its recall is tested against ``cosine_batch``."""
    ix, probes = _ann(spark, d)
    return ix.search(_asked(spark, d), 10, probes, id_col="vec_id")


_BATCH = """p AS (SELECT q.vec_id AS query, v.vec_id AS id, round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 5) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0 {where}),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id)::INT AS rank FROM p)"""


@query(f"WITH {_BATCH.format(where='')} SELECT * FROM r WHERE rank <= 10")
def cosine_batch(spark, d):
    """The same by exact scores of all vectors, one pass for all queries."""
    return ann.exact(table(spark, d, "embeddings"), _asked(spark, d), 10, id_col="vec_id")


@query(f"WITH {_BATCH.format(where='AND v.label IN (1, 4)')} SELECT * FROM r WHERE rank <= 10")
def ann_filtered(spark, d):
    """All cells probed and all that a payload filter keeps scored again: then the index gives what an exact search gives."""
    ix = _ann(spark, d)[0]
    n = table(spark, d, "embeddings").count()
    return ix.search(_asked(spark, d), 10, probes=ann.MOST_CELLS, refine=n, where=F.col("label").isin(1, 4), id_col="vec_id")


def _total(rows):
    return rows.select("repo_id", "id", "path", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query(f"WITH {cosine_sql(10, 'label % 3 = 1 AND label IN (1, 4)')} SELECT vec_id AS id, score FROM top")
def cosine_filtered(spark, d):
    """Top-k among one repository's vectors of some paths."""
    return _stored(spark, d).search(1, _first_vector(spark, d), 10, ["1", "4"]).select("id", "score")


@query(f"WITH {_V}, u AS (SELECT repo_id, id, path || '!' AS path, list_transform(e, lambda x: 2 * x) AS e FROM v WHERE id % 5 = 0 UNION ALL SELECT 7, -1 - id, 'new', e FROM v WHERE id < 3) SELECT repo_id, id, path, {_SUM} FROM u UNION ALL SELECT repo_id, id, path, {_SUM} FROM v WHERE id % 5 <> 0")
def vector_upsert(spark, d):
    """A second upsert replaces vectors of the same id and adds new ones, also of a new repository."""
    store, rows = _store(spark, d), _vectors(spark, d)
    changed = rows.where("id % 5 = 0").withColumn("path", F.concat("path", F.lit("!"))).withColumn("embedding", F.transform("embedding", lambda x: 2 * x))
    added = rows.where("id < 3").select(F.lit(7).cast("long").alias("repo_id"), (-1 - F.col("id")).alias("id"), F.lit("new").alias("path"), "embedding")
    new = changed.unionByName(added)
    for _ in range(2):  # the same upsert again changes nothing
        store.upsert(new.drop("embedding"), new.select("id", "embedding"))
    return _total(store.table.rows())


@query(f"WITH {_V} SELECT repo_id, id, path, {_SUM} FROM v WHERE repo_id <> 2 AND NOT (repo_id = 0 AND path IN ('3', '6'))")
def vector_delete(spark, d):
    """Without some paths of one repository and without all of another."""
    store = _store(spark, d)
    store.delete_paths(0, ["3", "6", "nowhere"])
    store.purge_repo(2)
    return _total(store.table.rows())


@query(f"WITH {_V} SELECT repo_id, count(*) AS n FROM v GROUP BY 1 UNION ALL SELECT 9, 0")
def vector_count(spark, d):
    store = _stored(spark, d)
    return spark.createDataFrame([(r, store.count(r)) for r in (0, 1, 2, 9)], "repo_id long, n long")


@query(f"WITH {cosine_sql(10)}, {EDGES}, t AS (SELECT vec_id, score, (row_number() OVER (ORDER BY score DESC, vec_id) - 1)::INT AS rank FROM top) SELECT vec_id, score, rank, CASE WHEN rank < 3 THEN (SELECT count(DISTINCT src) FROM e WHERE dst = vec_id AND src <> vec_id) END AS n_callers, CASE WHEN rank < 3 THEN (SELECT count(DISTINCT dst) FROM e WHERE src = vec_id) END AS n_callees FROM t")
def search_enriched(spark, d):
    """Hits with the neighbourhood of the first three: edges meet these three only."""
    hits = retrieval.cosine_topk(table(spark, d, "embeddings"), _first_vector(spark, d), 10, "vec_id").select("vec_id", "score")
    return retrieval.enriched(hits, P.call_edges(spark, d), 3, "vec_id")


@query(f"WITH {cosine_sql(10)}, {EDGES}, t AS (SELECT vec_id, score, (row_number() OVER (ORDER BY score DESC, vec_id) - 1)::INT AS rank FROM top) SELECT vec_id, score, rank, CASE WHEN rank < 3 THEN coalesce((SELECT string_agg(src, ',' ORDER BY src) FROM e WHERE dst = vec_id), '') END AS callers, CASE WHEN rank < 3 THEN coalesce((SELECT string_agg(dst, ',' ORDER BY dst) FROM e WHERE src = vec_id), '') END AS callees FROM t")
def search_neighbours(spark, d):
    """Hits with the callers and callees themselves of the first three."""
    hits = retrieval.cosine_topk(table(spark, d, "embeddings"), _first_vector(spark, d), 10, "vec_id").select("vec_id", "score")
    out = retrieval.with_neighbours(hits, P.call_edges(spark, d), 3, "vec_id")
    listed = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return out.select("vec_id", "score", "rank", listed("callers"), listed("callees"))


QUESTION, DIMENSION = "Apache license of the data", 64
_KEPT: dict[tuple, embedding_store.EmbeddingStore] = {}


def _kept(spark, d) -> embedding_store.EmbeddingStore:
    """The session's store of the documents' vectors; only contents that it hasn't are embedded."""
    key = (spark.sparkContext.applicationId, postings.state_of(spark, f"{d}/documents.parquet"))
    if key not in _KEPT:
        _KEPT[key] = embedding_store.EmbeddingStore(spark, _new_folder(spark, "contents"), "words", embedding.provider("words", dimension=DIMENSION))
        _KEPT[key].add(table(spark, d, "documents"))
    return _KEPT[key]


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: s: words with their place and sign; dv, qv: whole values of documents and question by place; hits: the ten nearest.
_SEMANTIC = f"""w AS (SELECT doc_id, unnest(string_split({_LOWER.format("text")}, ' ')) AS w FROM documents),
wq AS (SELECT unnest(string_split({_LOWER.format(f"'{QUESTION}'")}, ' ')) AS w),
h AS (SELECT w, ('0x' || substr(md5(w), 1, 8))::BIGINT % {DIMENSION} AS place, CASE WHEN substr(md5(w), 9, 1) < '8' THEN 1 ELSE -1 END AS sign FROM (SELECT w FROM w UNION SELECT w FROM wq) WHERE w <> ''),
dv AS (SELECT doc_id, place, sum(sign)::DOUBLE AS x FROM w JOIN h USING (w) GROUP BY 1, 2),
qv AS (SELECT place, sum(sign)::DOUBLE AS y FROM wq JOIN h USING (w) GROUP BY 1),
dots AS (SELECT doc_id, sum(x * coalesce(y, 0)) AS dot, sqrt(sum(x * x)) AS own FROM dv LEFT JOIN qv USING (place) GROUP BY 1),
sc AS (SELECT d.doc_id, round(CASE WHEN own > 0 THEN dot / (own * (SELECT sqrt(sum(y * y)) FROM qv)) ELSE 0 END, 5) AS score FROM documents d LEFT JOIN dots USING (doc_id)),
t AS (SELECT doc_id, score, (row_number() OVER (ORDER BY score DESC, doc_id) - 1)::INT AS rank FROM sc QUALIFY rank < 10)"""


@query(f"WITH {_SEMANTIC}, {EDGES} SELECT doc_id, score, rank, CASE WHEN rank < 3 THEN coalesce((SELECT string_agg(src, ',' ORDER BY src) FROM e WHERE dst = doc_id), '') END AS callers, CASE WHEN rank < 3 THEN coalesce((SELECT string_agg(dst, ',' ORDER BY dst) FROM e WHERE src = doc_id), '') END AS callees FROM t")
def semantic_neighbours(spark, d):
    """From a question to hits with the neighbourhood of the first three: whole texts embedded once by content, the question by the same model."""
    hits = _kept(spark, d).search(table(spark, d, "documents"), QUESTION, 10, "doc_id")
    out = retrieval.with_neighbours(hits, P.call_edges(spark, d), 3, "doc_id")
    listed = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return out.select("doc_id", "score", "rank", listed("callers"), listed("callees"))


@query("SELECT lang, source, count(*) AS n_docs, count(DISTINCT coalesce(text, '')) AS n_contents, count(DISTINCT coalesce(text, '')) AS n_vectors FROM documents GROUP BY 1, 2")
def embedded_contents(spark, d):
    """Of each language and source, rows, distinct contents and those of them that have a vector in the store."""
    docs = table(spark, d, "documents").select("lang", "source", embedding_store.digest_of("text").alias("digest"))
    each = docs.groupBy("lang", "source", "digest").agg(F.count(F.lit(1)).alias("n"))
    held = _kept(spark, d).vectors().select("digest", F.lit(1).alias("v"))
    return each.join(held, "digest", "left").groupBy("lang", "source").agg(F.sum("n").alias("n_docs"), F.count(F.lit(1)).alias("n_contents"), F.count("v").alias("n_vectors"))
