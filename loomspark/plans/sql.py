"""SQL that several oracles share: the driver's tables in the shapes that ``proxies`` gives them."""

from __future__ import annotations

_KIND = "CASE p_type WHEN 'ECONOMY' THEN 'function' WHEN 'STANDARD' THEN 'method' WHEN 'MEDIUM' THEN 'class' WHEN 'PROMO' THEN 'interface' WHEN 'SMALL' THEN 'variable' WHEN 'LARGE' THEN 'enum' END"
SYM = f"sym AS (SELECT 'r0' AS repo_id, p_brand AS path, p_partkey::VARCHAR AS fqn, p_name AS name, {_KIND} AS kind, p_size AS start_line FROM part)"
REFS = """pairs AS (SELECT DISTINCT a.l_partkey AS a, b.l_partkey AS b FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey WHERE a.l_linenumber = 1 AND b.l_linenumber = 2),
refs AS (SELECT DISTINCT s.p_brand AS path, a::VARCHAR AS caller_fqn, t.p_name AS callee_name FROM pairs JOIN part s ON s.p_partkey = a JOIN part t ON t.p_partkey = b)"""
FOUND = "found AS (SELECT refs.path AS src_path, caller_fqn AS src_fqn, callee_name, sym.path AS dst_path, sym.fqn AS dst_fqn FROM refs JOIN sym ON sym.name = callee_name AND sym.kind IN ('function', 'method') AND (sym.path <> refs.path OR sym.fqn <> caller_fqn))"
EDGES = "e AS (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey WHERE a.l_linenumber = 1 AND b.l_linenumber = 2 AND a.l_partkey <> b.l_partkey)"
EV = "ev AS (SELECT event_id, epoch_us(ts) AS us, user_id AS service, event_type AS fingerprint, value, props FROM events)"
STATES = """present AS (SELECT doc_id AS path, sha256(text) AS content_hash FROM documents),
stored AS (SELECT doc_id AS path, sha256(CASE WHEN doc_id % 10 = 0 THEN text || '!' ELSE text END) AS content_hash FROM documents WHERE doc_id % 17 <> 0 UNION ALL SELECT -doc_id - 1, sha256(text) FROM documents WHERE doc_id % 13 = 0)"""
REACH = "RECURSIVE {edges}, r(root, node, d) AS (SELECT root, {b}, 1 FROM roots JOIN e ON e.{a} = root UNION SELECT root, e.{b}, d + 1 FROM r JOIN e ON e.{a} = r.node WHERE d < {depth})"

_BM = """w AS (SELECT doc_id, list_concat(list_filter(string_split(lower(regexp_replace(regexp_replace(text, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+', ' ', 'g')), ' '), lambda x: x <> ''), list_transform(list_filter(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda x: regexp_matches(x, '[a-z0-9][A-Z]|_')), lambda x: lower(x))) AS w FROM documents),
t AS (SELECT doc_id, len(w) AS n, {tf} FROM w), st AS (SELECT count(*) AS nd, avg(n) AS m, {df} FROM t),
bm AS (SELECT doc_id, round({score}, 6) AS score FROM t, st WHERE {hit})"""


def bm_sql(words: list[str]) -> str:
    tf = ", ".join(f"len(list_filter(w, lambda x: x = '{q}')) AS tf{i}" for i, q in enumerate(words))
    df = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(words)))
    one = "CASE WHEN tf{0} > 0 THEN ln(1 + (nd - df{0} + 0.5) / (df{0} + 0.5)) * tf{0} * 2.2 / (tf{0} + 1.2 * (0.25 + 0.75 * n / m)) ELSE 0 END"
    return _BM.format(tf=tf, df=df, score=" + ".join(one.format(i) for i in range(len(words))), hit=" OR ".join(f"tf{i} > 0" for i in range(len(words))))


def cosine_sql(k: int, where: str = "true") -> str:
    """top: the ``k`` vectors nearest to that of vec_id 0, among those that ``where`` keeps."""
    return f"q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0), sc AS (SELECT vec_id, label, round(list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]), 5) AS score FROM embeddings, q WHERE {where}), top AS (SELECT * FROM sc ORDER BY score DESC, vec_id LIMIT {k})"
