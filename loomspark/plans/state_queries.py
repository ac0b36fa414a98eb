"""Queries of graph answers in full, of runs and jobs, of severities and of product state."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import graph, incremental, logs, product, retrieval, traverse
from ..sources.files import normalised
from ..sources.tables import table
from . import proxies as P
from .catalog import query
from .sql import EDGES, EV, REACH, STATES, cosine_sql

# --- graph answers ---------------------------------------------------------------------------------------------------

_KIND = "CASE p_type WHEN 'ECONOMY' THEN 'function' WHEN 'STANDARD' THEN 'method' WHEN 'MEDIUM' THEN 'class' WHEN 'PROMO' THEN 'interface' WHEN 'SMALL' THEN 'variable' WHEN 'LARGE' THEN 'enum' END"
_NODES = f"nd AS (SELECT p_partkey AS id, p_partkey::VARCHAR AS fqn, p_name AS name, {_KIND} AS kind, p_brand AS path, p_name || '(' || p_size || ')' AS signature FROM part)"
#: Roots: the least callee, the callee with most callers, and one that is no node.
_ROOTS = "h AS (SELECT dst, count(*) AS n FROM e GROUP BY dst), roots AS (SELECT min(dst) AS root FROM e UNION SELECT arg_min(dst, (-n, dst)) FROM h UNION SELECT -1)"
_TEXT = "fqn || '/' || name || '/' || kind || '/' || path"


def _nodes(spark, d):
    p = P.symbols(spark, d).select(F.col("fqn").cast("long").alias("id"), "fqn", "name", "kind", "path", "start_line")
    return p.withColumn("signature", F.concat("name", F.lit("("), F.col("start_line").cast("string"), F.lit(")"))).drop("start_line")


def _roots(spark, d):
    n = P.call_edges(spark, d).groupBy("dst").agg(F.count(F.lit(1)).alias("n"))
    one = n.agg(F.min("dst").alias("a"), F.min_by("dst", F.struct(-F.col("n"), "dst")).alias("b"))
    return one.select(F.explode(F.array_distinct(F.array("a", "b", F.lit(-1).cast("long")))).alias("root"))


def _listed(c):
    return F.array_join(F.sort_array(F.transform(c, lambda x: F.concat_ws("/", x["fqn"], x["name"], x["kind"], x["path"]))), ";")


@query(f"""WITH {REACH.format(edges=f'{EDGES}, {_NODES}, {_ROOTS}', a='src', b='dst', depth=2)},
k(root, node, d) AS (SELECT root, src, 1 FROM roots JOIN e ON e.dst = root UNION SELECT root, e.src, d + 1 FROM k JOIN e ON e.dst = k.node WHERE d < 2),
c AS (SELECT root, string_agg(x, ';' ORDER BY x) AS l FROM (SELECT DISTINCT root, {_TEXT} AS x FROM r JOIN nd ON id = node) GROUP BY root),
b AS (SELECT root, string_agg(x, ';' ORDER BY x) AS l FROM (SELECT DISTINCT root, {_TEXT} AS x FROM k JOIN nd ON id = node) GROUP BY root)
SELECT roots.root, id IS NOT NULL AS found, {_TEXT} || '/' || signature AS symbol, CASE WHEN id IS NOT NULL THEN coalesce(c.l, '') END AS callees, CASE WHEN id IS NOT NULL THEN coalesce(b.l, '') END AS callers
FROM roots LEFT JOIN nd ON id = roots.root LEFT JOIN c ON c.root = roots.root LEFT JOIN b ON b.root = roots.root""")
def neighborhood_full(spark, d):
    """found, the root with its signature, callees and callers with name, kind and path; an unknown root isn't found."""
    out = traverse.neighborhood_of(P.call_edges(spark, d), _nodes(spark, d), _roots(spark, d), 2)
    symbol = F.when(F.col("found"), F.concat_ws("/", *[F.col(f"symbol.{c}") for c in (*traverse.NODE, "signature")]))
    return out.select("root", "found", symbol.alias("symbol"), _listed(F.col("callees")).alias("callees"), _listed(F.col("callers")).alias("callers"))


@query(f"""WITH {REACH.format(edges=f'{EDGES}, {_NODES}, {_ROOTS}', a='dst', b='src', depth=3)},
n AS (SELECT DISTINCT root, node FROM r),
c AS (SELECT n.root, count(*) AS dependent_count, count(*) FILTER (a.path <> b.path) AS cross_file_count FROM n JOIN nd a ON a.id = n.root JOIN nd b ON b.id = n.node GROUP BY n.root),
t AS (SELECT root, fqn, name, kind, path, row_number() OVER (PARTITION BY root ORDER BY path, fqn, node) AS i FROM n JOIN nd ON id = node),
l AS (SELECT root, string_agg({_TEXT}, ';' ORDER BY i) AS l, count(*) AS listed FROM t WHERE i <= 100 GROUP BY root)
SELECT roots.root, id IS NOT NULL AS found, {_TEXT} AS symbol, CASE WHEN id IS NOT NULL THEN coalesce(dependent_count, 0) END AS dependent_count, CASE WHEN id IS NOT NULL THEN coalesce(cross_file_count, 0) END AS cross_file_count,
  CASE WHEN id IS NOT NULL THEN round(least(1.0, (coalesce(dependent_count, 0) + coalesce(cross_file_count, 0)) / 50.0), 3)::DOUBLE END AS risk_score, l.l AS dependents, coalesce(listed, 0) AS listed
FROM roots LEFT JOIN nd ON id = roots.root LEFT JOIN c ON c.root = roots.root LEFT JOIN l ON l.root = roots.root""")
def impact_full(spark, d):
    """Impact of a root with few and one with many dependents (more than are listed on larger data), and of an unknown one."""
    out = traverse.impact_of(P.call_edges(spark, d), _nodes(spark, d), _roots(spark, d), 3)
    text = F.array_join(F.transform("dependents", lambda x: F.concat_ws("/", x["fqn"], x["name"], x["kind"], x["path"])), ";")
    symbol = F.when(F.col("found"), F.concat_ws("/", *[F.col(f"symbol.{c}") for c in traverse.NODE]))
    return out.select("root", "found", symbol.alias("symbol"), "dependent_count", "cross_file_count", "risk_score", text.alias("dependents"), F.coalesce(F.size("dependents"), F.lit(0)).cast("long").alias("listed"))


@query(f"WITH {REACH.format(edges=f'{EDGES}, roots AS (SELECT min(dst) AS root FROM e)', a='dst', b='src', depth=3)}, n AS (SELECT root, node, min(d) AS depth FROM r GROUP BY ALL), w AS (SELECT src, max(1.0 / k)::DOUBLE AS confidence FROM (SELECT src, count(*) OVER (PARTITION BY dst) AS k FROM e) GROUP BY src) SELECT root, round(sum(pow(0.5, depth) * confidence * (1 + node % 3)), 6) AS risk FROM n JOIN w ON w.src = node GROUP BY root")
def impact_weighted(spark, d):
    """Risk by distance, confidence of the edge and churn of the dependent."""
    e = P.call_edges(spark, d)
    n = e.groupBy("dst").agg(F.count(F.lit(1)).alias("k"))
    weighed = e.join(n, "dst").select("src", "dst", (F.lit(1.0) / F.col("k")).alias("confidence"))
    churn = P.paths(spark, d).select("id", (F.col("id") % 3).alias("churn"))
    return traverse.weighted_risk(weighed, e.agg(F.min("dst").alias("root")), churn, 3)


@query(f"WITH {REACH.format(edges=f'{EDGES}, {_NODES}, {_ROOTS}', a='dst', b='src', depth=3)}, ch AS (SELECT DISTINCT p_brand AS path FROM part WHERE p_size > 48), n AS (SELECT DISTINCT root, node FROM r) SELECT root, path, count(*) AS dependents FROM n JOIN nd ON id = node WHERE path IN (FROM ch) GROUP BY ALL")
def impact_recent(spark, d):
    """Dependents in recently changed files."""
    changed = table(spark, d, "part").where("p_size > 48").select(F.col("p_brand").alias("path")).distinct()
    found = traverse.reach(P.call_edges(spark, d), _roots(spark, d), 3, reverse=True)
    return traverse.recently_changed(found, _nodes(spark, d), changed)


_HREF = """im AS (SELECT DISTINCT url AS path, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS module FROM pages)"""


@query(f"WITH {_HREF}, c AS (SELECT url AS path FROM pages WHERE page_id % 9 = 0), md AS (SELECT DISTINCT module, url AS path FROM im JOIN pages ON page_id = (length(module) * 31 + unicode(substr(module, 2, 1))) % 97) SELECT DISTINCT path FROM im WHERE module IN (SELECT module FROM md WHERE path IN (FROM c)) AND path NOT IN (FROM c)")
def reresolution_ripple(spark, d):
    """Files to be resolved again as they import a changed one; a link stands for a module, which lies in one page."""
    pages = table(spark, d, "pages")
    imports = pages.select(F.col("url").alias("path"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("module")).distinct()
    place = (F.length("module") * 31 + F.ascii(F.substring("module", 2, 1))) % 97
    modules = imports.select("module").distinct().withColumn("page_id", place).join(pages.select("page_id", F.col("url").alias("path")), "page_id").select("module", "path")
    return incremental.ripple(pages.where("page_id % 9 = 0").select(F.col("url").alias("path")), imports, modules)


@query("WITH sym AS (SELECT p_brand AS path, p_partkey::VARCHAR AS fqn FROM part UNION ALL SELECT DISTINCT p_brand, '<module>' FROM part) SELECT 'r0' AS repo_id, path, 'DEFINES' AS type, fqn AS dst_fqn FROM sym WHERE path NOT LIKE 'Brand#1%'")
def defines_edges(spark, d):
    files = P.files(spark, d)
    return graph.defines(graph.all_symbols(files, P.symbols(spark, d)), files.where("path not like 'Brand#1%'"))


@query(f"WITH {EDGES}, n AS (SELECT p_partkey, p_brand, row_number() OVER (ORDER BY p_brand, p_partkey) AS i FROM part), t AS (SELECT p_brand, count(*) AS c FROM part GROUP BY 1) SELECT p_brand AS path, c AS symbols, (row_number() OVER (ORDER BY p_brand))::INT AS position FROM t")
def tree_in_order(spark, d):
    """The tree by path, each file with its place in that order."""
    rows = graph.file_tree(P.files(spark, d), P.symbols(spark, d))
    return rows.select("path", "symbols", F.row_number().over(Window.partitionBy("repo_id").orderBy("path")).alias("position"))


@query("SELECT o_orderkey AS id, o_custkey AS org_id, epoch_us(o_orderdate) AS created_us, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey))::INT AS position FROM orders")
def newest_first(spark, d):
    """Rows of each org, the newest first."""
    o = table(spark, d, "orders")
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("org_id"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("created_us"), F.row_number().over(w).alias("position"))


# --- four labels, purged -----------------------------------------------------------------------------------------------

_REPO = "p_size % 4"


@query(f"""WITH s AS (SELECT {_REPO} AS repo_id, p_brand AS path, p_partkey AS fqn FROM part),
x AS (SELECT DISTINCT repo_id, path, 'File' AS label, '' AS name FROM s UNION ALL SELECT repo_id, path, 'Symbol', fqn::VARCHAR FROM s UNION ALL SELECT repo_id, path, 'Edge', fqn::VARCHAR FROM s WHERE fqn % 2 = 0 UNION ALL SELECT DISTINCT repo_id, path, 'Import', 'm' FROM s)
SELECT repo_id, label, count(*) AS n FROM x WHERE repo_id <> 3 AND NOT (repo_id = 1 AND path LIKE 'Brand#2%') GROUP BY ALL""")
def graph_store(spark, d):
    """Files, symbols, edges and imports written by repository; files deleted in one, another purged from all four."""
    from ..sources.graphs import GraphStore
    from .search_queries import _new_folder

    store = GraphStore(spark, _new_folder(spark, "graph"))
    part = table(spark, d, "part").select((F.col("p_size") % 4).cast("string").alias("repo_id"), F.col("p_brand").alias("path"), F.col("p_partkey").cast("string").alias("fqn"))
    none = F.lit(None).cast("string")
    files = part.select("repo_id", "path", F.lit("python").alias("language"), F.lit("h").alias("content_hash")).distinct()
    symbols = part.select("repo_id", "path", "fqn", F.col("fqn").alias("name"), F.lit("function").alias("kind"))
    edges = part.where("fqn % 2 = 0").select("repo_id", F.lit("CALLS").alias("type"), F.col("path").alias("src_path"), F.col("fqn").alias("src_fqn"), F.col("path").alias("dst_path"), F.col("fqn").alias("dst_fqn"), none.alias("dst_name"), F.lit(1.0).alias("confidence"))
    imports = files.select("repo_id", "path", F.lit("m").alias("module"))
    for _ in range(2):  # writing the same again changes nothing
        store.write(files, symbols, edges, imports)
    store.delete_files(files.where("repo_id = '1' and path like 'Brand#2%'").select("repo_id", "path"))
    store.purge("3")
    return store.counts().select(F.col("repo_id").cast("int").alias("repo_id"), "label", "n")


# --- runs and jobs -------------------------------------------------------------------------------------------------------

_JOB = "CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'succeeded' WHEN 'error' THEN 'failed' ELSE 'running' END"


def _job_events(spark, d):
    state = F.element_at(F.create_map(*[F.lit(x) for kv in {"view": "queued", "click": "running", "purchase": "succeeded", "error": "failed"}.items() for x in kv]), F.col("fingerprint"))
    return P.events(spark, d).select("event_id", "us", F.col("service").alias("job_id"), F.coalesce(state, F.lit("running")).alias("status"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("error"))


@query(f"""WITH j AS (SELECT event_id, epoch_us(ts) AS us, user_id AS job_id, {_JOB} AS status, 'e' || event_id AS error FROM events)
SELECT job_id, arg_max(status, (us, event_id)) AS status, min(us) FILTER (status = 'running') AS started_at, max(us) FILTER (status IN ('succeeded', 'failed')) AS finished_at,
  CASE WHEN arg_max(status, (us, event_id)) = 'failed' THEN arg_max(error, (us, event_id)) END AS error FROM j GROUP BY job_id""")
def job_states(spark, d):
    """Jobs folded from their events: status, start, end and error."""
    return incremental.runs_of(_job_events(spark, d), "job_id", ["us", "event_id"], at="us")


def _steps_sql(steps: dict) -> str:
    first = next(iter(steps))
    cases = " ".join(f"WHEN before = '{s}' THEN status IN ({', '.join(repr(x) for x in following)})" if following else f"WHEN before = '{s}' THEN false" for s, following in steps.items())
    return f"CASE WHEN before IS NULL THEN status = '{first}' {cases} ELSE false END"


@query(f"WITH j AS (SELECT event_id, epoch_us(ts) AS us, user_id AS job_id, {_JOB} AS status FROM events), b AS (SELECT *, lag(status) OVER (PARTITION BY job_id ORDER BY us, event_id) AS before FROM j) SELECT before, status, {_steps_sql(logs.JOB_STEPS)} AS allowed, count(*) AS n FROM b GROUP BY ALL")
def job_transitions(spark, d):
    """Steps between a job's states, and which are allowed."""
    rows = logs.checked_transitions(_job_events(spark, d), "job_id", "status", logs.JOB_STEPS)
    return rows.groupBy("before", "status", "allowed").agg(F.count(F.lit(1)).alias("n"))


_INC = "CASE event_type WHEN 'view' THEN 'open' WHEN 'click' THEN 'investigating' WHEN 'purchase' THEN 'mitigated' ELSE 'resolved' END"


@query(f"WITH j AS (SELECT event_id, epoch_us(ts) AS us, user_id AS incident, {_INC} AS status FROM events), b AS (SELECT *, lag(status) OVER (PARTITION BY incident ORDER BY us, event_id) AS before FROM j) SELECT incident, count(*) FILTER ({_steps_sql(logs.INCIDENT_STEPS)}) AS allowed, count(*) AS steps FROM b GROUP BY 1")
def incident_steps(spark, d):
    """Of each incident, how many of its steps are allowed."""
    state = F.element_at(F.create_map(*[F.lit(x) for kv in {"view": "open", "click": "investigating", "purchase": "mitigated"}.items() for x in kv]), F.col("fingerprint"))
    e = P.events(spark, d).select("event_id", "us", F.col("service").alias("incident"), F.coalesce(state, F.lit("resolved")).alias("status"))
    return logs.checked_transitions(e, "incident", "status", logs.INCIDENT_STEPS).groupBy("incident").agg(F.count_if("allowed").alias("allowed"), F.count(F.lit(1)).alias("steps"))


@query(f"""WITH {STATES}, c AS (SELECT coalesce(p.path, s.path) AS path, coalesce(p.path, s.path) % 4 AS run, CASE WHEN s.path IS NULL THEN 'added' WHEN p.path IS NULL THEN 'deleted' WHEN p.content_hash <> s.content_hash THEN 'changed' ELSE 'unchanged' END AS change FROM present p FULL JOIN stored s ON p.path = s.path),
f AS (SELECT run, path FROM c WHERE change IN ('added', 'changed')), t AS (SELECT doc_id AS path, len(string_split(text, ' ')) AS w, len(string_split(text, chr(10))) AS l FROM documents)
SELECT c.run, count(*) FILTER (change IN ('added', 'changed')) AS files_indexed, count(*) FILTER (change = 'deleted') AS files_deleted,
  coalesce((SELECT sum(l)::BIGINT FROM t JOIN f ON f.path = t.path WHERE f.run = c.run), 0) AS symbol_count, coalesce((SELECT sum(w)::BIGINT FROM t JOIN f ON f.path = t.path WHERE f.run = c.run), 0) AS chunks_embedded FROM c GROUP BY c.run""")
def run_statistics(spark, d):
    """What each run indexed and deleted, with the symbols (lines stand for them) and chunks (words) of the files it indexed."""
    changes = incremental.diff(P.file_states(spark, d), P.older_states(spark, d)).withColumn("run", F.col("path") % 4)
    docs = table(spark, d, "documents").select((F.col("doc_id") % 4).alias("run"), F.col("doc_id").alias("path"), "text")
    parts = lambda mark: docs.select("run", "path", F.explode(F.split("text", mark, -1)))
    return incremental.run_statistics(changes, parts("\n"), parts(" "), ["run"])


@query(f"WITH j AS (SELECT event_id, epoch_us(ts) AS us, user_id AS job_id, {_JOB} AS status FROM events), l AS (SELECT job_id, arg_max(status, (us, event_id)) AS s FROM j GROUP BY 1) SELECT c_custkey AS id, CASE l.s WHEN 'succeeded' THEN 'indexed' WHEN 'failed' THEN 'error' WHEN 'running' THEN 'indexing' WHEN 'queued' THEN 'pending' ELSE 'never' END AS index_status FROM customer LEFT JOIN l ON job_id = c_custkey")
def status_propagated(spark, d):
    """A repository's status follows the last callback of its job."""
    last = incremental.runs_of(_job_events(spark, d), "job_id", ["us", "event_id"], at="us").select(F.col("job_id").alias("id"), "status")
    repos = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit("never").alias("index_status"))
    return incremental.propagated(repos, "id", "index_status", last, "status", {"succeeded": "indexed", "failed": "error", "running": "indexing", "queued": "pending"}, "never")


@query("SELECT o_orderkey AS id, (epoch_ms(o_orderdate + INTERVAL 90 MINUTE) - epoch_ms(o_orderdate))::BIGINT AS elapsed_ms, epoch_us(o_orderdate + INTERVAL 3600 SECOND) AS expires_us FROM orders")
def elapsed_and_ttl(spark, d):
    o = table(spark, d, "orders")
    start = F.col("o_orderdate").cast("timestamp")
    return o.select(F.col("o_orderkey").alias("id"), S.elapsed_ms(start, start + F.expr("INTERVAL 90 MINUTES")).alias("elapsed_ms"), F.unix_micros(start + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(3600))).alias("expires_us"))


# --- severities ----------------------------------------------------------------------------------------------------------

_SEV = "CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'WARN' WHEN 'signup' THEN 'fatal' ELSE 'info' END"
_ES = f"es AS (SELECT event_id, epoch_us(ts) AS us, user_id % 20 AS service, event_type AS fingerprint, {_SEV} AS severity FROM events)"


def _severe(spark, d):
    severity = F.when(F.col("fingerprint") == "error", "error").when(F.col("fingerprint") == "purchase", "WARN").when(F.col("fingerprint") == "signup", "fatal").otherwise("info")
    return P.events(spark, d).select("event_id", "us", (F.col("service") % 20).alias("service"), "fingerprint", severity.alias("severity"))


_FOLD = "z AS (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY day) AS r FROM dy), bl AS (WITH RECURSIVE b AS (SELECT {k}, 2 AS r, events::DOUBLE AS m FROM z WHERE r = 1 UNION ALL SELECT {bk}, b.r + 1, b.m * 0.7::DOUBLE + z.events::DOUBLE * 0.3::DOUBLE FROM b JOIN z ON {on} AND z.r = b.r) SELECT * FROM b), base AS (SELECT {zk}, z.day, z.events::DOUBLE AS events, round(m, 6) AS baseline FROM z LEFT JOIN bl b ON {on} AND b.r = z.r)"


def _fold_sql(keys: list[str]) -> str:
    return _FOLD.format(k=", ".join(keys), bk=", ".join(f"b.{k}" for k in keys), zk=", ".join(f"z.{k}" for k in keys), on=" AND ".join(f"z.{k} = b.{k}" for k in keys))


@query(f"WITH {_ES}, dy AS (SELECT fingerprint, service, (us // 86400000000)::BIGINT AS day, count(*) AS events FROM es GROUP BY ALL), {_fold_sql(['fingerprint', 'service'])} SELECT * FROM base")
def ewma_by_service(spark, d):
    """Daily rates and baselines by fingerprint and service."""
    keys = ["fingerprint", "service"]
    return logs.ewma(logs.daily(_severe(spark, d), keys), keys, "day", "events")


@query(f"WITH {_ES}, dy AS (SELECT fingerprint, service, (us // 86400000000)::BIGINT AS day, count(*) AS events FROM es WHERE severity IN ('error', 'fatal') GROUP BY ALL), {_fold_sql(['fingerprint', 'service'])} SELECT * FROM base WHERE events > 1.5 * baseline")
def burst_errors(spark, d):
    """Bursts of events of severity error or graver, by fingerprint and service."""
    return logs.error_bursts(_severe(spark, d), ["fingerprint", "service"], "severity", 1.5)


@query(f"WITH {_ES}, m AS (SELECT min(us) + 86400000000 / 8 AS t FROM es), f AS (SELECT service, fingerprint, min(us) AS first_us, min(us) FILTER (lower(severity) IN ('warn', 'error', 'fatal')) AS grave_us FROM es GROUP BY ALL) SELECT service, fingerprint, first_us, grave_us FROM f, m WHERE first_us >= t::BIGINT AND grave_us IS NOT NULL")
def novelty_grave(spark, d):
    """Fingerprints of a service first seen after a time, at severity warn or graver."""
    e = _severe(spark, d)
    since = e.agg(F.min("us")).first()[0]
    return logs.grave_novelties(e, ["service", "fingerprint"], "severity", (since or 0) + logs.HOUR * 3)


@query(f"WITH {EV}, m AS (SELECT min(us) AS t FROM ev) SELECT event_id, us, service FROM ev, m WHERE fingerprint = 'error' AND us >= t + 86400000000 AND us < t + 5 * 86400000000")
def logs_in_range(spark, d):
    e = P.events(spark, d)
    start = e.agg(F.min("us")).first()[0] or 0
    return logs.in_range(e, start + 24 * logs.HOUR, start + 5 * 24 * logs.HOUR, fingerprint="error").select("event_id", "us", "service")


# --- retrieval -------------------------------------------------------------------------------------------------------------


@query(f"WITH {cosine_sql(5)}, {EDGES}, b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), sb AS (SELECT a.vec_id AS id, max(t.score) AS score FROM embeddings a JOIN embeddings o ON o.label = a.label JOIN top t ON t.vec_id = o.vec_id GROUP BY 1), x AS (SELECT vec_id AS id, score FROM top UNION ALL SELECT dst, score * 0.5 FROM top JOIN b ON src = vec_id UNION ALL SELECT id, score * 0.5 FROM sb) SELECT id, round(max(score), 6) AS score FROM x GROUP BY id")
def expand_siblings(spark, d):
    """Hits, their callers, callees and siblings (of the same label)."""
    e = table(spark, d, "embeddings")
    vector = list(e.where("vec_id = 0").first()["embedding"])
    seeds = retrieval.cosine_topk(e, vector, 5, "vec_id").select(F.col("vec_id").alias("id"), "score")
    return retrieval.expand(seeds, P.call_edges(spark, d), 0.5, e.select(F.col("vec_id").alias("id"), F.col("label").alias("parent")))


@query("WITH h AS (SELECT p_brand AS path, p_size AS first, p_size + p_partkey % 12 AS last, p_partkey AS rank FROM part) SELECT path, first, last, rank FROM h WHERE NOT EXISTS (SELECT 1 FROM h b WHERE b.path = h.path AND b.first <= h.first AND b.last >= h.last AND b.rank < h.rank)")
def overlaps_removed(spark, d):
    """Hits whose span lies within that of a better hit of the same file go."""
    p = table(spark, d, "part")
    hits = p.select(F.col("p_brand").alias("path"), F.col("p_size").alias("first"), (F.col("p_size") + F.col("p_partkey") % 12).alias("last"), F.col("p_partkey").alias("rank"))
    return retrieval.without_overlaps(hits, "path", "first", "last", "rank")


_ANCHORS = {"identifiers": "[a-z]+[A-Z][A-Za-z0-9]*", "paths": "[A-Za-z0-9_.-]+/[A-Za-z0-9_./-]+", "tickets": "[A-Z][A-Z]+-[0-9]+", "errors": "[A-Z][A-Za-z]*(?:Error|Exception)"}


@query("WITH t AS (SELECT p_partkey, 'see ABC-' || p_size || ' in src/' || replace(p_name, ' ', '_') || '.py: getItem' || p_size || ' raised ValueError' AS q FROM part) SELECT p_partkey, " + ", ".join(f"regexp_extract_all(q, '{x}') AS {n}" for n, x in _ANCHORS.items()) + " FROM t")
def query_anchors(spark, d):
    """Identifiers, paths, ticket numbers and error names of questions."""
    q = F.concat(F.lit("see ABC-"), F.col("p_size").cast("string"), F.lit(" in src/"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(".py: getItem"), F.col("p_size").cast("string"), F.lit(" raised ValueError"))
    return table(spark, d, "part").select("p_partkey", *[F.regexp_extract_all(q, F.lit(x), F.lit(0)).alias(n) for n, x in _ANCHORS.items()])


# --- product -----------------------------------------------------------------------------------------------------------------


@query("WITH b AS (SELECT p_partkey AS id, CASE WHEN s = '' THEN 'project' ELSE s END AS base FROM (SELECT p_partkey, substr(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 48) AS s FROM part)), f AS (SELECT base, min(id) AS id FROM b GROUP BY 1) SELECT b.id, CASE WHEN f.id = b.id THEN b.base ELSE b.base || '-' || substr(sha256(b.id::VARCHAR), 1, 6) END AS slug FROM b JOIN f ON f.base = b.base")
def free_slugs(spark, d):
    """Slugs: the first of a name takes it, later ones get a suffix."""
    b = table(spark, d, "part").select(F.col("p_partkey").alias("id"), S.slug(F.col("p_name")).alias("base"))
    first = b.groupBy("base").agg(F.min("id").alias("first"))
    return b.join(first, "base").select("id", S.free_slug(F.col("base"), F.col("id") != F.col("first"), F.col("id")).alias("slug"))


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 AND url LIKE 'https://%' THEN 'https://oauth2:t' || page_id || '@' || regexp_replace(regexp_replace(url, '/+$', ''), '^https://', '') ELSE regexp_replace(url, '/+$', '') END AS clone_url FROM pages")
def clone_urls(spark, d):
    p = table(spark, d, "pages")
    token = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("t"), F.col("page_id").cast("string")))
    return p.select("page_id", S.with_token(F.col("url"), "oauth2", token).alias("clone_url"))


@query("SELECT o_orderkey AS id, c_custkey IS NOT NULL AS accepted FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_nationkey < 12) ON c_custkey = o_custkey")
def insert_checked(spark, d):
    """Rows are inserted where the project belongs to the org, and refused elsewhere."""
    new = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("project_id"))
    yes, no = incremental.insert_where(new, table(spark, d, "customer").where("c_nationkey < 12").select(F.col("c_custkey").alias("project_id")), ["project_id"])
    return yes.select("id", F.lit(True).alias("accepted")).unionByName(no.select("id", F.lit(False).alias("accepted")))


@query("""WITH s AS (SELECT o_orderkey AS id, o_custkey AS user_id, epoch_us(o_orderdate) AS expires_at, CASE WHEN o_orderstatus = 'P' THEN 1 END AS revoked_at FROM orders), l AS (SELECT * FROM s WHERE id % 3 = 0 AND revoked_at IS NULL AND expires_at > 800000000000000)
SELECT id, user_id, expires_at, CASE WHEN id IN (SELECT id FROM l) THEN 800000000000000 ELSE revoked_at END AS revoked_at FROM s UNION ALL SELECT -id, user_id, expires_at, NULL FROM l""")
def session_rotation(spark, d):
    """Refreshing revokes the old session and makes a new one; revoked and expired ones can't be refreshed."""
    o = table(spark, d, "orders")
    s = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("expires_at"), F.when(F.col("o_orderstatus") == "P", F.lit(1)).cast("long").alias("revoked_at"))
    used = s.where("id % 3 = 0").select("id", (-F.col("id")).alias("new_key"))
    return incremental.rotated(s, used, "id", F.lit(800000000000000))


@query("SELECT c_custkey AS org_id, o_orderkey AS id FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_custkey = 7 OR (c_custkey = 11 AND o_orderstatus = 'F')")
def org_scope(spark, d):
    """Every look-up is scoped by the org."""
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.where((F.col("c_custkey") == 7) | ((F.col("c_custkey") == 11) & (F.col("o_orderstatus") == "F"))).select(F.col("c_custkey").alias("org_id"), F.col("o_orderkey").alias("id"))


_REQ = "rq AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'get' WHEN 'click' THEN 'post' WHEN 'purchase' THEN 'PUT' ELSE 'DELETE' END AS method, 'https://h/api/v1/' || CASE user_id % 3 WHEN 0 THEN 'auth/login' WHEN 1 THEN 'projects/' || user_id ELSE 'jobs?x=1' END AS url, CASE WHEN event_id % 4 = 0 THEN 404 ELSE 200 + event_id % 3 END AS status FROM events)"


@query(f"WITH {_REQ} SELECT event_id, upper(method) || ' ' || regexp_extract(url, '(/api/v1/[^?]*)', 1) AS action, regexp_extract(url, '/api/v1/([^/?]+)', 1) AS resource_type FROM rq WHERE status BETWEEN 200 AND 399 AND upper(method) IN ('POST', 'PUT', 'PATCH', 'DELETE') AND url NOT LIKE '%/api/v1/auth%'")
def audit_append(spark, d):
    """The audit rows that requests leave."""
    e = table(spark, d, "events")
    kind = F.col("event_type")
    method = F.when(kind == "view", "get").when(kind == "click", "post").when(kind == "purchase", "PUT").otherwise("DELETE")
    user = F.col("user_id") % 3
    url = F.concat(F.lit("https://h/api/v1/"), F.when(user == 0, "auth/login").when(user == 1, F.concat(F.lit("projects/"), F.col("user_id").cast("string"))).otherwise("jobs?x=1"))
    requests = e.select("event_id", method.alias("method"), url.alias("url"), F.when(F.col("event_id") % 4 == 0, 404).otherwise(200 + F.col("event_id") % 3).alias("status"))
    return product.audit_rows(requests).select("event_id", "action", "resource_type")


@query("WITH n AS (SELECT p_partkey AS id, lower(p_name) AS email FROM part WHERE p_size >= 10), s AS (SELECT DISTINCT lower(p_name) AS email FROM part WHERE p_size < 3), f AS (SELECT email, min(id) AS id FROM n GROUP BY 1) SELECT n.id, f.id IS NOT NULL AND s.email IS NULL AS accepted FROM n LEFT JOIN f ON f.id = n.id LEFT JOIN s ON s.email = n.email")
def unique_inserts(spark, d):
    """Of rows with the same address the first is taken, none if one is stored; the others are conflicts."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.lower("p_name").alias("email"), "p_size")
    yes, no = product.insert_unique(p.where("p_size < 3").select("email").distinct(), p.where("p_size >= 10").select("id", "email"), ["email"], "id")
    return yes.select("id", F.lit(True).alias("accepted")).unionByName(no.select("id", F.lit(False).alias("accepted")))


@query(r"""SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'ERROR' WHEN 1 THEN 'error' WHEN 2 THEN 'info' WHEN 3 THEN CASE user_id % 8 WHEN 0 THEN 'fatal' WHEN 1 THEN 'fatal' WHEN 2 THEN 'fatal' WHEN 3 THEN 'error' WHEN 4 THEN 'warn' WHEN 7 THEN 'debug' ELSE 'info' END WHEN 4 THEN 'warn' ELSE 'info' END.lower() AS severity,
CASE event_id % 6 WHEN 0 THEN 'api' WHEN 3 THEN 'sshd' END AS service, CASE WHEN event_id % 6 = 5 THEN 'plain {' || event_id ELSE 'm ' || event_id END AS message, CASE event_id % 6 WHEN 0 THEN 't0' WHEN 1 THEN 't1' WHEN 2 THEN '2024-01-01T00:00:00Z' WHEN 3 THEN '2024 Jan  2 03:04:05' WHEN 4 THEN '2024-01-01 00:00:00.5' END AS ts FROM events""")
def log_adapters(spark, d):
    """Lines of applications, containers, syslog and a database, and one that has no form."""
    e = table(spark, d, "events")
    i, m = F.col("event_id") % 6, F.concat(F.lit("m "), F.col("event_id").cast("string"))
    j = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    line = (
        F.when(i == 0, j('{"ts":"t0","severity":"ERROR","service":"api","message":"', m, '"}'))
        .when(i == 1, j('{"log":"', m, '\\n","stream":"stderr","time":"t1"}'))
        .when(i == 2, j("2024-01-01T00:00:00Z stdout F ", m))
        .when(i == 3, j("<", (F.col("user_id") % 8 + 8).cast("string"), ">Jan  2 03:04:05 host sshd[12]: ", m))
        .when(i == 4, j("2024-01-01 00:00:00.5 UTC [77] WARNING:  ", m))
        .otherwise(j("plain {", F.col("event_id").cast("string")))
    )
    kind = F.element_at(F.array(*map(F.lit, ("app", "docker", "k8s", "syslog", "db", "app"))), (i + 1).cast("int"))
    return normalised(e.select("event_id", line.alias("value"), kind.alias("kind")), F.col("kind"), year="2024").select("event_id", "severity", "service", "message", "ts")


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'src/' || page_id || '/a.py' ELSE 'other/' || page_id END AS path FROM pages")
def relative_paths(spark, d):
    n = F.col("page_id").cast("string")
    path = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("C:\\repo\\src\\"), n, F.lit("\\a.py"))).otherwise(F.concat(F.lit("other\\"), n))
    return table(spark, d, "pages").select("page_id", S.relative_path(path, "C:\\repo").alias("path"))


@query("SELECT CASE event_type WHEN 'error' THEN 'request {*} failed' ELSE event_type || ' of user {*} at {*}' END AS template, count(*) AS occurrences FROM events GROUP BY 1")
def log_mined_templates(spark, d):
    """Templates of lines by likeness: kinds of lines of unlike words stay apart, their numbers are wildcards."""
    kind, n, i = F.col("event_type"), F.col("user_id").cast("string"), F.col("event_id").cast("string")
    line = F.when(kind == "error", F.concat(F.lit("request "), i, F.lit(" failed"))).otherwise(F.concat(kind, F.lit(" of user "), n, F.lit(" at "), i))
    return logs.mined_templates(table(spark, d, "events").select(line.alias("line")), "line")
