"""Queries on change queues, traversals of many starts, the segmented index and what is kept up to date by deltas, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lodestack.operators import identifiers as ID
from lodestack.operators import markdown as MD
from lodestack.operators import relational as R
from lodestack.operators import resolution_store as RS
from lodestack.operators import term_index as TI
from lodestack.operators import traversal as TR
from lodestack.plans import public as PB
from lodestack.plans import relational_queries as RQ
from lodestack.plans import verification as V
from lodestack.plans.documentation_queries import _listed
from lodestack.plans.relational_queries import FILES_SQL, files, t
from lodestack.plans.text_queries import _EDGES, _REDACTED, _TOK, _graph
from lodestack.shared import filesystem, shared_dir
from lodestack.sources import reads as RD
from lodestack.streaming import queue as CQ

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Change queue: seven repositories, a session ends after three quiet hours, more than fifteen paths of a session overflow.


@query("""WITH e AS (SELECT 'r' || (user_id % 7) AS repository, 'p' || user_id AS path, event_id AS seq, ts, CASE event_type WHEN 'signup' THEN 'created' WHEN 'error' THEN 'deleted' ELSE 'modified' END AS kind FROM events),
c AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY repository ORDER BY ts, seq) + INTERVAL 3 HOUR THEN NULL ELSE ts END AS begins FROM e),
s AS (SELECT *, max(begins) OVER (PARTITION BY repository ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS session FROM c),
g AS (SELECT *, max(CASE WHEN kind = 'deleted' THEN seq END) OVER (PARTITION BY repository, session, path) AS gone FROM s),
a AS (SELECT repository, session, path, any_value(gone) AS gone, arg_max(ts, seq) AS last_ts, arg_max(kind, seq) AS last_kind, arg_min(kind, seq) FILTER (WHERE gone IS NULL OR seq > gone) AS first_kind, min(seq) FILTER (WHERE gone IS NULL OR seq > gone) AS first_seq,
  max(seq) FILTER (WHERE kind = 'created' AND (gone IS NULL OR seq > gone)) AS made_seq, arg_max(ts, seq) FILTER (WHERE kind = 'created' AND (gone IS NULL OR seq > gone)) AS made_ts FROM g GROUP BY repository, session, path),
k AS (SELECT *, CASE WHEN last_kind = 'deleted' THEN 'deleted' WHEN gone IS NOT NULL AND first_kind = 'created' AND made_seq = first_seq THEN 'modified' WHEN made_seq IS NOT NULL THEN 'created' ELSE 'modified' END AS kind, count(*) OVER (PARTITION BY repository, session) AS n, max(last_ts) OVER (PARTITION BY repository, session) AS end_ts FROM a)
SELECT repository, session, 'drained' AS status, path, kind, CASE WHEN kind = 'created' THEN made_ts ELSE last_ts END AS "at" FROM k WHERE n <= 15
UNION ALL SELECT DISTINCT repository, session, 'overflow', '.', 'modified', end_ts FROM k WHERE n > 15""")
def queue_drains(spark, sf_dir):
    k = F.col("event_type")
    kind = F.when(k == "signup", "created").when(k == "error", "deleted").otherwise("modified")
    text = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    e = t(spark, sf_dir, "events").select(text("r", F.col("user_id") % 7).alias("repository"), text("p", F.col("user_id")).alias("path"), F.col("event_id").alias("seq"), F.col("ts").alias("at"), kind.alias("kind"))
    return CQ.queue_drains(e, gap_ms=3 * 3600 * 1000, most=15)


# Traversals of many starts: every nation and customer (impact), every region and nation (strict).


def _folder(spark, name):
    path = f"{shared_dir(spark)}/lodestack/{name}-{uuid.uuid4().hex}"
    fs, p = filesystem(spark, path)
    fs.deleteOnExit(p)
    return path


_ENDS = """a AS (SELECT s AS node, t AS far, edge_id, 0 AS route, row_number() OVER (PARTITION BY s ORDER BY edge_id) AS place FROM e
UNION ALL SELECT t, s, edge_id, 1, row_number() OVER (PARTITION BY t ORDER BY s, edge_id) FROM e)"""


def _two_levels(starts, most, routes):
    """The graph is a forest: no node is reached twice, so ranks are running numbers of the entries."""
    return f"""st AS ({starts}),
l1 AS (SELECT q, a.*, 1 + row_number() OVER (PARTITION BY q ORDER BY route, place) AS rank FROM st JOIN a ON a.node = q WHERE place <= {most - 1}),
g1 AS (SELECT q, far AS node, 1 + row_number() OVER (PARTITION BY q ORDER BY route, place) AS rank FROM l1 WHERE {routes}), n1 AS (SELECT * FROM g1 WHERE rank <= {most}),
l2 AS (SELECT n1.q, n1.rank AS parent, a.* FROM n1 JOIN a ON a.node = n1.node WHERE a.place <= greatest(1, {most} - n1.rank)),
g2 AS (SELECT q, far AS node, (SELECT count(*) FROM n1 x WHERE x.q = l2.q) + 1 + row_number() OVER (PARTITION BY q ORDER BY parent, route, place) AS rank FROM l2 WHERE far <> q AND {routes}),
nd AS (SELECT q, q AS node, 0 AS depth, 1 AS rank FROM st UNION ALL SELECT q, node, 1, rank FROM n1 UNION ALL SELECT q, node, 2, rank FROM g2 WHERE rank <= {most}),
cut AS (SELECT q, 1 + (SELECT count(*) FROM g1 WHERE g1.q = st.q) + (SELECT count(*) FROM g2 WHERE g2.q = st.q) > {most} AS truncated FROM st)"""


@query(f"""WITH {_EDGES}, {_ENDS}, {_two_levels("SELECT 'n' || n_nationkey AS q FROM nation UNION ALL SELECT 'c' || c_custkey FROM customer", 50, "true")},
w AS (SELECT edge_id, CASE WHEN s[1] = 'r' AND edge_id % 2 = 0 THEN 'cloudformation-route' ELSE 'parser' END AS prov FROM e),
x AS (SELECT q, edge_id FROM l1 UNION SELECT q, edge_id FROM l2), xe AS (SELECT q, count(*) AS edges, bool_or(prov = 'cloudformation-route') AS cf FROM x JOIN w USING (edge_id) GROUP BY q),
k AS (SELECT q, count(*) AS symbols, max(depth) AS reached_depth, list_sort(list_distinct(list(node[1] || '/' || (regexp_replace(node, '[a-z]', '')::BIGINT % 3)))) AS files, list_sort(list_distinct(flatten(list(CASE WHEN node[1] = 'r' THEN ['config'] ELSE ['parser', 'heuristic'] END)))) AS kinds FROM nd GROUP BY q)
SELECT q AS start, symbols, files, edges, reached_depth, truncated, CASE WHEN len(files) <= 1 THEN 'low/local_only' WHEN cf THEN 'low/graph' WHEN truncated THEN 'medium/graph' ELSE 'high/graph' END AS confidence,
CASE WHEN len(files) > 1 AND cf THEN ['config', 'infra_parser'] ELSE kinds END AS evidence_kinds, false AS stale FROM k JOIN xe USING (q) JOIN cut USING (q)""")
def impact_of_changed(spark, sf_dir):
    """What a change to each nation and each customer may reach within two steps and fifty nodes."""
    e = _graph(spark, sf_dir)
    first = F.left(F.col("source"), F.lit(1))
    e = e.select("edge_id", "source", "target", F.when((first == "r") & (F.col("edge_id") % 2 == 0), "cloudformation-route").otherwise("parser").alias("provenance"), F.lit(0.9).alias("confidence"))
    kind = F.left(F.col("node"), F.lit(1))
    path = F.concat(kind, F.lit("/"), (F.regexp_replace("node", "[a-z]", "").cast("long") % 3).cast("string"))
    n = e.select(F.explode(F.array("source", "target")).alias("node")).distinct().select("node", path.alias("path"), F.when(kind == "r", F.array(F.lit("config"))).otherwise(F.array(F.lit("parser"), F.lit("heuristic"))).alias("evidence_kinds"))
    adjacency = TR.Adjacency.build(n, e, _folder(spark, "adjacency"), most=50)
    return TR.impact_of_changed(adjacency, n, n.where(F.left("node", F.lit(1)).isin("n", "c")).select("node"), max_depth=2, max_nodes=50)


@query(f"""WITH {_EDGES}, {_ENDS}, {_two_levels("SELECT 'r' || r_regionkey AS q FROM region WHERE 'r' || r_regionkey IN (SELECT s FROM e) UNION ALL SELECT 'n' || n_nationkey FROM nation", 60, "route = 0")}
SELECT q AS query, node, depth, rank, truncated FROM nd JOIN cut USING (q)""")
def traverse_strict(spark, sf_dir):
    """Outgoing and incoming edges of each region and nation; sources of incoming edges are not followed."""
    e = _graph(spark, sf_dir)
    n = e.select(F.explode(F.array("source", "target")).alias("node")).distinct()
    adjacency = TR.Adjacency.build(n, e, _folder(spark, "adjacency"), most=60)
    starts = n.where(F.left("node", F.lit(1)).isin("r", "n")).select(F.col("node").alias("query"), "node")
    walked = TR.traverse_many(adjacency, starts, max_depth=2, max_nodes=60, direction="both", mode="strict")
    return walked.nodes.join(walked.ends.select("query", "truncated"), "query")


# Term index: phrases, and an index that was updated, merged and swept.

_PHRASE = ["of-the", "licensed/under", "idiot"]


def _phrase_sql(source, most=100):
    """BM25 of _PHRASE over (doc_id, text); the words of a phrase differ, so its places never overlap."""

    def places(term):
        ws = [w for w in term.replace("/", "-").split("-")]
        return f"len(list_filter(range(1, len(tk) + 1), lambda i: {' AND '.join(f"tk[i + {j}] = '{w}'" for j, w in enumerate(ws))}))"

    k = range(len(_PHRASE))
    tf = ", ".join(f"{places(w)} AS tf{i}" for i, w in enumerate(_PHRASE))
    score = " + ".join(f"greatest(ln((n - df{i} + 0.5) / (df{i} + 0.5)), 1e-6) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * len / al))" for i in k)
    return f"""WITH src AS ({source}), k AS (SELECT doc_id, {_TOK.format("coalesce(text, '')")} AS tk FROM src), c AS (SELECT doc_id, len(tk) AS len, {tf} FROM k),
g AS (SELECT count(*) AS n, avg(len) AS al, {", ".join(f"count(*) FILTER (WHERE tf{i} > 0) AS df{i}" for i in k)} FROM c),
s AS (SELECT doc_id, round({score}, 6) AS score FROM c, g WHERE {" OR ".join(f"tf{i} > 0" for i in k)})
SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= {most}"""


def _phrase_hits(index):
    hits = index.search(_PHRASE, [1.0]).select(F.col("key").alias("doc_id"), F.round("score", 6).alias("score"))
    return R.ranked(hits, [F.desc("score"), F.asc("doc_id")], 100)


@query(_phrase_sql("SELECT doc_id, text FROM documents"))
def term_index_phrase(spark, sf_dir):
    """Terms with dashes and slashes are phrases, found by their positions."""
    return _phrase_hits(TI.TermIndex.build(t(spark, sf_dir, "documents"), "doc_id", ["text"], _folder(spark, "terms")))


@query(_phrase_sql("""SELECT doc_id, CASE WHEN lang = 'en' AND source = 'src3' THEN 'of the ' || text ELSE text END AS text FROM documents WHERE source <> 'src5'
UNION ALL SELECT -1 - item_id, text || ' licensed under the license' FROM benchmark"""))
def term_index_delta(spark, sf_dir):
    """The documents of one source go, English ones of another change, benchmark items come: three updates of one index and a merge."""
    docs, items = t(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), t(spark, sf_dir, "benchmark")
    index = TI.TermIndex.build(docs.select("doc_id", "text"), "doc_id", ["text"], _folder(spark, "terms"))
    index.update(docs.where("lang = 'en' AND source = 'src3'").select("doc_id", F.concat(F.lit("of the "), "text").alias("text")), "doc_id")
    index.update(items.select((-1 - F.col("item_id")).alias("doc_id"), F.concat("text", F.lit(" licensed under the license")).alias("text")), "doc_id", docs.where("source = 'src5'").select("doc_id"))
    index.merge(2)
    return _phrase_hits(index)


# Resolution by deltas: customers and parts are nodes, suppliers and customers name them; then some move, some go and some names change.

_NODES_AFTER = """SELECT lower(CASE WHEN c_nationkey = 7 THEN 'Moved#' || c_custkey ELSE c_name END) AS name, 'c' || c_custkey AS node_id FROM customer WHERE c_nationkey <> 3 UNION ALL SELECT lower(p_name), 'p' || p_partkey FROM part WHERE p_size <= 45"""


@query(f"""WITH x AS ({_NODES_AFTER}), g AS (SELECT name, count(*) AS n, min(node_id) AS one FROM x GROUP BY name),
r AS (SELECT 's' || s_suppkey AS ref_id, CASE WHEN s_nationkey = 5 THEN 'Customer#' || lpad(s_suppkey::VARCHAR, 9, '0') WHEN s_suppkey % 3 = 0 THEN 'red widget' ELSE 'Supplier#' || s_suppkey END AS name FROM supplier WHERE s_nationkey <> 9 UNION ALL SELECT 'c' || c_custkey, c_name FROM customer)
SELECT ref_id, CASE WHEN coalesce(g.n, 0) = 1 THEN one END AS target, coalesce(g.n, 0) AS candidate_count, CASE WHEN coalesce(g.n, 0) = 1 THEN 'resolved' WHEN coalesce(g.n, 0) > 1 THEN 'ambiguous' ELSE 'unresolved' END AS resolution FROM r LEFT JOIN g ON lower(r.name) = g.name""")
def resolve_delta(spark, sf_dir):
    """Full resolution once, then two updates by deltas."""
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    none, k = F.lit(None).cast("string"), F.col("s_suppkey")
    as_nodes = lambda df: df.select(F.col("id").alias("node_id"), "name", none.alias("qualified_name"), F.lit("function").alias("kind"), F.lit("go").alias("language"), F.concat(F.lit("a/"), F.col("id"), F.lit(".go")).alias("path"))
    as_refs = lambda df: df.select(F.col("id").alias("ref_id"), F.lit("m").alias("source"), "name", F.lit("call").alias("kind"), F.lit("go").alias("language"), F.lit(True).alias("static"), none.alias("receiver"), none.alias("import_dir"), F.array().cast("array<string>").alias("paths"))
    customer, part, supplier = (t(spark, sf_dir, n) for n in ("customer", "part", "supplier"))
    named = lambda df, name: df.select(key("c", "c_custkey").alias("id"), name.alias("name"))
    nodes = as_nodes(named(customer, F.col("c_name")).union(part.select(key("p", "p_partkey"), "p_name")))
    refs = as_refs(supplier.select(key("s", "s_suppkey").alias("id"), F.when(k % 3 == 0, "red widget").otherwise(key("Supplier#", "s_suppkey")).alias("name")).union(named(customer, F.col("c_name"))))
    store = RS.Resolutions.build(refs, nodes, _folder(spark, "resolved"))
    store.update(nodes=as_nodes(named(customer.where("c_nationkey = 7"), key("Moved#", "c_custkey"))), gone_nodes=customer.where("c_nationkey = 3").select(key("c", "c_custkey").alias("node_id")))
    asks = supplier.where("s_nationkey = 5").select(key("s", "s_suppkey").alias("id"), F.concat(F.lit("Customer#"), F.lpad(k.cast("string"), 9, "0")).alias("name"))
    store.update(gone_nodes=part.where("p_size > 45").select(key("p", "p_partkey").alias("node_id")), refs=as_refs(asks), gone_refs=supplier.where("s_nationkey = 9").select(key("s", "s_suppkey").alias("ref_id")))
    return store.results().select("ref_id", "target", "candidate_count", "resolution")


# Identifier scans: all identifiers of benchmark items in all documents, two pages of each.

_RESULTS, _FILES, _BYTES, _FILE_BYTES = 20, 150, 400_000, 20_000


def _receipt(k):
    """Receipts of a page: starts k (name, since, seen, n0, t0, k0), its files w and hits h."""
    return f"""w{k} AS (SELECT name, f.path, nth, total, skipped, nth - n0 AS i, total - t0 AS size FROM s{k} JOIN f ON fits AND nth BETWEEN n0 + 1 AND n0 + {_FILES} AND total - t0 <= {_BYTES}),
e{k} AS (SELECT name, max(i) AS files, max(size) AS bytes, max(path) AS end_path, max(nth) AS end_nth, max(total) AS end_total, max(skipped) AS end_skipped FROM w{k} GROUP BY name),
h{k} AS (SELECT tok.name, tok.path, ordinal, line, col, row_number() OVER (PARTITION BY tok.name ORDER BY tok.path, ordinal) AS pos FROM tok JOIN w{k} USING (name, path) JOIN s{k} USING (name) WHERE since IS NULL OR tok.path <> since OR ordinal > seen QUALIFY pos <= {_RESULTS}),
c{k} AS (SELECT name, count(*) AS hits, arg_max(path, pos) AS last_path, arg_max(ordinal, pos) AS last_ordinal, string_agg(path || ':' || line || ':' || col, ' ' ORDER BY pos) AS places FROM h{k} GROUP BY name),
m{k} AS (SELECT s.*, coalesce(c.hits, 0) AS hits, coalesce(e.files, 0) AS files, coalesce(e.bytes, 0) AS bytes, c.last_path, c.last_ordinal, coalesce(c.places, '') AS places, e.end_path, e.end_nth, e.end_total, e.end_skipped, EXISTS (SELECT 1 FROM f WHERE fits AND nth = s.n0 + coalesce(e.files, 0) + 1) AS more FROM s{k} s LEFT JOIN e{k} e USING (name) LEFT JOIN c{k} c USING (name)),
r{k} AS (SELECT *, CASE WHEN hits >= {_RESULTS} THEN 'result' WHEN NOT more THEN 'catalog_exhausted' WHEN files >= {_FILES} THEN 'file' ELSE 'byte' END AS stop, CASE WHEN more THEN coalesce(end_skipped, k0) ELSE (SELECT max(skipped) FROM f) END - k0 AS oversized FROM m{k}),
p{k} AS (SELECT *, stop = 'catalog_exhausted' AND (SELECT max(skipped) FROM f) = 0 AS complete, CASE WHEN stop = 'result' THEN last_path WHEN more THEN coalesce(end_path, since) END AS next_path, CASE WHEN stop = 'result' THEN last_ordinal WHEN more THEN 0 END AS next_ordinal FROM r{k})"""


_PAGE = "SELECT name, {0} AS page, hits, stop, files, bytes, oversized, complete, next_path, next_ordinal::INT AS next_ordinal, places FROM p{0}"


@query(rf"""WITH f0 AS (SELECT 'doc/' || lpad(doc_id::VARCHAR, 9, '0') AS path, text, strlen(text) AS bytes, strlen(text) <= {_FILE_BYTES} AS fits FROM documents),
f AS (SELECT path, bytes, fits, sum(fits::INT) OVER w AS nth, sum(CASE WHEN fits THEN bytes ELSE 0 END) OVER w AS total, sum((NOT fits)::INT) OVER w AS skipped FROM f0 WINDOW w AS (ORDER BY path)),
names AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS name FROM benchmark),
l AS (SELECT path, unnest(regexp_split_to_array(text, '\r?\n')) AS s, generate_subscripts(regexp_split_to_array(text, '\r?\n'), 1) AS line FROM f0 WHERE path IN (SELECT path FROM f WHERE fits AND nth <= 2 * {_FILES} + 1)),
v AS (SELECT path, line, unnest(string_split(regexp_replace(s, '[^A-Za-z0-9_]', ' ', 'g'), ' ')) AS name, generate_subscripts(string_split(regexp_replace(s, '[^A-Za-z0-9_]', ' ', 'g'), ' '), 1) AS k FROM l),
x AS (SELECT path, line, name, (sum(length(name) + 1) OVER (PARTITION BY path, line ORDER BY k) - length(name) - 1)::INT AS col FROM v),
tok AS (SELECT *, row_number() OVER (PARTITION BY path, name ORDER BY line, col) AS ordinal FROM x WHERE name IN (SELECT name FROM names)),
s1 AS (SELECT name, NULL::VARCHAR AS since, 0 AS seen, 0 AS n0, 0 AS t0, 0 AS k0 FROM names), {_receipt(1)},
s2 AS (SELECT name, next_path AS since, next_ordinal AS seen, f.nth - (next_ordinal > 0)::INT AS n0, f.total - CASE WHEN next_ordinal > 0 THEN f.bytes ELSE 0 END AS t0, f.skipped AS k0 FROM p1 JOIN f ON f.path = next_path), {_receipt(2)}
{_PAGE.format(1)} UNION ALL {_PAGE.format(2)}""")
def identifier_pages(spark, sf_dir):
    """Receipts of the first two pages of each name, with the places found."""
    docs = t(spark, sf_dir, "documents").select(F.concat(F.lit("doc/"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("path"), "text")
    index = ID.IdentifierIndex.build(docs, _folder(spark, "identifiers"), _FILE_BYTES)
    names, out = t(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z0-9_]+"), F.lit(0))).alias("name")).distinct(), None
    for number in (1, 2):
        page = index.page(names, _RESULTS, _FILES, _BYTES)
        at = F.struct("path", "ordinal", F.concat_ws(":", "path", "line", "col").alias("place"))
        found = page.hits.groupBy("name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(at)), lambda h: h["place"]), " ").alias("places"))
        rows = page.receipts.join(found, "name", "left").fillna({"places": ""}).withColumn("page", F.lit(number))
        out = rows if out is None else out.unionByName(rows)
        names = page.receipts.where("next_path IS NOT NULL").select("name", "next_path", "next_ordinal")
    return out


@query(f"""WITH {FILES_SQL}, f AS (SELECT path, file_id, 5 + CASE WHEN file_id % 2 = 0 THEN 2 ELSE 0 END AS at_link, 5 + CASE WHEN file_id % 2 = 0 THEN 2 ELSE 0 END + CASE WHEN file_id % 3 = 0 THEN 1 ELSE 0 END AS at_table, regexp_extract(path, '[^/]*$') AS base FROM files WHERE path LIKE '%.md')
SELECT path, 2 AS line, 'front_field' AS kind, 0 AS "column", NULL::INT AS depth, 'status' AS text, NULL::BIGINT AS number, NULL::VARCHAR AS cells, NULL::VARCHAR AS target FROM f WHERE false
UNION ALL SELECT path, 2, 'front_field', 0, NULL, 'status', NULL, 'draft', NULL FROM f UNION ALL SELECT path, 4, 'heading', 0, 1, 'T', NULL, NULL, NULL FROM f
UNION ALL SELECT path, 4 + k, 'ordered_list_item', 0, NULL, NULL, 2 * k - 1, NULL, NULL FROM f, (SELECT unnest([1, 2]) AS k) WHERE file_id % 2 = 0
UNION ALL SELECT path, at_link, 'link', 0, NULL, 'gone', NULL, NULL, 'missing.md' FROM f WHERE file_id % 3 = 0 UNION ALL SELECT path, at_link, 'link', 19, NULL, 'here', NULL, NULL, base FROM f WHERE file_id % 3 = 0
UNION ALL SELECT path, at_table + k, 'table_row', 0, NULL, NULL, NULL, ['a|b', '-|-', 'c'][k + 1], NULL FROM f, (SELECT unnest([0, 1, 2]) AS k) WHERE file_id % 5 = 0""")
def markdown_blocks(spark, sf_dir):
    """Every block of the Markdown part of the catalog; what stands in fenced code is none."""
    blocks = MD.markdown_blocks(_listed(spark, sf_dir), "path", "text")
    return blocks.select("path", "line", "kind", "column", "depth", "text", F.col("number").cast("long").alias("number"), F.when(F.col("cells").isNotNull(), F.array_join("cells", "|")).alias("cells"), "target")


# Verification: commands and targets for the files of one source, in a catalog with some project files.

_MANIFESTS = ["go.mod", "Makefile", "src/CMakeLists.txt", "repo.sln", "template.yaml", "infra/template.yaml", "pyproject.toml", "tests/test_f3.py", "tests/test_f7.py", "tests/test_f123.py", "tests/App.Tests.csproj"]


def _any(table, test):
    return f"EXISTS (SELECT 1 FROM {table} WHERE {test})"


@query(f"""WITH {FILES_SQL}, sel AS (SELECT path, regexp_replace(path, '/?[^/]*$', '') AS dir, regexp_replace(regexp_extract(path, '[^/]*$'), '\\.[^.]*$', '') AS stem FROM files WHERE unit = 'src3'), cat AS (SELECT path FROM files UNION ALL SELECT unnest({_MANIFESTS}) AS path),
proj AS (SELECT regexp_replace(path, '/?[^/]*$', '') AS dir, min(path) AS project FROM cat WHERE lower(path) LIKE '%.csproj' GROUP BY 1),
near AS (SELECT min(project) AS project FROM (SELECT s.path, arg_max(project, length(proj.dir)) AS project FROM sel s JOIN proj ON proj.dir = '' OR s.dir = proj.dir OR starts_with(s.dir, proj.dir || '/') WHERE s.path LIKE '%.cs' OR s.path LIKE '%.csproj' GROUP BY s.path)),
rows AS (SELECT 0 AS major, 0 AS minor, 'go' AS family, 'make test' AS command, 'a Go module at the root' AS reason WHERE {_any("sel", "path LIKE '%.go'")}
UNION ALL SELECT 1, 0, 'cmake', 'cmake --build build', 'a CMake project' WHERE {_any("sel", "path LIKE '%.c' OR path LIKE '%.cpp' OR path LIKE '%.h'")}
UNION ALL SELECT 2, 0, 'dotnet', 'dotnet build ' || project, 'the project nearest to selected files' FROM near WHERE project IS NOT NULL
UNION ALL SELECT 2, 1, 'dotnet', 'dotnet build repo.sln', 'the solution of the repository' WHERE {_any("sel", "path LIKE '%.cs' OR path LIKE '%.csproj'")}
UNION ALL SELECT 2, 2, 'dotnet', 'dotnet test tests/App.Tests.csproj', 'a test project' WHERE {_any("sel", "path LIKE '%.cs' OR path LIKE '%.csproj'")}
UNION ALL SELECT 3, k, 'sam', ['cfn-lint ', 'sam validate --template-file '][k + 1] || t, 'a template' FROM (SELECT unnest([0, 1]) AS k), (SELECT unnest(['infra/template.yaml', 'template.yaml']) AS t) WHERE {_any("sel", "regexp_matches(lower(path), '(^|/)(template|sam)[.]ya?ml$|(^|/)(infra|sam)/|handler')")}
UNION ALL SELECT 5, -1, 'python', 'python3 -m pytest tests/test_f' || k || '.py', 'the test nearest to selected files' FROM (SELECT unnest([3, 7, 123]) AS k) WHERE ('f' || k) IN (SELECT stem FROM sel WHERE path LIKE '%.py')
UNION ALL SELECT 5, 0, 'python', 'python3 -m pytest', 'a Python project at the root' WHERE {_any("sel", "path LIKE '%.py'")}
UNION ALL SELECT 6, 0, 'docs', 'review documents', 'documents or configuration' WHERE {_any("sel", "regexp_matches(path, '[.](md|json|yaml|toml|cfg)$')")})
SELECT row_number() OVER (ORDER BY major, minor, command) AS rank, family, command, reason, 'planned' AS status FROM rows QUALIFY rank <= 20""")
def planned_commands(spark, sf_dir):
    """What would verify the files of one source."""
    f = files(spark, sf_dir)
    catalog = f.select("path").unionByName(spark.createDataFrame([(m,) for m in _MANIFESTS], "path string"))
    return V.planned_commands(catalog, f.where("unit = 'src3'").select("path"), most=20)


# Requested reads: each file of the catalog asked for in three ways below a root.


@query(f"""WITH {FILES_SQL}, pp AS (SELECT path, write_policy FROM ({RQ.SQL["path_policy"]}))
SELECT '/repo/' || path AS path, 'write' AS mode, path AS relative, write_policy = 'allow' AS allowed, write_policy <> 'allow' AS read_only, CASE WHEN write_policy <> 'allow' THEN 'write_refused' END AS reason, CASE WHEN write_policy = 'allow' THEN true END AS "exists", CASE WHEN write_policy = 'allow' THEN size_bytes END AS size_bytes, NULL::VARCHAR AS text FROM files JOIN pp USING (path)
UNION ALL SELECT 'x/../' || path, 'prefix', path, true, write_policy <> 'allow', NULL, true, size_bytes, left(text, list_max(list_filter(range(0, 41), lambda n: strlen(left(text, n)) <= 40))) FROM files JOIN pp USING (path)
UNION ALL SELECT '../' || path, 'text', NULL, false, NULL, 'path_refused', NULL, NULL, NULL FROM files""")
def requested_reads(spark, sf_dir):
    """Writes by absolute path, prefixes of forty bytes through a folder and back, and paths that leave the root."""
    f = files(spark, sf_dir)
    ask = lambda before, mode: f.select(F.concat(F.lit(before), "path").alias("path"), F.lit(mode).alias("mode"))
    requests = ask("/repo/", "write").unionByName(ask("x/../", "prefix")).unionByName(ask("../", "text"))
    tree = f.select("path", "size_bytes", "mtime_ms", F.encode("text", "UTF-8").alias("content"))
    return RD.answers(RD.resolved(requests, "/repo", skipped=["app"]), tree, 40).drop("mtime_ms", "content")


# Public shapes: sections are whole documents, bounded after redaction.


@query(f"SELECT source AS path, doc_id AS start_line, n_chars AS end_line, left(r, list_max(list_filter(range(0, 201), lambda n: strlen(left(r, n)) <= 200))) AS text, strlen(r) AS byte_count, strlen(r) > 200 AS truncated FROM (SELECT *, {_REDACTED} AS r FROM documents)")
def public_sections(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select(F.col("source").alias("path"), F.col("doc_id").alias("start_line"), F.col("n_chars").alias("end_line"), "text")
    return PB.public_sections(d, 200)
