"""Queries on the graph, references, the store and its search index, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lodestack.functions import text as T
from lodestack.operators import graph as G
from lodestack.operators import references as REF
from lodestack.operators import relational as R
from lodestack.operators import search as S
from lodestack.operators import snapshots as SN
from lodestack.operators import store as ST
from lodestack.plans.relational_queries import FILES_SQL, files, t
from lodestack.plans.text_queries import _EDGES, _TOK, TERMS, _bm25_sql, _graph
from lodestack.shared import filesystem, shared_dir

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _nodes(e):
    return e.select(F.explode(F.array("source", "target")).alias("node")).distinct()


# Traversal.


@query(f"""WITH {_EDGES}, l1 AS (SELECT t AS node, 0 AS route, row_number() OVER (ORDER BY edge_id) AS pos FROM e WHERE s = 'n3' QUALIFY pos <= 59 UNION ALL SELECT s, 1, row_number() OVER (ORDER BY s, edge_id) FROM e WHERE t = 'n3'),
r1 AS (SELECT node, 1 + row_number() OVER (ORDER BY route, pos) AS rank FROM l1), l2 AS (SELECT e.t AS node, r1.rank AS parent, row_number() OVER (PARTITION BY r1.node ORDER BY e.edge_id) AS pos FROM e JOIN r1 ON e.s = r1.node WHERE r1.rank <= 60),
r2 AS (SELECT node, (SELECT max(rank) FROM r1) + row_number() OVER (ORDER BY parent, pos) AS rank FROM l2 WHERE pos <= greatest(1, 60 - parent) AND node <> 'n3'),
a AS (SELECT 'n3' AS node, 0 AS depth, 1 AS rank UNION ALL SELECT node, 1, rank FROM r1 UNION ALL SELECT node, 2, rank FROM r2)
SELECT node, depth, rank, (SELECT max(rank) FROM a) > 60 AS truncated FROM a WHERE rank <= 60""")
def traverse_both(spark, sf_dir):
    e = _graph(spark, sf_dir)
    return G.traverse(_nodes(e), e, spark.range(1).select(F.lit("n3").alias("node")), max_depth=2, max_nodes=60, direction="both")


@query(f"""WITH {_EDGES}, l1 AS (SELECT edge_id, s, t, 1 + row_number() OVER (ORDER BY edge_id) AS node_rank FROM e WHERE s = 'r1' QUALIFY row_number() OVER (ORDER BY edge_id) <= 59),
l2 AS (SELECT e.edge_id, e.s, e.t, l1.node_rank AS parent FROM e JOIN l1 ON e.s = l1.t QUALIFY row_number() OVER (PARTITION BY e.s ORDER BY e.edge_id) <= greatest(1, 60 - l1.node_rank)), u AS (SELECT edge_id, s, t, 1 AS parent FROM l1 UNION ALL SELECT * FROM l2)
SELECT edge_id, s AS source, t AS target, row_number() OVER (ORDER BY parent, edge_id) AS rank, 2 AS reached_depth FROM u""")
def traverse_edges(spark, sf_dir):
    e = _graph(spark, sf_dir)
    return G.traversed_edges(_nodes(e), e, ["r1"], max_depth=2, max_nodes=60)


def _impact_sql(start):
    return f"""SELECT '{start}' AS start, (SELECT count(*) FROM n{start}) AS symbols, (SELECT list_sort(list_distinct(list(path))) FROM n{start}) AS files, (SELECT count(*) FROM x{start}) AS edges, 1 AS reached_depth, (SELECT count(*) FROM x{start}) > 49 AS truncated,
CASE WHEN (SELECT count(DISTINCT path) FROM n{start}) <= 1 THEN 'low/local_only' WHEN (SELECT bool_or(prov = 'cloudformation-route') FROM x{start}) OR (SELECT bool_or(conf < 0.7) FROM x{start}) THEN 'low/graph' WHEN (SELECT count(*) FROM x{start}) > 49 THEN 'medium/graph' ELSE 'high/graph' END AS confidence,
CASE WHEN (SELECT count(DISTINCT path) FROM n{start}) > 1 AND (SELECT bool_or(prov = 'cloudformation-route') FROM x{start}) THEN ['config', 'infra_parser'] ELSE (SELECT list_sort(list_distinct(flatten(list(CASE WHEN node[1] = 'r' THEN ['config'] ELSE ['parser', 'heuristic'] END)))) FROM n{start}) END AS evidence_kinds, false AS stale"""


def _impact_cte(start):
    return f"""x{start} AS (SELECT *, t AS other FROM (SELECT *, row_number() OVER (ORDER BY edge_id) AS pos, 0 AS route FROM w WHERE s = '{start}') WHERE pos <= 49 UNION ALL SELECT *, s AS other FROM (SELECT *, row_number() OVER (ORDER BY s, edge_id) AS pos, 1 AS route FROM w WHERE t = '{start}') WHERE pos <= 49),
n{start} AS (SELECT node, node[1] || '/' || (regexp_replace(node, '[a-z]', '')::BIGINT % 3) AS path FROM (SELECT '{start}' AS node UNION ALL SELECT other FROM (SELECT other, row_number() OVER (ORDER BY route, pos) AS k FROM x{start}) WHERE k <= 49))"""


@query(f"""WITH {_EDGES}, w AS (SELECT *, CASE WHEN s[1] = 'r' AND edge_id % 2 = 0 THEN 'cloudformation-route' ELSE 'parser' END AS prov, CASE WHEN s[1] = 'c' THEN 0.9 ELSE 0.8 END AS conf FROM e),
{", ".join(_impact_cte(s) for s in ("n3", "n4", "c5"))} {" UNION ALL ".join(_impact_sql(s) for s in ("n3", "n4", "c5"))}""")
def impact(spark, sf_dir):
    e = _graph(spark, sf_dir)
    first = F.left(F.col("source"), F.lit(1))
    e = e.select("edge_id", "source", "target", F.when((first == "r") & (F.col("edge_id") % 2 == 0), "cloudformation-route").otherwise("parser").alias("provenance"), F.when(first == "c", 0.9).otherwise(0.8).alias("confidence"))
    kind = F.left(F.col("node"), F.lit(1))
    n = _nodes(e).select("node", F.concat(kind, F.lit("/"), (F.regexp_replace("node", "[a-z]", "").cast("long") % 3).cast("string")).alias("path"), F.when(kind == "r", F.array(F.lit("config"))).otherwise(F.array(F.lit("parser"), F.lit("heuristic"))).alias("evidence_kinds"))
    out = [G.impact(n, e, s, max_depth=1, max_nodes=50) for s in ("n3", "n4", "c5")]
    return out[0].unionByName(out[1]).unionByName(out[2])


# References. Edges: line items name parts, each twice (a repeat with a later id); parts name their brand. Every third part is named by edges.

_REF = """ed AS (SELECT l_orderkey * 1000 + l_linenumber * 100 + l_suppkey % 100 + 50000000000 * k AS edge_id, 'o' || l_orderkey AS src, 'p' || (l_partkey - l_partkey % 3) AS tgt, l_returnflag AS kind, l_linestatus AS prov, 'm' AS meta, CASE WHEN l_linenumber > 1 THEN l_linenumber END AS start_line, (l_suppkey % 10)::INT AS start_column, CASE WHEN l_linenumber > 1 THEN l_linenumber END AS end_line, NULL::INT AS end_column, l_tax AS conf FROM lineitem, (SELECT unnest([0, 1]) AS k)
UNION ALL SELECT p_partkey + 90000000000, 'p' || p_partkey, 'b' || p_brand, 'type', 'parser', 'm', p_size, 0, p_size, 4, 0.8 FROM part WHERE p_size > 40)"""
_ONE = "SELECT * FROM ed QUALIFY row_number() OVER (PARTITION BY src, tgt, kind, prov, meta, coalesce(start_line, -1), coalesce(start_column, -1), coalesce(end_line, -1), coalesce(end_column, -1) ORDER BY edge_id) = 1"
_AT = "coalesce(start_line, -1), coalesce(start_column, -1), coalesce(end_line, -1), coalesce(end_column, -1)"


def _reference_tables(spark, sf_dir):
    text = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    li, part = t(spark, sf_dir, "lineitem"), t(spark, sf_dir, "part")
    n = F.when(F.col("l_linenumber") > 1, F.col("l_linenumber"))
    base = li.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
    none = F.lit(None).cast("int")
    e = base.select(
        (F.col("l_orderkey") * 1000 + F.col("l_linenumber") * 100 + F.col("l_suppkey") % 100 + F.col("k") * F.lit(50_000_000_000)).alias("edge_id"), text("o", F.col("l_orderkey")).alias("source_node_id"), text("p", F.col("l_partkey") - F.col("l_partkey") % 3).alias("target_node_id"), F.col("l_returnflag").alias("kind"),
        F.col("l_linestatus").alias("provenance"), F.lit("m").alias("metadata"), n.alias("start_line"), (F.col("l_suppkey") % 10).cast("int").alias("start_column"), n.alias("end_line"), none.alias("end_column"), F.col("l_tax").alias("confidence"),
    )
    size = F.col("p_size")
    own = part.where(size > 40).select((F.col("p_partkey") + 90_000_000_000).alias("edge_id"), text("p", F.col("p_partkey")).alias("source_node_id"), text("b", F.col("p_brand")).alias("target_node_id"), F.lit("type").alias("kind"), F.lit("parser").alias("provenance"), F.lit("m").alias("metadata"), size.alias("start_line"), F.lit(0).alias("start_column"), size.alias("end_line"), F.lit(4).alias("end_column"), F.lit(0.8).alias("confidence"))
    targets = part.select(text("p", F.col("p_partkey")).alias("node_id"), text("x", F.col("p_partkey")).alias("name"), F.concat_ws(".", "p_brand", text("x", F.col("p_partkey"))).alias("qualified_name"), F.when(size % 5 == 0, "ruby").otherwise("go").alias("language"), (size % 2 == 0).alias("parsed"))
    o = F.col("o_orderkey")
    refs = t(spark, sf_dir, "orders").select(o.alias("ref_id"), text("p", F.col("o_custkey") + o % 2 * 100_000).alias("source_node_id"), text("x", o % 2500).alias("name"), F.col("o_orderpriority").alias("kind"), text("src/", F.col("o_orderstatus")).alias("path"), (o % 50).cast("int").alias("start_line"), (o % 7).cast("int").alias("start_column"), (o % 50).cast("int").alias("end_line"), (o % 7 + 3).cast("int").alias("end_column"), F.when(o % 3 == 0, "ambiguous").otherwise("unresolved").alias("resolution"))
    d = F.col("doc_id")
    lexical = t(spark, sf_dir, "documents").select(text("p", d).alias("target"), F.col("source").alias("path"), (d % 9).cast("int").alias("start_line"), (d % 5).cast("int").alias("start_column"), (d % 9).cast("int").alias("end_line"), (d % 5 + 2).cast("int").alias("end_column"))
    return targets, e.unionByName(own), refs, lexical


@query(f"""WITH {_REF}, u AS ({_ONE}), tg AS (SELECT 'p' || p_partkey AS node, 'x' || p_partkey AS name, p_size FROM part),
o AS (SELECT src AS target, 0 AS route, row_number() OVER (PARTITION BY src ORDER BY src, tgt, {_AT}, kind, prov, edge_id) AS pos, tgt AS other, NULL AS path, start_line, start_column, 'resolved' AS kind, conf, prov, 'resolved' AS status FROM u WHERE src IN (SELECT node FROM tg)),
i AS (SELECT tgt AS target, 1 AS route, row_number() OVER (PARTITION BY tgt ORDER BY src, {_AT}, kind, prov, edge_id) AS pos, src AS other, NULL AS path, start_line, start_column, kind, conf, prov, 'resolved' AS status FROM u WHERE tgt IN (SELECT node FROM tg) AND src <> tgt),
rf AS (SELECT o_orderkey AS ref_id, 'p' || (o_custkey + o_orderkey % 2 * 100000) AS src, 'x' || (o_orderkey % 2500) AS name, o_orderpriority AS kind, 'src/' || o_orderstatus AS path, (o_orderkey % 50)::INT AS start_line, (o_orderkey % 7)::INT AS start_column, o_orderkey % 3 = 0 AS amb FROM orders),
m AS (SELECT tg.node AS target, rf.* FROM rf JOIN tg ON rf.src = tg.node OR rf.name = tg.name), md AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY target, src, name, kind, path, start_line, start_column ORDER BY ref_id) = 1),
r AS (SELECT target, 2 AS route, row_number() OVER (PARTITION BY target ORDER BY path, start_line, start_column, src, name, kind, ref_id) AS pos, src AS other, path, start_line, start_column, kind, CASE WHEN amb THEN 0.4 ELSE 0.35 END AS conf, 'unresolved_reference' AS prov, CASE WHEN amb THEN 'ambiguous' ELSE 'unresolved' END AS status FROM md),
g AS (SELECT * FROM o UNION ALL SELECT * FROM i UNION ALL SELECT * FROM r),
x AS (SELECT 'p' || doc_id AS target, 3 AS route, 1 AS pos, NULL AS other, source AS path, (doc_id % 9)::INT AS start_line, (doc_id % 5)::INT AS start_column, 'lexical' AS kind, 0.2 AS conf, 'bounded_lexical_identifier_scan' AS prov, 'unresolved' AS status FROM documents WHERE 'p' || doc_id IN (SELECT node FROM tg WHERE NOT (p_size % 5 = 0 AND p_size % 2 = 0)) AND 'p' || doc_id NOT IN (SELECT target FROM g)),
z AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY route, pos) AS position, count(*) OVER (PARTITION BY target) AS n FROM (SELECT * FROM g UNION ALL SELECT * FROM x))
SELECT target, position, ['outgoing', 'incoming', 'unresolved', 'lexical'][route + 1] AS route, other, path, start_line, start_column, kind, conf::DOUBLE AS confidence, prov AS provenance, status, n > 8 AS more FROM z WHERE position <= 8""")
def find_references(spark, sf_dir):
    """The first eight references of every part."""
    targets, e, refs, lexical = _reference_tables(spark, sf_dir)
    return REF.find_references(targets, e, refs, lexical, n=8).select("target", F.col("position").cast("long").alias("position"), "route", "other", "path", "start_line", "start_column", "kind", "confidence", "provenance", "status", "more")


@query(f"""WITH {_REF} SELECT src AS node, edge_id, row_number() OVER (PARTITION BY src ORDER BY edge_id) AS position FROM ed WHERE src IN (SELECT 'o' || o_orderkey FROM orders) QUALIFY position <= 3""")
def outgoing_edges(spark, sf_dir):
    _, e, _, _ = _reference_tables(spark, sf_dir)
    targets = t(spark, sf_dir, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("node_id"))
    return REF.outgoing_edges(e, targets, 3).select(F.col("source_node_id").alias("node"), "edge_id", F.col("position").cast("long").alias("position"))


@query("""WITH n AS (SELECT p_brand AS path, CASE WHEN p_size > 25 THEN ['parser', 'heuristic'] ELSE ['config'] END AS k FROM part) SELECT path, list_sort(list_distinct(flatten(list(k)))) AS evidence_kinds FROM n GROUP BY path""")
def evidence_kinds(spark, sf_dir):
    n = t(spark, sf_dir, "part").select(F.col("p_brand").alias("path"), F.when(F.col("p_size") > 25, F.array(F.lit("parser"), F.lit("heuristic"))).otherwise(F.array(F.lit("config"))).alias("evidence_kinds"))
    return REF.evidence_kinds(n, ["path"])


@query("""SELECT count(*) FILTER (WHERE event_type = 'error') = 0 AS complete, count(*) FILTER (WHERE event_type NOT IN ('error', 'signup')) AS searchable, count(*) FILTER (WHERE event_type = 'signup') AS excluded, count(*) FILTER (WHERE event_type = 'error') AS unresolved, coalesce(sum(user_id) FILTER (WHERE event_type NOT IN ('error', 'signup')), 0)::BIGINT AS bytes FROM events""")
def lexical_coverage(spark, sf_dir):
    k = F.col("event_type")
    f = t(spark, sf_dir, "events").select(F.when(k == "error", "unresolved").when(k == "signup", "policy_exclusion").otherwise("searchable").alias("classification"), k.alias("reason"), F.col("user_id").alias("bytes"))
    return REF.coverage_receipt(f, True, False)


# Search.

_SYM = [("p_name", 8), ("p_brand || '.' || p_name", 7), ("p_type", 3), ("'sized ' || p_size", 2)]
_SYM_TERMS = ["wid", "br"]


def _symbol_sql():
    fields = ", ".join(f"{_TOK.format(f'({c})')} AS t{i}" for i, (c, _) in enumerate(_SYM))
    tf = ", ".join(f"{' + '.join(f'{w} * len(list_filter(t{i}, lambda x: starts_with(x, $${term}$$)))' for i, (_, w) in enumerate(_SYM))} AS f{k}" for k, term in enumerate(_SYM_TERMS))
    score = " + ".join(f"greatest(ln((n - df{k} + 0.5) / (df{k} + 0.5)), 1e-6) * f{k} * 2.2 / (f{k} + 1.2 * (0.25 + 0.75 * len / al))" for k in range(len(_SYM_TERMS)))
    dfs = ", ".join(f"count(*) FILTER (WHERE f{k} > 0) AS df{k}" for k in range(len(_SYM_TERMS)))
    return f"""WITH a AS (SELECT p_partkey, p_name, {fields} FROM part), c AS (SELECT p_partkey, p_name, {' + '.join(f'len(t{i})' for i in range(len(_SYM)))} AS len, {tf} FROM a), g AS (SELECT count(*) AS n, avg(len) AS al, {dfs} FROM c),
s AS (SELECT p_partkey AS node_id, p_name AS name, round({score}, 6) AS score FROM c, g WHERE {' AND '.join(f'f{k} > 0' for k in range(len(_SYM_TERMS)))}) SELECT node_id, score, row_number() OVER (ORDER BY score DESC, name, node_id) AS rank FROM s QUALIFY rank <= 100"""


def _symbols(spark, sf_dir):
    return t(spark, sf_dir, "part").select(F.col("p_partkey").alias("node_id"), F.col("p_name").alias("name"), F.concat_ws(".", "p_brand", "p_name").alias("qualified_name"), F.col("p_type").alias("signature"), F.concat(F.lit("sized "), F.col("p_size").cast("string")).alias("docstring"), F.lit("go").alias("language"), F.col("p_brand").alias("path"), (F.col("p_size") == 7).alias("resource_backed"))


@query(_symbol_sql())
def symbol_text_search(spark, sf_dir):
    return S.search_symbol_text(_symbols(spark, sf_dir), "Wid BR", 100).select("node_id", "score", "rank")


@query(_symbol_sql().replace("SELECT node_id, score, row_number() OVER (ORDER BY score DESC, name, node_id) AS rank FROM s", "SELECT node_id, 10 AS match, row_number() OVER (ORDER BY score DESC, name, node_id) AS rank, true AS exact_miss FROM s"))
def symbol_search_fallback(spark, sf_dir):
    """No symbol has the name: full text answers, flagged."""
    return G.find_symbols(_symbols(spark, sf_dir), "Wid BR", None, 100).select("node_id", "match", "rank", "exact_miss")


@query(_bm25_sql(TERMS))
def term_index_topk(spark, sf_dir):
    """fts_bm25_topk by way of a term index."""
    folder = f"{shared_dir(spark)}/lodestack/terms-{uuid.uuid4().hex}"
    fs, p = filesystem(spark, folder)
    fs.deleteOnExit(p)
    index = S.TermIndex.build(t(spark, sf_dir, "documents"), "doc_id", ["text"], folder)
    hits = index.search(T.docs_terms(" ".join(TERMS)), [1.0]).select(F.col("key").alias("doc_id"), F.round("score", 6).alias("score"))
    return R.ranked(hits, [F.desc("score"), F.asc("doc_id")], 50)


# The store: orders are files of two snapshots, line items are nodes, events refer to files that exist or do not.

_STORE = """f AS (SELECT o_orderkey AS file_id, o_orderkey % 2 AS snapshot_id, 'src/' || o_orderkey AS path FROM orders), n AS (SELECT l_orderkey * 10 + l_linenumber AS node_id, l_orderkey AS file_id FROM lineitem), n1 AS (SELECT node_id, min(file_id) AS file_id FROM n GROUP BY node_id),
ee AS (SELECT l_partkey * 10 + l_linenumber AS source_node_id, CASE WHEN l_quantity > 5 THEN l_orderkey * 10 + l_linenumber END AS target_node_id, l_suppkey AS edge_id FROM lineitem)"""


def _store(spark, sf_dir):
    o, li = t(spark, sf_dir, "orders"), t(spark, sf_dir, "lineitem")
    files = o.select(F.col("o_orderkey").alias("file_id"), (F.col("o_orderkey") % 2).alias("snapshot_id"), F.concat(F.lit("src/"), F.col("o_orderkey").cast("string")).alias("path"), F.lit(99).alias("node_count"))
    node = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    nodes = li.select(node.alias("node_id"), F.col("l_orderkey").alias("file_id")).groupBy("node_id").agg(F.min("file_id").alias("file_id"))
    edges = li.select((F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("source_node_id"), F.when(F.col("l_quantity") > 5, node).alias("target_node_id"), F.col("l_suppkey").alias("edge_id"))
    return files, nodes, edges


@query(f"""WITH {_STORE} SELECT f.snapshot_id, count(*) AS nodes, count(DISTINCT path) AS paths, min(path) AS first FROM n1 JOIN f USING (file_id) GROUP BY f.snapshot_id""")
def nodes_by_snapshot(spark, sf_dir):
    files, nodes, _ = _store(spark, sf_dir)
    return ST.node_files(nodes, files).groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("nodes"), F.count_distinct("path").alias("paths"), F.min("path").alias("first"))


@query(f"""WITH {_STORE} SELECT edge_id, path, count(*) AS n FROM ee JOIN n1 ON n1.node_id = ee.source_node_id JOIN f USING (file_id) WHERE f.snapshot_id = 1 GROUP BY edge_id, path""")
def edge_source_sites(spark, sf_dir):
    files, nodes, edges = _store(spark, sf_dir)
    return ST.edge_sites(edges, nodes, files, 1).groupBy("edge_id", "path").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_STORE} SELECT a.snapshot_id, a.path AS source_path, b.path AS target_path, count(*) AS n FROM ee JOIN n1 s ON s.node_id = ee.source_node_id JOIN f a ON a.file_id = s.file_id JOIN n1 d ON d.node_id = ee.target_node_id JOIN f b ON b.file_id = d.file_id WHERE a.snapshot_id = b.snapshot_id GROUP BY 1, 2, 3""")
def edge_both_ends(spark, sf_dir):
    files, nodes, edges = _store(spark, sf_dir)
    return ST.edge_ends(edges, nodes, files).groupBy("snapshot_id", "source_path", "target_path").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_STORE} SELECT event_id AS ref_id, f.snapshot_id, f.path FROM events e JOIN f ON f.file_id = e.user_id""")
def unresolved_sites(spark, sf_dir):
    files, _, _ = _store(spark, sf_dir)
    refs = t(spark, sf_dir, "events").select(F.col("event_id").alias("ref_id"), F.col("user_id").alias("file_id"))
    return ST.unresolved_sites(refs, files).select("ref_id", "snapshot_id", "path")


@query("""WITH s AS (SELECT c_custkey AS snapshot_id, c_mktsegment AS repo FROM customer), d AS (SELECT o_custkey AS snapshot_id, count(*) AS docs FROM orders GROUP BY o_custkey) SELECT repo, snapshot_id, docs FROM s JOIN d USING (snapshot_id) QUALIFY row_number() OVER (PARTITION BY repo ORDER BY snapshot_id DESC) = 1""")
def latest_with_docs(spark, sf_dir):
    s = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("snapshot_id"), F.col("c_mktsegment").alias("repo"))
    return ST.latest_with_docs(s, t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("snapshot_id")), "repo")


@query("""WITH u AS (SELECT 'src/core' AS p, 'core' AS k UNION ALL SELECT 'src', 'src' UNION ALL SELECT '.', 'root'), h AS (SELECT event_id, ['src/core/a', 'src/b', 'docs/c', 'src'][user_id % 4 + 1] AS path FROM events)
SELECT event_id, path, CASE WHEN starts_with(path, 'src/core/') THEN 'core' WHEN path = 'src' OR starts_with(path, 'src/') THEN 'src' ELSE 'root' END AS unit FROM h""")
def hit_repositories(spark, sf_dir):
    u = spark.createDataFrame([("src/core", "core"), ("src", "src"), (".", "root")], "path_prefix string, repository_key string")
    h = t(spark, sf_dir, "events").select("event_id", F.element_at(F.array(*map(F.lit, ("src/core/a", "src/b", "docs/c", "src"))), (F.col("user_id") % 4 + 1).cast("int")).alias("path"))
    return ST.with_repository(h, u).select("event_id", "path", "unit")


@query(f"""WITH {_STORE} SELECT f.file_id, f.path, coalesce(c.n, 0)::INT AS node_count FROM f LEFT JOIN (SELECT file_id, count(*) AS n FROM n1 GROUP BY file_id) c USING (file_id)""")
def node_counts(spark, sf_dir):
    files, nodes, _ = _store(spark, sf_dir)
    return ST.with_node_counts(files, nodes).select("file_id", "path", "node_count")


@query("""SELECT user_id AS build, count(*) AS slices, sum(event_id)::BIGINT AS files, coalesce(sum(value), 0)::BIGINT AS bytes, arg_max(event_type, event_id) AS phase FROM (SELECT event_id, user_id, event_type, round(value)::BIGINT AS value FROM events) GROUP BY user_id""")
def build_counters(spark, sf_dir):
    s = t(spark, sf_dir, "events").select(F.col("user_id").alias("build"), F.col("event_id").alias("files"), F.col("event_id").alias("seq"), F.round("value").cast("long").alias("bytes"), F.col("event_type").alias("phase"))
    return ST.accumulated(s, ["build"], ["files", "bytes"], "seq", ["phase"])


@query("""WITH s AS (SELECT CASE event_type WHEN 'error' THEN 'degraded' WHEN 'signup' THEN 'unknown' ELSE 'healthy' END AS st FROM events) SELECT count(*) AS surfaces, count(*) FILTER (WHERE st = 'healthy') AS healthy, count(*) FILTER (WHERE st = 'degraded') AS degraded, count(*) FILTER (WHERE st = 'blocked') AS blocked, count(*) FILTER (WHERE st = 'unknown') AS unknown,
CASE WHEN count(*) FILTER (WHERE st = 'blocked') > 0 THEN 'blocked' WHEN count(*) FILTER (WHERE st = 'degraded') > 0 THEN 'degraded' WHEN count(*) FILTER (WHERE st = 'unknown') > 0 OR count(*) = 0 THEN 'unknown' ELSE 'healthy' END AS verdict FROM s""")
def surface_health(spark, sf_dir):
    k = F.col("event_type")
    return ST.surface_health(t(spark, sf_dir, "events").select(F.when(k == "error", "degraded").when(k == "signup", "unknown").otherwise("healthy").alias("status")))


@query(f"""WITH {FILES_SQL}, e AS (SELECT path, lang, CASE WHEN lang = 'en' THEN sha256(text) WHEN lang = 'es' THEN NULL ELSE 'old' END AS old_hash, starts_with(path, 'vendor/') AS vendor FROM files),
s AS (SELECT CASE WHEN lang = 'es' THEN 'new/' || path ELSE path END AS path, CASE WHEN lang = 'es' THEN 'applies' WHEN vendor THEN 'refused' WHEN lang = 'en' THEN 'applies' ELSE 'drifted' END AS state FROM e) SELECT path, state, state = 'applies' AS has_token FROM s""")
def edit_preview(spark, sf_dir):
    """English files are edited as they are, Spanish ones are copied to new paths, others were changed meanwhile."""
    f = files(spark, sf_dir)
    h = F.sha2("text", 256)
    edits = f.select(F.when(F.col("lang") == "es", F.concat(F.lit("new/"), F.col("path"))).otherwise(F.col("path")).alias("path"), F.when(F.col("lang") == "en", h).when(F.col("lang") != "es", "old").alias("old_hash"), F.lit("n").alias("new_hash"))
    live = f.select("path", h.alias("content_hash"), F.when(F.col("path").startswith("vendor/"), "vendor").otherwise("source").alias("reason"))
    return ST.preview_edits(live, edits, "reason").select("path", "state", F.col("token").isNotNull().alias("has_token"))


@query("""WITH u AS (SELECT o_custkey AS repo, o_orderkey AS unit, o_orderstatus <> 'P' AS available, CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority <> '1-URGENT' END AS clean, o_totalprice > 60000 AS pinned FROM orders)
SELECT repo, count(*) AS units, CASE WHEN bool_or(NOT available OR clean IS NULL) THEN 'blocked' WHEN bool_or(NOT clean) THEN 'dirty' ELSE 'clean' END AS cleanliness, CASE WHEN bool_or(NOT available) THEN 'blocked' WHEN bool_or(NOT pinned) THEN 'mismatch' ELSE 'complete' END AS pinned,
  sha256('[' || string_agg('{"unit":' || unit || ',"revision":"r' || unit || '","available":' || available || '}', ',' ORDER BY unit) || ']') AS fingerprint FROM u GROUP BY repo""")
def composition_claims(spark, sf_dir):
    p = F.col("o_orderpriority")
    u = t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("repo"), F.col("o_orderkey").alias("unit"), (F.col("o_orderstatus") != "P").alias("available"), F.when(p != "5-LOW", p != "1-URGENT").alias("clean"), (F.col("o_totalprice") > 60_000).alias("pinned"), F.concat(F.lit("r"), F.col("o_orderkey").cast("string")).alias("revision"))
    return SN.composition_claims(u, "repo")
