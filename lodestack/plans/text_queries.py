"""Search, documentation, graph and change-feed queries over the driver tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestack.functions import authority as A
from lodestack.functions import paths as P
from lodestack.functions import text as T
from lodestack.operators import docs as D
from lodestack.operators import graph as G
from lodestack.operators import relational as R
from lodestack.operators import search as S
from lodestack.plans.relational_queries import FILES_SQL, files, t
from lodestack.streaming import changes as C

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_TOK = "list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9_]+'), lambda x: x <> '')"
TERMS = ["thand", "license", "idiot"]


def _bm25_sql(terms, src="documents", key="doc_id"):
    tf = ", ".join(f"len(list_filter(tk, lambda x: x = '{w}')) AS tf{i}" for i, w in enumerate(terms))
    dfs = ", ".join(f"count(*) FILTER (WHERE tf{i} > 0) AS df{i}" for i in range(len(terms)))
    s = " + ".join(f"greatest(ln((n - df{i} + 0.5) / (df{i} + 0.5)), 1e-6) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * len / al))" for i in range(len(terms)))
    return f"""WITH k AS (SELECT {key}, {_TOK.format('text')} AS tk FROM {src}), c AS (SELECT {key}, len(tk) AS len, {tf} FROM k), g AS (SELECT count(*) AS n, avg(len) AS al, {dfs} FROM c),
s AS (SELECT {key}, round({s}, 6) AS score FROM c, g WHERE {' OR '.join(f'tf{i} > 0' for i in range(len(terms)))})
SELECT {key}, score, row_number() OVER (ORDER BY score DESC, {key}) AS rank FROM s QUALIFY rank <= 50"""


@query(_bm25_sql(TERMS))
def fts_bm25_topk(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select("doc_id", "text")
    hits = S.bm25(d, {"text": 1.0}, T.docs_terms(" ".join(TERMS))).select("doc_id", F.round("score", 6).alias("score"))
    return R.ranked(hits, [F.desc("score"), F.asc("doc_id")], 50)


@query(f"""SELECT p_partkey, p_name FROM (SELECT *, {_TOK.format('p_name')} AS tk FROM part) WHERE len(list_filter(tk, lambda x: starts_with(x, 'r'))) > 0 AND len(list_filter(tk, lambda x: starts_with(x, 'wid'))) > 0""")
def fts_prefix_and(spark, sf_dir):
    return S.prefix_and(t(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", T.symbol_terms("r wid"))


@query("SELECT doc_id FROM documents WHERE contains(' ' || array_to_string(" + _TOK.format("text") + ", ' ') || ' ', ' apache license ')")
def fts_quoted_phrase(spark, sf_dir):
    return t(spark, sf_dir, "documents").where(S.phrase_at(F.col("text"), T.phrases(T.docs_terms("apache/license"))[0])).select("doc_id")


_Q, _QT = "apache license", ["apache", "license"]
_TS = lambda c: f"(CASE WHEN contains(lower({c}), '{_Q}') THEN 4 ELSE 0 END + CASE WHEN contains(lower({c}), 'apache') THEN 1 ELSE 0 END + CASE WHEN contains(lower({c}), 'license') THEN 1 ELSE 0 END)"


@query(f"""WITH {FILES_SQL}, f AS (SELECT file_id, path, string_split(text, chr(10)) AS ln, text FROM files),
s AS (SELECT file_id, path, greatest(0.0, 8 * {_TS('ln[1]')} + 6 * {_TS('path')} + 5 * {_TS("array_to_string(ln[2:4], chr(10))")} + {_TS('text')}
  + CASE WHEN starts_with(path, 'docs/design/') THEN 1.25 ELSE 0 END + CASE WHEN starts_with(path, 'examples/') THEN -2.0 ELSE 0 END
  + CASE WHEN starts_with(path, 'docs/archive/') THEN -10 WHEN starts_with(path, 'docs/design/') THEN 6 WHEN starts_with(path, 'examples/') OR starts_with(path, 'tests/fixtures/') THEN -8 ELSE 0 END) AS score FROM f)
SELECT file_id, path, score, row_number() OVER (ORDER BY score DESC, path) AS rank FROM s WHERE score > 0 QUALIFY rank <= 60""")
def docs_legacy_score(spark, sf_dir):
    p, none = F.col("path"), F.lit(None).cast("string")
    lines = F.split("text", "\n")
    f = files(spark, sf_dir).select("file_id", "path", "text", F.element_at(lines, 1).alias("title"), F.slice(lines, 2, 3).alias("heads"))
    boost = T.field_boost(F.col("title"), p, F.col("heads"), F.col("text"), _Q, _QT)
    score = F.greatest(F.lit(0.0), boost + A.path_boost(p) + A.authority_priority(A.status(p, none, none, none)))
    return R.ranked(f.select("file_id", "path", score.alias("score")).where("score > 0"), [F.desc("score"), F.asc("path")], 60)


@query("""WITH p AS (SELECT doc_id, text, CASE WHEN instr(lower(text), 'apache license') > 0 THEN instr(lower(text), 'apache license') WHEN instr(lower(text), 'apache') > 0 THEN instr(lower(text), 'apache') ELSE instr(lower(text), 'license') END AS pos FROM documents)
SELECT doc_id, trim(regexp_replace(CASE WHEN pos > 0 THEN substr(text, greatest(pos - 70, 1)::BIGINT, (pos + 130 - greatest(pos - 70, 1))::BIGINT) ELSE substr(text, 1, 220) END, '[ \t\n\r\f]+', ' ', 'g')) AS snippet FROM p""")
def snippet_window(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", T.snippet(F.col("text"), _Q, _QT).alias("snippet"))


@query(f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS h, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
s AS (SELECT doc_id, h, pos, {_TS('h')} AS score FROM l)
SELECT doc_id, h AS heading, pos::INT AS "at" FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) = 1""")
def best_heading(spark, sf_dir):
    b = t(spark, sf_dir, "documents").select("doc_id", T.best_heading(F.split("text", "\n"), _Q, _QT).alias("b")).where("b IS NOT NULL")
    return b.select("doc_id", F.col("b.text").alias("heading"), F.col("b.at").alias("at"))


_NORM = "trim(regexp_replace(regexp_replace(lower({0}), '[\\p{{P}}\\p{{S}}\\p{{Z}}]+', ' ', 'g'), '[ \\t\\n\\r\\f]+', ' ', 'g'))"


@query(f"""WITH w AS (SELECT item_id, string_split({_NORM.format('text')}, ' ') AS w FROM benchmark), g AS (SELECT item_id, w, unnest(generate_series(1, 3)) AS n FROM w),
h AS (SELECT item_id, n, unnest(CASE WHEN len(w) >= n THEN generate_series(0, len(w) - n) ELSE [] END) AS start, w FROM g), q AS (SELECT item_id, array_to_string(w[start + 1:start + n], ' ') AS term, start::INT AS start, n::INT AS n FROM h),
terms AS (SELECT DISTINCT array_to_string(string_split({_NORM.format('text')}, ' ')[1:1 + doc_id % 3], ' ') AS term FROM documents)
SELECT item_id, q.term, start, n, replace(q.term, ' ', '-') AS concern FROM q JOIN terms USING (term)""")
def phrase_ngram_match(spark, sf_dir):
    words = F.split(T.normalised(T.leading_words(F.col("text"), 3)), " ")  # a term has three words at most
    terms = t(spark, sf_dir, "documents").select(F.array_join(F.slice(words, F.lit(1), (F.col("doc_id") % 3 + 1).cast("int")), " ").alias("term"))
    return S.resolve_phrases(t(spark, sf_dir, "benchmark"), "item_id", "text", terms, "term", 3).withColumn("concern", T.concern_key(F.col("term")))


_RANK_SQL = """WITH c AS (SELECT d.doc_id, source AS path, CASE WHEN doc_id % 4 = 0 THEN 0 ELSE 1 END AS owner_priority, CASE WHEN contains(text, 'license') THEN 2 WHEN doc_id % 3 = 0 THEN 3 ELSE 4 END AS band,
  CASE WHEN quality = 1 THEN 'canonical' WHEN quality IS NULL THEN 'supporting' ELSE 'non_authoritative' END AS authority, CASE WHEN toxic = 1 THEN 'superseded' WHEN toxic = 0 THEN 'current' ELSE 'unknown' END AS currency,
  CASE WHEN doc_id % 7 = 0 THEN NULL ELSE n_chars % 50 END AS lexical FROM documents d LEFT JOIN labels l USING (doc_id)),
o AS (SELECT *, CASE WHEN doc_id % 4 = 0 AND authority = 'canonical' AND currency = 'current' THEN 0 WHEN doc_id % 4 = 0 THEN 1 WHEN doc_id % 5 = 1 THEN 3 ELSE 2 END AS owner_tier FROM c)
SELECT doc_id, band, owner_tier, authority, currency, row_number() OVER (ORDER BY owner_priority, band, owner_tier, CASE authority WHEN 'canonical' THEN 1 WHEN 'supporting' THEN 2 ELSE 3 END,
  CASE currency WHEN 'current' THEN 1 WHEN 'unknown' THEN 2 ELSE 5 END, lexical DESC NULLS LAST, path, doc_id) AS rank FROM o QUALIFY rank <= 500"""


@query(_RANK_SQL)
def rank_tuple_order(spark, sf_dir):
    d = t(spark, sf_dir, "documents").join(t(spark, sf_dir, "labels"), "doc_id", "left")
    i = F.col("doc_id")
    c = d.select(
        "doc_id", F.col("source").alias("path"), F.when(i % 4 == 0, 0).otherwise(1).alias("owner_priority"),
        F.when(F.col("text").contains("license"), 2).when(i % 3 == 0, 3).otherwise(4).alias("band"),
        F.when(F.col("quality") == 1, "canonical").when(F.col("quality").isNull(), "supporting").otherwise("non_authoritative").alias("authority"),
        F.when(F.col("toxic") == 1, "superseded").when(F.col("toxic") == 0, "current").otherwise("unknown").alias("currency"), F.when(i % 7 == 0, None).otherwise(F.col("n_chars") % 50).alias("lexical"),
    )
    states = F.when(i % 4 == 0, F.array(F.lit("valid"))).when(i % 5 == 1, F.array(F.lit("draft"))).otherwise(F.array().cast("array<string>"))
    c = c.withColumn("owner_tier", S.owner_tier(states, F.col("authority"), F.col("currency")))
    return S.rank_documents(c).select("doc_id", "band", "owner_tier", "authority", "currency", "rank")


@query("""WITH n AS (SELECT doc_id, ' ' || trim(regexp_replace(regexp_replace(lower(source || ' ' || lang), '[\\p{P}\\p{S}\\p{Z}]+', ' ', 'g'), ' +', ' ', 'g')) || ' ' AS head, string_split(trim(regexp_replace(lower(text), '[\\p{P}\\p{S}\\p{Z}]+', ' ', 'g')), ' ') AS body,
  contains(text, 'the') AS fts, doc_id % 6 = 0 AS own FROM documents)
SELECT doc_id, CASE WHEN fts AND contains(head, ' src3 en ') THEN 0 WHEN fts AND contains(head, ' src3 ') AND contains(head, ' en ') THEN 1 WHEN fts AND list_contains(body, 'src3') AND list_contains(body, 'en') THEN 2 WHEN own THEN 3 ELSE 4 END AS band FROM n""")
def relevance_bands(spark, sf_dir):
    i = F.col("doc_id")
    d = t(spark, sf_dir, "documents")
    return d.select("doc_id", S.relevance_band("src3 en", F.col("source"), F.array("lang"), F.col("text"), F.col("text").contains("the"), i % 6 == 0).alias("band"))


@query("""WITH m AS (SELECT doc_id % 50 AS c, lang AS term, source AS owner, n_chars AS line, doc_id FROM documents) SELECT 'c' || c AS concern_key, term, owner, line AS source_line FROM m QUALIFY row_number() OVER (PARTITION BY c, term, owner ORDER BY line, doc_id) = 1""")
def concern_term_merge(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select(F.concat(F.lit("c"), (F.col("doc_id") % 50).cast("string")).alias("concern_key"), F.col("lang").alias("term"), F.col("source").alias("owner"), F.col("n_chars").alias("source_line"))
    return S.merged_terms(d)


# Pages.


@query("""SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1) AS h1, len(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS links,
  regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path FROM pages""")
def page_outline(spark, sf_dir):
    return t(spark, sf_dir, "pages").select("page_id", D.title(F.col("html")).alias("title"), D.headings(F.col("html"))[0]["text"].alias("h1"), F.size(D.links(F.col("html"))).cast("long").alias("links"), D.host(F.col("url")).alias("host"), D.url_path(F.col("url")).alias("path"))


@query("""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages), p AS (SELECT DISTINCT regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path FROM pages)
SELECT page_id, href, EXISTS (SELECT 1 FROM p WHERE p.path = l.href) AS found FROM (SELECT DISTINCT page_id, href FROM l) l""")
def link_check(spark, sf_dir):
    pages = t(spark, sf_dir, "pages")
    targets = pages.select(D.url_path(F.col("url")).alias("path"))
    return D.check_links(pages.select("page_id", F.explode(D.links(F.col("html"))).alias("href")).distinct(), "href", targets, "path")


@query("""WITH p AS (SELECT page_id, substr(html, strpos(html, '<h1>')) AS s FROM pages WHERE contains(html, '<h1>')) SELECT page_id, strlen(s) AS bytes, substr(s, 1, 200) AS section FROM p""")
def section_extract(spark, sf_dir):
    s = D.html_section(F.col("html"), 1)
    return t(spark, sf_dir, "pages").where(F.col("html").contains("<h1>")).select("page_id", F.octet_length(s).cast("long").alias("bytes"), F.substring(s, 1, 200).alias("section"))


_WORDS = "list_slice(" + _TOK.format("text") + ", 1, 3)"


@query(f"""WITH s AS (SELECT doc_id, source, array_to_string({_WORDS}, '-') AS slug FROM documents), n AS (SELECT *, row_number() OVER (PARTITION BY source, slug ORDER BY doc_id) AS k FROM s)
SELECT doc_id, CASE WHEN k = 1 THEN slug ELSE slug || '-' || k END AS slug FROM n""")
def slug_suffix(spark, sf_dir):
    s = t(spark, sf_dir, "documents").select("doc_id", "source", F.array_join(F.slice(T.tokens(F.regexp_extract("text", "^[^A-Za-z0-9_]*(?:[A-Za-z0-9_]+[^A-Za-z0-9_]*){0,3}", 0)), 1, 3), "-").alias("slug"))
    return D.unique_slugs(s, ["source"], "slug", "doc_id").select("doc_id", "slug")


@query("""WITH h AS (SELECT conv_id, turn, CASE role WHEN 'system' THEN 1 WHEN 'user' THEN 2 ELSE 2 + turn % 3 END AS depth FROM conversations), l AS (SELECT *, lag(depth) OVER (PARTITION BY conv_id ORDER BY turn) AS before,
  (SELECT min(b.turn) FROM h b WHERE b.conv_id = h.conv_id AND b.turn > h.turn AND b.depth <= h.depth) AS until FROM h)
SELECT conv_id, turn, depth, coalesce(depth > before + 1, false) AS skips, until FROM l""")
def heading_sections(spark, sf_dir):
    h = t(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("role") == "system", 1).when(F.col("role") == "user", 2).otherwise((F.col("turn") % 3 + 2).cast("int")).alias("depth"))
    return D.sections(h, "conv_id", "turn", "depth")


# Graph.

_EDGES = """e AS (SELECT * FROM (SELECT n_nationkey + 100 AS edge_id, 'r' || n_regionkey AS s, 'n' || n_nationkey AS t FROM nation UNION ALL SELECT c_custkey + 1000, 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION ALL SELECT o_orderkey + 10000000, 'c' || o_custkey, 'o' || o_orderkey FROM orders))"""


def _graph(spark, sf_dir):
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    row = lambda df, i, s, d: df.select(i.cast("long").alias("edge_id"), s.alias("source"), d.alias("target"))
    e = row(t(spark, sf_dir, "nation"), F.col("n_nationkey") + 100, name("r", "n_regionkey"), name("n", "n_nationkey"))
    e = e.unionByName(row(t(spark, sf_dir, "customer"), F.col("c_custkey") + 1000, name("n", "c_nationkey"), name("c", "c_custkey")))
    return e.unionByName(row(t(spark, sf_dir, "orders"), F.col("o_orderkey") + 10_000_000, name("c", "o_custkey"), name("o", "o_orderkey")))


@query(f"""WITH {_EDGES}, l0 AS (SELECT 'r1' AS node, 0 AS depth, 1 AS rank), l1 AS (SELECT t AS node, 1 AS depth, 1 + row_number() OVER (ORDER BY min(edge_id), t) AS rank FROM e WHERE s = 'r1' GROUP BY t),
b2 AS (SELECT t AS node, min((l1.rank, edge_id)) AS via FROM e JOIN l1 ON e.s = l1.node GROUP BY t), l2 AS (SELECT node, 2 AS depth, (SELECT max(rank) FROM l1) + row_number() OVER (ORDER BY via, node) AS rank FROM b2)
SELECT node, depth, rank, (SELECT max(rank) FROM l2) > 60 AS truncated FROM (SELECT * FROM l0 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2) WHERE rank <= 60""")
def bounded_bfs(spark, sf_dir):
    e = _graph(spark, sf_dir)
    nodes = e.select(F.explode(F.array("source", "target")).alias("node")).distinct()
    start = spark.range(1, numPartitions=1).select(F.lit("r1").alias("node"))
    return G.traverse(nodes, e, start, max_depth=2, max_nodes=60)


@query("""WITH e AS (SELECT l_suppkey AS node, l_shipdate, CASE WHEN l_suppkey % 7 = 5 THEN 3 ELSE l_partkey % 9 END AS file, CASE WHEN l_returnflag = 'R' AND l_suppkey % 3 = 0 THEN 'cloudformation' ELSE 'parser' END AS provenance, CASE WHEN l_suppkey % 4 = 1 THEN l_discount * 10 ELSE 0.9 END AS conf FROM lineitem)
SELECT node, count(*) AS edges, count(DISTINCT file) AS files, CASE WHEN count(DISTINCT file) <= 1 THEN 'low/local_only' WHEN bool_or(provenance = 'cloudformation') OR bool_or(conf < 0.7) THEN 'low/graph' WHEN count(*) > 0 AND bool_or(node % 5 = 2) THEN 'medium/graph' ELSE 'high/graph' END AS confidence FROM e GROUP BY node""")
def impact_confidence(spark, sf_dir):
    s = F.col("l_suppkey")
    p = F.when(s % 7 == 5, 3).otherwise(F.col("l_partkey") % 9)
    e = t(spark, sf_dir, "lineitem").select(s.alias("node"), p.alias("file"), F.when((F.col("l_returnflag") == "R") & (s % 3 == 0), "cloudformation").otherwise("parser").alias("provenance"), F.when(s % 4 == 1, F.col("l_discount") * 10).otherwise(0.9).alias("conf"))
    return G.impact_confidence(e, ["node"], "file", "provenance", "conf", F.col("node") % 5 == 2)


@query("""WITH n AS (SELECT p_partkey, p_name AS name, lower(p_brand || '.' || p_name) AS qn, p_type AS language, p_brand AS path FROM part), m AS (SELECT *, CASE WHEN name = 'red widget' THEN 0 WHEN contains(lower(name), 'red widget') OR contains(qn, 'red widget') THEN 10 END AS match FROM n)
SELECT p_partkey AS node_id, match, row_number() OVER (ORDER BY match, name, path, p_partkey) AS rank, false AS exact_miss FROM m WHERE match = 0 QUALIFY rank <= 100""")
def symbol_search(spark, sf_dir):
    n = t(spark, sf_dir, "part").select(F.col("p_partkey").alias("node_id"), F.col("p_name").alias("name"), F.lower(F.concat_ws(".", "p_brand", "p_name")).alias("qualified_name"), F.col("p_type").alias("language"), F.col("p_brand").alias("path"))
    return G.search_symbols(n, "red widget", k=100).select("node_id", "match", "rank", "exact_miss")


@query("""WITH n AS (SELECT p_partkey AS node_id, lower(p_name) AS name, p_type AS kind FROM part), r AS (SELECT s_suppkey AS ref_id, CASE WHEN s_suppkey % 3 = 0 THEN 'red widget' ELSE 'Supplier#' || s_suppkey END AS name FROM supplier
  UNION ALL SELECT 10000000000 + c_custkey, c_name FROM customer),
x AS (SELECT lower('Customer#' || lpad(c_custkey::VARCHAR, 9, '0')) AS name, 500000 + c_custkey AS node_id FROM customer UNION ALL SELECT name, node_id FROM n), g AS (SELECT name, count(*) AS n, min(node_id) AS one FROM x GROUP BY name)
SELECT ref_id, CASE WHEN coalesce(g.n, 0) = 1 THEN one END AS target, coalesce(g.n, 0) AS candidate_count, CASE WHEN coalesce(g.n, 0) = 1 THEN 'resolved' WHEN coalesce(g.n, 0) > 1 THEN 'ambiguous' ELSE 'unresolved' END AS resolution FROM r LEFT JOIN g ON lower(r.name) = g.name""")
def resolve_unique_names(spark, sf_dir):
    text = lambda c: c.cast("string")
    nodes = t(spark, sf_dir, "part").select(F.col("p_partkey").alias("node_id"), F.col("p_name").alias("name"))
    nodes = nodes.union(t(spark, sf_dir, "customer").select(F.col("c_custkey") + 500_000, "c_name")).select("node_id", "name", F.lit(None).cast("string").alias("qualified_name"), F.lit("function").alias("kind"), F.lit("go").alias("language"), F.lit("a/b.go").alias("path"))
    k = F.col("s_suppkey")
    refs = t(spark, sf_dir, "supplier").select(k.alias("ref_id"), F.when(k % 3 == 0, "red widget").otherwise(F.concat(F.lit("Supplier#"), text(k))).alias("name"))
    refs = refs.union(t(spark, sf_dir, "customer").select(F.col("c_custkey") + 10_000_000_000, "c_name"))
    none = F.lit(None).cast("string")
    refs = refs.select("ref_id", F.lit("m").alias("source"), "name", F.lit("call").alias("kind"), F.lit("go").alias("language"), F.lit(True).alias("static"), none.alias("receiver"), none.alias("import_dir"), F.array().cast("array<string>").alias("paths"))
    return G.resolve_references(refs, nodes).select("ref_id", "target", "candidate_count", "resolution")


@query("""WITH x AS (SELECT lower(p_name) AS name, 'p' || p_partkey AS node_id FROM part UNION ALL SELECT lower(c_name), 'c' || c_custkey FROM customer), g AS (SELECT name, count(*) AS n, min(node_id) AS one FROM x GROUP BY name),
r AS (SELECT 's' || s_suppkey AS ref_id, CASE WHEN s_suppkey % 3 = 0 THEN 'red widget' ELSE 'Supplier#' || s_suppkey END AS name FROM supplier UNION ALL SELECT 'c' || c_custkey, c_name FROM customer)
SELECT ref_id, CASE WHEN coalesce(g.n, 0) = 1 THEN one END AS target, coalesce(g.n, 0) AS candidate_count, CASE WHEN coalesce(g.n, 0) = 1 THEN 'resolved' WHEN coalesce(g.n, 0) > 1 THEN 'ambiguous' ELSE 'unresolved' END AS resolution FROM r LEFT JOIN g ON lower(r.name) = g.name""")
def resolve_every_name(spark, sf_dir):
    """As resolve_unique_names, with the names of all customers to resolve; ids of each table have a prefix of their own."""
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    none, k = F.lit(None).cast("string"), F.col("s_suppkey")
    customers = t(spark, sf_dir, "customer").select(key("c", "c_custkey").alias("id"), F.col("c_name").alias("name"))
    nodes = t(spark, sf_dir, "part").select(key("p", "p_partkey").alias("id"), F.col("p_name").alias("name")).union(customers)
    nodes = nodes.select(F.col("id").alias("node_id"), "name", none.alias("qualified_name"), F.lit("function").alias("kind"), F.lit("go").alias("language"), F.lit("a/b.go").alias("path"))
    refs = t(spark, sf_dir, "supplier").select(key("s", "s_suppkey").alias("id"), F.when(k % 3 == 0, "red widget").otherwise(key("Supplier#", "s_suppkey")).alias("name")).union(customers)
    refs = refs.select(F.col("id").alias("ref_id"), F.lit("m").alias("source"), "name", F.lit("call").alias("kind"), F.lit("go").alias("language"), F.lit(True).alias("static"), none.alias("receiver"), none.alias("import_dir"), F.array().cast("array<string>").alias("paths"))
    return G.resolve_references(refs, nodes).select("ref_id", "target", "candidate_count", "resolution")


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents WHERE contains(text, 'the')),
p AS (SELECT doc_id, line, regexp_split_to_array(' ' || regexp_replace(s, '[^A-Za-z0-9_]', ' ', 'g') || ' ', ' the ') AS parts, regexp_replace(s, '[^A-Za-z0-9_]', ' ', 'g') AS z FROM l),
w AS (SELECT doc_id, line, string_split(z, ' ') AS ws FROM p), c AS (SELECT doc_id, line, unnest(ws) AS word, generate_subscripts(ws, 1) AS k, ws FROM w)
SELECT doc_id, line::INT AS line, (list_sum(list_transform(ws[1:k - 1], lambda x: length(x))) + k - 1)::INT AS col FROM c WHERE word = 'the' AND k > 1 UNION ALL SELECT doc_id, line::INT, 0 FROM c WHERE word = 'the' AND k = 1""")
def lexical_scan(spark, sf_dir):
    return G.lexical_references(t(spark, sf_dir, "documents"), "doc_id", "text", "the", "doc_id")


@query("""WITH a AS (SELECT n_nationkey AS k, 'src/pkg' || n_regionkey || '/mod' || n_nationkey || '/a' AS p FROM nation), b AS (SELECT s_suppkey AS k, 'src/pkg' || (s_nationkey % 5) || '/mod' || s_nationkey || '/t' || (s_suppkey % 3) AS p FROM supplier),
d AS (SELECT a.k AS file, b.k AS test, string_split(a.p, '/') AS x, string_split(b.p, '/') AS y FROM a, b), s AS (SELECT file, test, len(x) + len(y) - 2 * CASE WHEN x[2] <> y[2] THEN 1 WHEN x[3] <> y[3] THEN 2 ELSE 3 END AS distance FROM d)
SELECT file, test, distance FROM s QUALIFY row_number() OVER (PARTITION BY file ORDER BY distance, test) = 1""")
def nearest_by_distance(spark, sf_dir):
    text = lambda c: c.cast("string")
    n, s = t(spark, sf_dir, "nation"), t(spark, sf_dir, "supplier")
    a = n.select(F.col("n_nationkey").alias("file"), F.concat(F.lit("src/pkg"), text(F.col("n_regionkey")), F.lit("/mod"), text(F.col("n_nationkey")), F.lit("/a")).alias("p"))
    b = s.select(F.col("s_suppkey").alias("test"), F.concat(F.lit("src/pkg"), text(F.col("s_nationkey") % 5), F.lit("/mod"), text(F.col("s_nationkey")), F.lit("/t"), text(F.col("s_suppkey") % 3)).alias("p"))
    return D.nearest(a, "file", "p", b, "test", "p")


# Changes.


@query("""WITH e AS (SELECT user_id, event_id AS seq, ts, CASE event_type WHEN 'signup' THEN 'created' WHEN 'error' THEN 'deleted' ELSE 'modified' END AS kind FROM events), g AS (SELECT *, max(CASE WHEN kind = 'deleted' THEN seq END) OVER (PARTITION BY user_id) AS gone FROM e),
a AS (SELECT user_id, any_value(gone) AS gone, max(seq) AS last_seq, arg_max(ts, seq) AS last_ts, arg_max(kind, seq) AS last_kind, arg_min(kind, seq) FILTER (WHERE gone IS NULL OR seq > gone) AS first_kind, min(seq) FILTER (WHERE gone IS NULL OR seq > gone) AS first_seq,
  max(seq) FILTER (WHERE kind = 'created' AND (gone IS NULL OR seq > gone)) AS made_seq, arg_max(ts, seq) FILTER (WHERE kind = 'created' AND (gone IS NULL OR seq > gone)) AS made_ts FROM g GROUP BY user_id),
k AS (SELECT *, CASE WHEN last_kind = 'deleted' THEN 'deleted' WHEN gone IS NOT NULL AND first_kind = 'created' AND made_seq = first_seq THEN 'modified' WHEN made_seq IS NOT NULL THEN 'created' ELSE 'modified' END AS kind FROM a)
SELECT user_id AS path, kind, CASE WHEN kind = 'created' THEN made_ts ELSE last_ts END AS "at" FROM k""")
def cdc_coalesce(spark, sf_dir):
    k = F.col("event_type")
    e = t(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("ts").alias("at"), F.when(k == "signup", "created").when(k == "error", "deleted").otherwise("modified").alias("kind"), F.col("user_id").alias("path"))
    return C.coalesced(e)


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS cut FROM events), s AS (SELECT user_id, ts, sum(cut) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def debounce_sessions(spark, sf_dir):
    return C.quiet_periods(t(spark, sf_dir, "events"), ["user_id"], "ts", "2 hours")


@query("""SELECT '.' AS path, 'modified' AS kind, 'overflow' AS status FROM events HAVING count(DISTINCT user_id) > 100
UNION ALL SELECT 'p' || user_id, CASE WHEN arg_max(event_type, event_id) = 'error' THEN 'deleted' ELSE 'modified' END, 'drained' FROM events WHERE (SELECT count(DISTINCT user_id) FROM events) <= 100 GROUP BY user_id
UNION ALL SELECT 'p' || (user_id % 40), CASE WHEN arg_max(event_type, event_id) = 'error' THEN 'deleted' ELSE 'modified' END, 'drained' FROM events GROUP BY user_id % 40""")
def pending_overflow(spark, sf_dir):
    """Two queues: one path a user, which is more than a hundred, and forty paths."""
    k = F.when(F.col("event_type") == "error", "deleted").otherwise("modified")
    e = t(spark, sf_dir, "events")
    queue = lambda u: e.select(F.concat(F.lit("p"), u.cast("string")).alias("path"), F.col("event_id").alias("seq"), k.alias("kind"), F.col("ts").alias("at"))
    return C.drained(queue(F.col("user_id")), 100).unionByName(C.drained(queue(F.col("user_id") % 40), 100)).select("path", "kind", "status")


@query(f"""WITH {FILES_SQL} SELECT path, trim(regexp_replace(path, '/?[^/]*$', '')) AS dir, {"regexp_extract(path, '[^/]*$')"} AS base, len(string_split(path, '/')) AS depth FROM files""")
def path_parts(spark, sf_dir):
    p = F.col("path")
    return files(spark, sf_dir).select("path", P.dirname(p).alias("dir"), P.basename(p).alias("base"), F.size(P.segments(p)).cast("long").alias("depth"))


_REDACTED = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?i)\b(token|secret|password|passwd|api_?key)\b(\s*[:=]\s*)["'']?[^\s"'']+["'']?', '\1\2[redacted]', 'g'), '\bAKIA[0-9A-Z]{16}\b', '[redacted]', 'g'), '(?i)\bBearer\s+[A-Za-z0-9._~+/-]+=*', 'Bearer [redacted]', 'g'), '(?:/home|/Users|/root)/[^\s"'']+', '[path]', 'g')"""


@query(f"SELECT doc_id, sha256({_REDACTED}) AS redacted_sha256, text <> {_REDACTED} AS changed FROM documents")
def redaction(spark, sf_dir):
    out = T.redacted(F.col("text"))
    return t(spark, sf_dir, "documents").select("doc_id", "text", out.alias("out")).select("doc_id", F.sha2("out", 256).alias("redacted_sha256"), (F.col("text") != F.col("out")).alias("changed"))


