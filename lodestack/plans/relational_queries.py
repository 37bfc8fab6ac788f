"""Relational queries over the driver tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.functions import authority as A
from lodestack.functions import paths as P
from lodestack.functions.text import is_json
from lodestack.operators import relational as R
from lodestack.operators import store as ST

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# A catalog of files derived from documents: directory and extension follow from doc_id.
DIRS = ["", "src/", "src/core/", "lib/node_modules/x/", "docs/", "docs/design/", "build/out/", ".github/", ".hidden/", "tests/fixtures/a/", "config/credentials/", "vendor/pkg/", "examples/", "docs/archive/", "cmake-build-debug/", "app/models/"]
EXTS = [".py", ".csproj", ".ts", ".js", ".md", ".go", ".rb", ".cpp", ".h", ".json", ".yaml", ".toml", ".pem", ".cs", ".tmp", ".exe", ".env", ".rs", ".java", ".sh", "", ".c", ".cfg", ".txt"]
_LIST = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
FILES_SQL = f"""files AS (SELECT doc_id AS file_id, {_LIST(DIRS)}[doc_id % {len(DIRS)} + 1] || 'f' || doc_id || {_LIST(EXTS)}[(doc_id // 3) % {len(EXTS)} + 1] AS path,
  source AS unit, n_chars AS size_bytes, doc_id * 1000 AS mtime_ms, text, lang FROM documents)"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda xs, i: F.element_at(F.array(*map(F.lit, xs)), (i % len(xs)).cast("int") + 1)
    d = F.col("doc_id")
    return t(spark, sf_dir, "documents").select(d.alias("file_id"), F.concat(at(DIRS, d), F.lit("f"), d.cast("string"), at(EXTS, F.floor(d / 3))).alias("path"), F.col("source").alias("unit"), F.col("n_chars").alias("size_bytes"), (d * 1000).alias("mtime_ms"), "text", "lang")


_EXT = "regexp_extract(lower(regexp_extract(path, '[^/]*$')), '^.+(\\.[^.]*)$', 1)"
_BASE = "regexp_extract(path, '[^/]*$')"


@query(f"""WITH {FILES_SQL}, e AS (SELECT path, {_EXT} AS x FROM files)
SELECT path, CASE {' '.join(f"WHEN x IN ({', '.join(repr(v) for v in own)}) THEN '{k}'" for k, own in P.LANGUAGES.items())} ELSE 'text' END AS language FROM e""")
def language_infer(spark, sf_dir):
    return files(spark, sf_dir).select("path", P.language(F.col("path")).alias("language"))


_SKIP = ", ".join(repr(v) for v in P.SKIPPED_DIRECTORIES)
_VEND = ", ".join(repr(v) for v in P.VENDOR_DIRECTORIES)


@query(f"""WITH {FILES_SQL}, s AS (SELECT path, {_EXT} AS x, lower({_BASE}) AS b, string_split(lower(path), '/') AS seg FROM files), c AS (SELECT path, CASE
  WHEN regexp_matches(b, '^(\\.envrc|credentials(\\.[^/]+)?|secrets(\\.[^/]+)?|.+\\.(key|pem|p12|pfx))$') OR starts_with(path, 'config/credentials/') THEN 'secret'
  WHEN regexp_matches(b, '(~$|^\\.#|\\.(swp|swo|tmp)$)') OR x IN ({', '.join(repr(v) for v in P.SKIPPED_EXTENSIONS)}) THEN 'generated'
  WHEN len(list_filter(seg, lambda y: y IN ({_VEND}))) > 0 THEN 'vendor'
  WHEN len(list_filter(seg, lambda y: y IN ({_SKIP}) OR starts_with(y, 'cmake-build-'))) > 0 THEN 'generated'
  WHEN starts_with(path, 'app/') THEN 'configured_skip'
  WHEN starts_with(path, '.hidden/') THEN 'hidden' ELSE 'source' END AS category FROM s)
SELECT path, category, CASE category WHEN 'source' THEN 'source' WHEN 'secret' THEN 'secret' WHEN 'configured_skip' THEN 'configured_skip' WHEN 'hidden' THEN 'hidden_path' ELSE 'generated_or_vendor' END AS reason,
  CASE WHEN category = 'source' THEN 'allow' ELSE 'skip' END AS read_policy, CASE WHEN category = 'source' THEN 'allow' ELSE 'refuse' END AS write_policy,
  CASE category WHEN 'secret' THEN 'secret' WHEN 'source' THEN 'none' ELSE 'path_only' END AS redaction FROM c""")
def path_policy(spark, sf_dir):
    p = files(spark, sf_dir).select("path", P.policy(F.col("path"), skipped=["app"]).alias("c"))
    return p.select("path", "c.category", "c.reason", F.col("c.read").alias("read_policy"), F.col("c.write").alias("write_policy"), F.col("c.redaction").alias("redaction"))


IGNORE = "# ignore\n*.js\n!f2*.js\n/docs/\nsrc/*.ts\nexamples\n"


@query(f"""WITH {FILES_SQL}, m AS (SELECT path, [regexp_matches(path, '(^|/)[^/]*\\.js(/|$)'), regexp_matches(path, '(^|/)f2[^/]*\\.js(/|$)'), starts_with(path, 'docs/') OR path = 'docs', regexp_matches(path, '^src/[^/]*\\.ts$'),
  regexp_matches(path, '(^|/)examples(/|$)')] AS hit FROM files)
SELECT path, CASE WHEN hit[5] OR hit[4] OR hit[3] THEN true WHEN hit[2] THEN false WHEN hit[1] THEN true ELSE false END AS ignored FROM m""")
def gitignore_lastmatch(spark, sf_dir):
    return files(spark, sf_dir).select("path", P.ignored_by(F.col("path"), P.ignore_rules(IGNORE)).alias("ignored"))


@query(f"""WITH {FILES_SQL}, r AS (SELECT path, CASE WHEN starts_with(path, 'vendor/') OR starts_with(path, 'lib/') THEN 'vendor' WHEN starts_with(path, 'build/') THEN 'build' END AS reason FROM files)
SELECT reason, n, samples FROM (SELECT reason, count(*) AS n, list_sort(min(path, 3)) AS samples FROM r WHERE reason IS NOT NULL GROUP BY reason)""")
def skip_population(spark, sf_dir):
    p = F.col("path")
    r = files(spark, sf_dir).select("path", F.when(P.under_any(p, ["vendor", "lib"]), "vendor").when(P.under_any(p, ["build"]), "build").alias("reason")).where("reason IS NOT NULL")
    return R.samples_by_reason(r, "reason", "path").withColumnRenamed("count", "n")


@query(f"WITH {FILES_SQL} SELECT count(*) AS files, coalesce(sum(CASE WHEN path = 'docs' OR starts_with(path, 'docs/') THEN 1 ELSE 0 END), 0)::BIGINT AS in_scope, coalesce(sum(size_bytes), 0)::BIGINT AS bytes, count(DISTINCT unit) AS units FROM files")
def scope_counts(spark, sf_dir):
    f = files(spark, sf_dir)
    return f.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum(F.when(P.in_scope(F.col("path"), "docs"), 1).otherwise(0)), F.lit(0)).cast("long").alias("in_scope"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"), F.count_distinct("unit").alias("units"))


@query("SELECT l AS lang, count(d.doc_id) AS n FROM (SELECT unnest(['de','en','es','fr','it','pt']) AS l) LEFT JOIN documents d ON d.lang = l GROUP BY l")
def language_counts_zero_filled(spark, sf_dir):
    return R.zero_filled(t(spark, sf_dir, "documents").select("lang"), "lang", ["de", "en", "es", "fr", "it", "pt"])


@query("""WITH c AS (SELECT lang, source, 'k' || (doc_id % 5) AS kind, 1 + (n_chars % 3) AS r FROM documents)
SELECT lang, list_sort(list(DISTINCT source)) AS paths, list_sort(list(DISTINCT kind)) AS kinds, ['low', 'medium', 'high'][max(r)] AS confidence FROM c GROUP BY lang""")
def capability_rollup(spark, sf_dir):
    levels = ["low", "medium", "high"]
    d = t(spark, sf_dir, "documents").select("lang", "source", F.concat(F.lit("k"), (F.col("doc_id") % 5).cast("string")).alias("kind"), F.element_at(F.array(*map(F.lit, levels)), (F.col("n_chars") % 3).cast("int") + 1).alias("conf"))
    return R.capability_summary(d, ["lang"], "source", "kind", "conf", levels)


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey > 500 ORDER BY o_orderkey LIMIT 50")
def keyset_page(spark, sf_dir):
    return R.after_key(t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), "o_orderkey", 500, 50)


@query("SELECT rank, o_orderkey, o_totalprice, true AS more FROM (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank BETWEEN 41 AND 60")
def offset_page_lookahead(spark, sf_dir):
    return R.offset_page(t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 40, 20)


@query(f"""WITH {FILES_SQL}, r AS (SELECT path, size_bytes, row_number() OVER (ORDER BY path) AS n, (sum(size_bytes) OVER (ORDER BY path))::BIGINT AS bytes FROM files)
SELECT path, size_bytes, n, bytes, 'bytes' AS stop FROM r WHERE bytes <= 100000 AND n <= 100""")
def budget_scan(spark, sf_dir):
    return R.budgeted(files(spark, sf_dir).select("path", "size_bytes"), "path", "size_bytes", 100, 100_000)


@query("""WITH s AS (SELECT o_orderkey, o_custkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey, o_orderstatus <> 'P' ORDER BY o_orderkey DESC) AS np, row_number() OVER (PARTITION BY o_custkey, o_orderstatus = 'O' ORDER BY o_orderkey DESC) AS nf FROM orders)
SELECT o_orderkey, o_custkey, o_orderstatus = 'P' OR (o_orderstatus <> 'P' AND np <= 3) OR (o_orderstatus = 'O' AND nf <= 2) AS keep FROM s""")
def retention_prune(spark, sf_dir):
    s = F.col("o_orderstatus")
    return R.retained(t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), ["o_custkey"], "o_orderkey", s != "P", s == "O", s == "P", 3, 2).select("o_orderkey", "o_custkey", "keep")


@query("""WITH e AS (SELECT l_orderkey AS edge_id, l_suppkey AS source, l_partkey % 50 AS target, l_returnflag AS kind, CASE WHEN l_linenumber > 4 THEN NULL ELSE l_linenumber END AS line, l_linestatus AS provenance FROM lineitem),
d AS (SELECT *, row_number() OVER (PARTITION BY source, target, kind, coalesce(line, -1), provenance ORDER BY edge_id) AS n FROM e)
SELECT edge_id, source, target, kind, line, provenance FROM d WHERE n = 1""")
def edge_dedup(spark, sf_dir):
    e = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("edge_id"), F.col("l_suppkey").alias("source"), (F.col("l_partkey") % 50).alias("target"), F.col("l_returnflag").alias("kind"), F.when(F.col("l_linenumber") > 4, None).otherwise(F.col("l_linenumber")).alias("line"), F.col("l_linestatus").alias("provenance"))
    return R.distinct_edges(e, ["source", "target", "kind", "provenance"], ["line"], "edge_id")


@query("""WITH e AS (SELECT l_orderkey AS edge_id, l_suppkey AS source, l_partkey % 50 AS target, l_returnflag AS kind, CASE WHEN l_linenumber > 4 THEN NULL ELSE l_linenumber END AS line FROM lineitem WHERE l_partkey % 50 = 7 AND l_suppkey <> 7),
d AS (SELECT *, row_number() OVER (PARTITION BY source, target, kind, coalesce(line, -1) ORDER BY edge_id) AS n FROM e)
SELECT edge_id, source, kind, line, row_number() OVER (ORDER BY source, kind, coalesce(line, -1), edge_id) AS rank FROM d WHERE n = 1 QUALIFY rank <= 50""")
def incoming_edges_page(spark, sf_dir):
    e = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("edge_id"), F.col("l_suppkey").alias("source"), (F.col("l_partkey") % 50).alias("target"), F.col("l_returnflag").alias("kind"), F.when(F.col("l_linenumber") > 4, None).otherwise(F.col("l_linenumber")).alias("line")).where("target = 7 AND source <> 7")
    d = R.distinct_edges(e, ["source", "target", "kind"], ["line"], "edge_id")
    return R.ranked(d.select("edge_id", "source", "kind", "line"), [F.col("source"), F.col("kind"), F.coalesce("line", F.lit(-1)), F.col("edge_id")], 50)


@query(f"""WITH {FILES_SQL}, units AS (SELECT * FROM (VALUES ('root', '.'), ('docs', 'docs'), ('design', 'docs/design'), ('core', 'src/core'), ('lib', 'lib'), ('lib-x', 'lib/node_modules/x')) u(unit_key, prefix)),
m AS (SELECT path, unit_key, prefix, row_number() OVER (PARTITION BY file_id ORDER BY CASE WHEN prefix = '.' THEN 0 ELSE length(prefix) END DESC, unit_key) AS n FROM files, units WHERE prefix = '.' OR path = prefix OR starts_with(path, prefix || '/'))
SELECT path, unit_key AS unit, prefix AS unit_prefix FROM m WHERE n = 1""")
def longest_prefix_join(spark, sf_dir):
    units = spark.createDataFrame([("root", "."), ("docs", "docs"), ("design", "docs/design"), ("core", "src/core"), ("lib", "lib"), ("lib-x", "lib/node_modules/x")], "unit_key string, prefix string")
    return R.longest_prefix(files(spark, sf_dir).select("path"), "path", units, "prefix", "unit_key")


@query("""WITH s AS (SELECT doc_id, source, lang, n_chars, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS r FROM documents QUALIFY r <= 80)
SELECT doc_id, score, rank FROM (SELECT doc_id, length(source) * 10 + n_chars % 97 AS score, row_number() OVER (ORDER BY length(source) * 10 + n_chars % 97 DESC, doc_id) AS rank FROM s) WHERE rank <= 20""")
def two_stage_topk(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select("doc_id", "n_chars", (F.length("source") * 10 + F.col("n_chars") % 97).alias("score"))
    return R.two_stage(d, [F.desc("n_chars"), F.asc("doc_id")], [F.desc("score"), F.asc("doc_id")], 20).select("doc_id", "score", "rank")


@query("""WITH m AS (SELECT doc_id, source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS l FROM documents)
SELECT doc_id, source, rank FROM (SELECT doc_id, source, row_number() OVER (ORDER BY CASE WHEN l = 1 THEN 0 ELSE 1 END, n_chars DESC, doc_id) AS rank FROM m) WHERE rank <= 30""")
def scope_covering_topk(spark, sf_dir):
    return R.covering(t(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), "source", [F.desc("n_chars"), F.asc("doc_id")], 30).select("doc_id", "source", "rank")


@query("""SELECT doc_id, bucket, rank FROM (SELECT d.doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 0 WHEN quality = 1 THEN 1 WHEN quality IS NULL THEN 2 ELSE 3 END AS bucket,
  row_number() OVER (ORDER BY bucket, n_chars DESC, d.doc_id) AS rank FROM documents d LEFT JOIN labels l USING (doc_id)) WHERE rank <= 300""")
def bucketed_topk(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select("doc_id", "n_chars").join(t(spark, sf_dir, "labels"), "doc_id", "left")
    b = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 0).when(F.col("quality") == 1, 1).when(F.col("quality").isNull(), 2).otherwise(3)
    return R.by_bucket(d, b, [F.desc("n_chars"), F.asc("doc_id")], 300).select("doc_id", "bucket", "rank")


@query("""SELECT path, row_number() OVER (ORDER BY path) AS rank FROM (SELECT source || '/' || lang AS path FROM documents UNION SELECT source || '/' || (doc_id % 7) FROM documents WHERE n_chars > 500) QUALIFY rank <= 100""")
def path_union_page(spark, sf_dir):
    d = t(spark, sf_dir, "documents")
    u = d.select(F.concat_ws("/", "source", "lang").alias("path")).union(d.where("n_chars > 500").select(F.concat_ws("/", "source", (F.col("doc_id") % 7).cast("string")))).distinct()
    return R.ranked(u, [F.col("path")], 100)


@query("""WITH c AS (SELECT o_custkey AS key, o_orderkey AS seq, o_totalprice AS price, o_orderstatus AS status FROM orders)
SELECT key, seq, price, status FROM c QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1""")
def upsert_latest(spark, sf_dir):
    return R.latest(t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status")), ["key"], "seq").select("key", "seq", "price", "status")


@query("""SELECT doc_id, n_chars AS v FROM documents WHERE lang <> 'fr' UNION ALL SELECT doc_id, -n_chars FROM documents WHERE lang = 'fr' AND n_chars > 300""")
def replace_partition(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("p"), F.col("n_chars").alias("v"))
    changed = d.where("p = 'fr' AND v > 300").select("doc_id", "p", (-F.col("v")).alias("v"))
    return R.replace_rows(d, changed, ["p"]).select("doc_id", "v")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unknown_docs(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id").join(t(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query("""SELECT l_orderkey AS node, l_linenumber AS start_line, l_quantity::INT AS start_column FROM lineitem
WHERE (l_linenumber, l_quantity::INT) >= (2, 10) AND (l_linenumber, l_quantity::INT + 5) <= (4, 30)""")
def range_containment(spark, sf_dir):
    n = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("node"), F.col("l_linenumber").alias("start_line"), F.col("l_quantity").cast("int").alias("start_column"), F.col("l_linenumber").alias("end_line"), (F.col("l_quantity").cast("int") + 5).alias("end_column"))
    return R.within_range(n, (2, 10), (4, 30)).select("node", "start_line", "start_column")


@query("""SELECT o_custkey AS snapshot_id, count(*) AS files, count(*) FILTER (WHERE o_orderstatus = 'P') AS unsupported, count(*) FILTER (WHERE o_orderpriority LIKE '1%') AS resource_backed, max(o_orderkey) AS latest_id,
  coalesce(max(o_orderkey), 0) + 1 AS next_id FROM orders GROUP BY o_custkey HAVING count(*) FILTER (WHERE o_orderstatus <> 'P') > 0""")
def snapshot_counts(spark, sf_dir):
    s, o = F.col("o_orderstatus"), t(spark, sf_dir, "orders")
    n = ST.counts_by(o, F.col("o_custkey").alias("snapshot_id"), unsupported=s == "P", resource_backed=F.col("o_orderpriority").startswith("1"), usable=s != "P").withColumnRenamed("n", "files")
    ids = ST.next_ids(o, F.col("o_custkey").alias("snapshot_id"), "o_orderkey")
    return n.where("usable > 0").drop("usable").join(ids, "snapshot_id")


@query("SELECT max(o_custkey) AS snapshot_id FROM orders WHERE o_orderstatus = 'F'")
def latest_usable_snapshot(spark, sf_dir):
    o = t(spark, sf_dir, "orders")
    return ST.latest_where(o, "o_custkey", F.col("o_orderstatus") == "F")


@query("""WITH p AS (SELECT event_type AS reason, user_id % 4 AS page, count(*) AS n, sum(value) AS v FROM events GROUP BY 1, 2)
SELECT reason, sum(n)::BIGINT AS n, round(sum(v), 2) AS v, count(*) AS pages FROM p GROUP BY reason""")
def reason_merge(spark, sf_dir):
    pages = t(spark, sf_dir, "events").groupBy(F.col("event_type").alias("reason"), (F.col("user_id") % 4).alias("page")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("v"))
    return pages.groupBy("reason").agg(F.sum("n").alias("n"), F.round(F.sum("v"), 2).alias("v"), F.count(F.lit(1)).alias("pages"))


@query("""SELECT nation, json_valid_n, bad_n, CASE WHEN bad_n > 0 THEN 'error' ELSE 'info' END AS severity FROM (SELECT event_type AS nation, count(*) FILTER (WHERE json_valid(p)) AS json_valid_n, count(*) FILTER (WHERE NOT json_valid(p)) AS bad_n
FROM (SELECT event_type, CASE WHEN event_id % 11 = 0 THEN substr(props, 2) ELSE props END AS p FROM events) GROUP BY 1)""")
def json_diagnostics(spark, sf_dir):
    e = t(spark, sf_dir, "events").select(F.col("event_type").alias("nation"), F.when(F.col("event_id") % 11 == 0, F.substring(F.col("props"), F.lit(2), F.length("props"))).otherwise(F.col("props")).alias("p"))
    good = is_json(F.col("p"))
    return e.groupBy("nation").agg(F.count_if(good).alias("json_valid_n"), F.count_if(~good).alias("bad_n")).withColumn("severity", F.when(F.col("bad_n") > 0, "error").otherwise("info"))


@query("SELECT doc_id, sha256(text) AS content_hash, strlen(text) AS size_bytes FROM documents")
def text_hash(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"), F.octet_length("text").cast("long").alias("size_bytes"))


@query("""WITH u AS (SELECT c_nationkey AS repo, c_mktsegment AS state, c_acctbal > 0 AS clean, c_custkey FROM customer)
SELECT repo, CASE WHEN bool_or(state = 'MACHINERY') THEN 'blocked' WHEN bool_or(NOT clean) THEN 'dirty' ELSE 'clean' END AS cleanliness, count(*) AS units,
  sha256(string_agg(c_custkey || ':' || state, ',' ORDER BY c_custkey)) AS fingerprint FROM u GROUP BY repo""")
def composition_fingerprint(spark, sf_dir):
    u = t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("repo"), F.col("c_mktsegment").alias("state"), (F.col("c_acctbal") > 0).alias("clean"), "c_custkey")
    units = F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "state"))), lambda x: F.concat_ws(":", x["c_custkey"].cast("string"), x["state"]))
    return u.groupBy("repo").agg(F.when(F.bool_or(F.col("state") == "MACHINERY"), "blocked").when(F.bool_or(~F.col("clean")), "dirty").otherwise("clean").alias("cleanliness"), F.count(F.lit(1)).alias("units"), F.sha2(F.array_join(units, ","), 256).alias("fingerprint"))


@query("""WITH x AS (SELECT doc_id, n_chars, lang, sha256(text) AS h FROM documents), live AS (SELECT doc_id, CASE WHEN doc_id % 7 = 1 THEN n_chars + 1 ELSE n_chars END AS n_chars, h FROM x WHERE lang <> 'de')
SELECT x.doc_id, CASE WHEN live.doc_id IS NULL THEN 'missing' WHEN live.n_chars <> x.n_chars THEN 'changed' ELSE 'valid' END AS state FROM x LEFT JOIN live USING (doc_id)""")
def snapshot_validity(spark, sf_dir):
    from lodestack.operators.snapshots import path_states

    x = t(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang")
    live = x.where("lang <> 'de'").withColumn("n_chars", F.when(F.col("doc_id") % 7 == 1, F.col("n_chars") + 1).otherwise(F.col("n_chars")))
    return path_states(x, live, "doc_id", ["n_chars"])


@query(f"WITH {FILES_SQL} SELECT path, CASE WHEN regexp_matches(path, '^tests/fixtures/[^/]+/.+\\.md$') THEN 'embedded_fixture' ELSE 'eligible' END AS admission FROM files WHERE path LIKE '%.md'")
def corpus_admission(spark, sf_dir):
    return files(spark, sf_dir).where(F.col("path").endswith(".md")).select("path", F.when(P.is_fixture_markdown(F.col("path")), "embedded_fixture").otherwise("eligible").alias("admission"))


_STATUS_SQL = """CASE WHEN d = 'accepted' THEN 'current' WHEN d = 'proposal' THEN 'draft' WHEN regexp_matches(path, '(^|/)(archive|archived)(/|$)') THEN 'archived'
  WHEN regexp_matches(path, '(^|/)(samples?|examples?|fixtures?)(/|$)') THEN 'sample' WHEN starts_with(path, 'docs/design/') THEN 'current' ELSE 'unknown' END"""


@query(f"""WITH {FILES_SQL}, f AS (SELECT path, file_id, CASE WHEN file_id % 9 = 0 THEN 'accepted' WHEN file_id % 9 = 1 THEN '"proposal"' WHEN file_id % 9 = 2 THEN 'nonsense' END AS declared FROM files),
s AS (SELECT path, file_id, {_STATUS_SQL} AS status FROM (SELECT *, replace(declared, '"', '') AS d FROM f)),
c AS (SELECT *, CASE WHEN file_id % 13 = 4 THEN 'superseded' WHEN status = 'current' THEN 'current' WHEN status IN ('historical', 'archived', 'legacy') THEN 'historical' ELSE 'unknown' END AS c1,
  file_id % 11 = 5 AS past, file_id % 17 = 0 AS owned FROM s),
c2 AS (SELECT *, CASE WHEN owned AND status NOT IN ('legacy', 'archived') THEN 'current' ELSE c1 END AS c3 FROM c)
SELECT path, status, CASE WHEN status = 'current' THEN 'canonical' WHEN status IN ('draft', 'unknown', 'historical') THEN 'supporting' ELSE 'non_authoritative' END AS authority,
  CASE status WHEN 'current' THEN 6 WHEN 'draft' THEN -3 WHEN 'sample' THEN -8 WHEN 'archived' THEN -10 ELSE 0 END AS priority,
  CASE WHEN past AND c3 <> 'superseded' THEN 'stale' ELSE c3 END AS currency,
  CASE WHEN past THEN CASE c3 WHEN 'superseded' THEN -12 ELSE -3 END ELSE CASE c1 WHEN 'current' THEN 6 WHEN 'superseded' THEN -12 WHEN 'historical' THEN -6 ELSE 0 END + CASE WHEN owned THEN 4 ELSE 0 END END AS currency_priority FROM c2""")
def status_classify(spark, sf_dir):
    i, p, none = F.col("file_id"), F.col("path"), F.lit(None).cast("string")
    f = files(spark, sf_dir).select("path", "file_id", F.when(i % 9 == 0, "accepted").when(i % 9 == 1, '"proposal"').when(i % 9 == 2, "nonsense").alias("declared"))
    f = f.withColumn("status", A.status(p, none, none, F.col("declared")))
    c = A.currency(p, F.col("status"), none, F.when(i % 13 == 4, "other.md"), F.when(i % 11 == 5, "2020-01-01").when(i % 11 == 6, "2999-01-01").when(i % 11 == 7, "soon"), F.when(i % 17 == 0, p), "2024-06-01T00:00:00Z")
    return f.select("path", "status", A.authority(F.col("status")).alias("authority"), A.authority_priority(F.col("status")).alias("priority"), c["state"].alias("currency"), c["priority"].alias("currency_priority"))


@query("""WITH c AS (SELECT doc_id FROM documents WHERE text LIKE '%the%'), n AS (SELECT count(*) AS c FROM c)
SELECT CASE WHEN c > 500 THEN NULL ELSE doc_id END AS doc_id, least(c, 501) AS seen, c > 500 AS overflow FROM n LEFT JOIN c ON c <= 500""")
def candidate_overflow(spark, sf_dir):
    return R.within_cap(t(spark, sf_dir, "documents").where(F.col("text").contains("the")).select("doc_id"), [F.col("doc_id")], 500)


@query("""WITH f AS (SELECT doc_id, 1 AS s FROM documents WHERE text LIKE '%licen%'), o AS (SELECT doc_id, 1 AS s FROM labels WHERE quality = 0)
SELECT coalesce(f.doc_id, o.doc_id) AS doc_id, CASE WHEN f.s = 1 AND o.s = 1 THEN 'fts_and_matched_owner' WHEN f.s = 1 THEN 'fts' ELSE 'matched_owner' END AS candidate_source FROM f FULL JOIN o USING (doc_id)""")
def candidate_union(spark, sf_dir):
    from lodestack.operators.search import union_candidates

    f = t(spark, sf_dir, "documents").where(F.col("text").contains("licen")).select("doc_id")
    o = t(spark, sf_dir, "labels").where("quality = 0").select("doc_id")
    return union_candidates(f, o, "doc_id")


