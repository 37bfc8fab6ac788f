"""Planning queries over the catalog derived from documents, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestack.functions import authority as A
from lodestack.plans import planning as PL
from lodestack.plans.relational_queries import FILES_SQL, files, t

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _points(rules):
    return " + ".join(f"CASE WHEN regexp_matches(lower(path), '{r}') THEN {float(n)} ELSE 0.0 END" for r, n in rules)


@query(f"""WITH {FILES_SQL}, s AS (SELECT path, CASE {' '.join(f"WHEN regexp_matches(lower(path), '{r}') THEN {float(n)}" for r, n in PL.KEY_FILE_ALONE)} ELSE {_points(PL.KEY_FILE_SUM)} END::DOUBLE AS score FROM files)
SELECT path, score, row_number() OVER (ORDER BY score DESC, path) AS rank FROM s QUALIFY rank <= 40""")
def key_files(spark, sf_dir):
    from lodestack.operators.relational import ranked

    f = files(spark, sf_dir).select("path", PL.key_file_rank(F.col("path")).alias("score"))
    return ranked(f, [F.desc("score"), F.asc("path")], 40)


@query(f"""WITH {FILES_SQL} SELECT path, ({_points(PL.DOC_IMPORTANCE)})::DOUBLE AS importance, ({_points(PL.KEY_DOCS)} + 10 * CASE WHEN starts_with(path, 'docs/archive/') THEN -10 WHEN regexp_matches(path, '^(examples|tests/fixtures)/') THEN -8 WHEN starts_with(path, 'docs/design/') THEN 6 ELSE 0 END)::DOUBLE AS score FROM files WHERE path LIKE '%.md'""")
def key_docs(spark, sf_dir):
    p, none = F.col("path"), F.lit(None).cast("string")
    return files(spark, sf_dir).where(p.endswith(".md")).select("path", PL.doc_importance(p).alias("importance"), PL.key_doc_rank(p, A.status(p, none, none, none)).alias("score"))


_TASK = "fix the python core parser in src"


def _term(w):
    return f"CASE WHEN list_contains(regexp_split_to_array(lower(path), '[^a-z0-9_]+'), '{w}') THEN 3.0 WHEN contains(lower(path), '{w}') THEN 1.0 ELSE 0.0 END"


@query(f"""WITH {FILES_SQL}, s AS (SELECT path, greatest(0.0, {' + '.join(_term(w) for w in PL.task_terms(_TASK))} + CASE WHEN regexp_matches(lower(path), '^(src|lib|app|cmd|internal|include|tests?|packages)/') THEN 2.0 ELSE 0.0 END
  + CASE WHEN path LIKE '%.py' THEN 2.0 ELSE 0.0 END - ({_points(PL.NOISE)}))::DOUBLE AS score FROM files)
SELECT path, score, row_number() OVER (ORDER BY score DESC, path) AS rank FROM s WHERE score > 0 QUALIFY rank <= 25""")
def related_files(spark, sf_dir):
    from lodestack.operators.relational import ranked

    f = files(spark, sf_dir).select("path", PL.file_score(F.col("path"), PL.task_terms(_TASK)).alias("score")).where("score > 0")
    return ranked(f, [F.desc("score"), F.asc("path")], 25)


_SEEDS = ["src/none.py", "tests/unit/none.go"]


def _bonus(seed):
    """What a seed lends a path."""
    d, stem = seed.rsplit("/", 1)[0], seed.rsplit("/", 1)[1].rsplit(".", 1)[0]
    same, near = f"regexp_replace(path, '/?[^/]*$', '') = '{d}'", f"starts_with(path, '{d.split('/')[0]}/')"
    test = r"regexp_matches(lower(path), '(^|/)tests?/|[._-](test|spec)\.')"
    base = "regexp_extract(path, '[^/]*$')"
    return f"""CASE WHEN path = '{seed}' THEN 0.0 WHEN {same} AND lower({base}) = 'cmakelists.txt' THEN 20.0 WHEN {same} AND regexp_replace({base}, '\\.[^.]*$', '') = '{stem}' THEN 12.0
  WHEN lower(path) IN ('package.json', 'tsconfig.json', 'pyproject.toml') THEN 11.0 WHEN {same} AND {test} THEN 10.0 WHEN {near} AND {test} THEN 9.0 WHEN {near} THEN 8.0 ELSE 0.0 END"""


@query(f"""WITH {FILES_SQL}, s AS (SELECT path, greatest(0.0, {' + '.join(_term(w) for w in PL.task_terms(_TASK))} + CASE WHEN regexp_matches(lower(path), '^(src|lib|app|cmd|internal|include|tests?|packages)/') THEN 2.0 ELSE 0.0 END
  + CASE WHEN path LIKE '%.py' THEN 2.0 ELSE 0.0 END - ({_points(PL.NOISE)}))::DOUBLE + greatest({", ".join(map(_bonus, _SEEDS))})::DOUBLE AS score FROM files)
SELECT path, score, row_number() OVER (ORDER BY score DESC, path) AS rank FROM s WHERE score > 0 QUALIFY rank <= 200""")
def related_files_seeded(spark, sf_dir):
    """Files for a task that names two files: their neighbours score more."""
    return PL.related_files(files(spark, sf_dir), _TASK, _SEEDS, 200)


_R = ", ".join(f"({i}, '{n}', '{c}', (SELECT coalesce(bool_or(regexp_matches(lower(path), '{m}')), false) FROM files), (SELECT coalesce(bool_or(regexp_matches(lower(path), '{s}')), false) FROM files))" for i, (n, m, s, c) in enumerate(PL.RULES))


@query(f"""WITH {FILES_SQL}, r AS (SELECT * FROM (VALUES {_R}) v(ord, family, command, m, s)) SELECT ord, family, command, 'planned' AS status FROM r WHERE m AND s""")
def verification_plan(spark, sf_dir):
    f = files(spark, sf_dir).select("path", "file_id")
    return PL.verification_plan(f, f)


@query(f"""WITH {FILES_SQL}, s AS (SELECT path, ({_points(PL.CURRENT_DOCS)} + CASE WHEN contains(lower(path), 'design') THEN 8.0 ELSE 0.0 END + CASE WHEN contains(lower(path), 'docs') THEN 8.0 ELSE 0.0 END)::DOUBLE AS score, file_id FROM files),
b AS (SELECT path, score, CASE file_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 3 WHEN 2 THEN 2 ELSE 1 END AS bucket FROM s WHERE score > 0 ORDER BY score DESC, path LIMIT 60)
SELECT path, score, bucket, row_number() OVER (ORDER BY bucket, score DESC, path) AS rank FROM b QUALIFY rank <= 15""")
def current_docs(spark, sf_dir):
    i = F.col("file_id") % 4
    d = files(spark, sf_dir).select("path", F.when(i == 0, "canonical").when(i == 1, "non_authoritative").otherwise("supporting").alias("authority"), F.when(i == 0, "current").when(i == 2, "unknown").otherwise("stale").alias("currency"))
    return PL.current_docs(d, "the design docs", k=15)


@query("""WITH d AS (SELECT event_type, CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'warning' ELSE 'info' END AS severity FROM events) SELECT severity, count(*) AS n, 'error' AS worst FROM d GROUP BY severity""")
def diagnostics_rollup(spark, sf_dir):
    k = F.col("event_type")
    return PL.diagnostics(t(spark, sf_dir, "events").select(F.when(k == "error", "error").when(k == "signup", "warning").otherwise("info").alias("severity")))


@query(f"""WITH {FILES_SQL}, c AS (SELECT path, 'staged' AS s FROM files WHERE lang = 'de' UNION SELECT path, 'unstaged' FROM files WHERE size_bytes > 2000 UNION SELECT path, 'caller' FROM files WHERE path LIKE '%.md')
SELECT path, list_sort(list(s)) AS sources FROM c GROUP BY path ORDER BY path LIMIT 50""")
def changed_files(spark, sf_dir):
    f = files(spark, sf_dir)
    return PL.changed_files({"staged": f.where("lang = 'de'"), "unstaged": f.where("size_bytes > 2000"), "caller": f.where(F.col("path").endswith(".md"))})


@query(f"""WITH {FILES_SQL}, e AS (SELECT count(*) AS seen, count(*) FILTER (WHERE path LIKE '%.py' OR path LIKE '%.go' OR path LIKE '%.md') AS el, count(*) FILTER (WHERE (path LIKE '%.py' OR path LIKE '%.go' OR path LIKE '%.md') AND NOT starts_with(path, 'vendor/')) AS ad,
  count(*) FILTER (WHERE (path LIKE '%.py' OR path LIKE '%.go' OR path LIKE '%.md') AND NOT starts_with(path, 'vendor/') AND size_bytes < 5000) AS ex FROM files)
SELECT 'graph' AS evidence_class, CASE WHEN ex < ad THEN 'partial' ELSE 'complete' END AS state, el AS eligible_files_seen, ad AS admitted_files, ex AS extracted_files, seen - el AS policy_excluded_files, false AS scan_truncated, CASE WHEN ex < ad THEN 'extraction_incomplete' END AS reason FROM e""")
def coverage_receipt(spark, sf_dir):
    from lodestack.sources.files import coverage

    p = F.col("path")
    return coverage(files(spark, sf_dir), "graph", p.rlike(r"\.(py|go|md)$"), ~p.startswith("vendor/"), F.col("size_bytes") < 5000, False)


@query(f"""WITH {FILES_SQL}, u AS (SELECT DISTINCT CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '.' END AS root, 'dotnet' AS ecosystem FROM files WHERE path LIKE '%.csproj')
SELECT root, ecosystem, 0::BIGINT AS selected FROM u""")
def project_units(spark, sf_dir):
    return PL.project_units(files(spark, sf_dir).select("path"))


@query("""WITH s AS (SELECT DISTINCT p_brand AS b FROM part), t AS (SELECT DISTINCT s_nationkey AS n FROM supplier), src AS (SELECT 'src/m' || (row_number() OVER (ORDER BY b) % 7) || '/' || lower(replace(b, '#', '')) || '.py' AS path FROM s),
x AS (SELECT path, regexp_extract(path, '([^/]*)\\.py$', 1) AS stem FROM src) SELECT path AS source, 'tests/test_' || stem || '.py' AS test, 1 AS affinity, 3::BIGINT AS distance FROM x""")
def nearest_tests(spark, sf_dir):
    from pyspark.sql.window import Window

    b = t(spark, sf_dir, "part").select(F.col("p_brand").alias("b")).distinct()
    src = b.select(F.concat(F.lit("src/m"), (F.row_number().over(Window.orderBy("b")) % 7).cast("string"), F.lit("/"), F.lower(F.replace("b", F.lit("#"), F.lit(""))), F.lit(".py")).alias("path"))
    tests = b.select(F.concat(F.lit("tests/test_"), F.lower(F.replace("b", F.lit("#"), F.lit(""))), F.lit(".py")).alias("path"))
    return PL.nearest_tests(src, tests)


@query("""WITH r AS (SELECT DISTINCT 'pkg' || n_regionkey AS root FROM nation UNION ALL SELECT DISTINCT 'pkg' || n_regionkey || '/sub' || (n_nationkey % 3) FROM nation), f AS (SELECT 'pkg' || (c_nationkey % 7) || '/sub' || (c_custkey % 4) || '/f' || c_custkey || '.js' AS path FROM customer)
SELECT path, CASE WHEN regexp_extract(path, '^([^/]*/[^/]*)/', 1) IN (SELECT root FROM r) THEN regexp_extract(path, '^([^/]*/[^/]*)/', 1) WHEN regexp_extract(path, '^([^/]*)/', 1) IN (SELECT root FROM r) THEN regexp_extract(path, '^([^/]*)/', 1) END AS root FROM f""")
def nearest_packages(spark, sf_dir):
    """The nearest package manifest above each file."""
    text = lambda c: c.cast("string")
    n, c = t(spark, sf_dir, "nation"), t(spark, sf_dir, "customer")
    at = F.concat(F.lit("pkg"), text(F.col("n_regionkey")))
    packages = n.select(F.concat(at, F.lit("/package.json")).alias("path")).union(n.select(F.concat(at, F.lit("/sub"), text(F.col("n_nationkey") % 3), F.lit("/package.json"))))
    files_ = c.select(F.concat(F.lit("pkg"), text(F.col("c_nationkey") % 7), F.lit("/sub"), text(F.col("c_custkey") % 4), F.lit("/f"), text(F.col("c_custkey")), F.lit(".js")).alias("path"))
    return PL.nearest_packages(files_, packages)


@query(f"""WITH {FILES_SQL} SELECT path, 'json_syntax' AS provider, 'error' AS severity, 'not one JSON value' AS message FROM files WHERE path LIKE '%.json' AND NOT starts_with(path, 'vendor/') AND NOT json_valid(text)
UNION ALL SELECT path, 'path_policy', 'info', 'left out: vendor' FROM files WHERE starts_with(path, 'vendor/')""")
def diagnostics_by_provider(spark, sf_dir):
    p = F.col("path")
    return PL.diagnose(files(spark, sf_dir).select("path", "text"), F.when(p.startswith("vendor/"), "vendor").otherwise("source"))
