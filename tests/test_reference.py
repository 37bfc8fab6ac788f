"""Operators on hand-made rows: functions, relations, search, graph, documents, snapshots, changes, planning, cursors."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lodestack import schemas
from lodestack.functions import authority as A
from lodestack.functions import paths as P
from lodestack.functions import text as T
from lodestack.operators import docs as D
from lodestack.operators import graph as G
from lodestack.operators import relational as R
from lodestack.operators import search as S
from lodestack.operators import snapshots as SN
from lodestack.plans import api
from lodestack.plans import planning as PL
from lodestack.streaming import changes as C


def one(spark, **cols):
    return spark.range(1).select(*(c.alias(k) for k, c in cols.items())).first()


def test_text(spark):
    assert T.symbol_terms("Get-User_Name v2 " + "x " * 20)[:3] == ["get", "user_name", "v2"] and len(T.symbol_terms("x " * 20)) == 12
    assert T.docs_terms("a How-to docs/design") == ["how-to", "docs/design"]
    v = "héé😀x"
    cols = {f"c{n}": T.utf8_prefix(F.lit(v), n) for n in range(1, 12)}
    r = one(spark, **cols)
    for n in range(1, 12):
        want = v.encode()[:n].decode(errors="ignore")
        assert r[f"c{n}"] == want, n
    r = one(spark, n=T.normalised(T.nfkc(F.lit("Ｆｕｌｌ_Width—text!"))), k=T.concern_key(F.lit("Api  Design / v2")), s=T.singular(F.lit("categories")), p=T.plural(F.lit("box")), c=T.pascal(F.lit("user_note")), b=T.base64url(F.lit("a?>~")), red=T.redacted(F.lit('password: "x1y2" in /home/joe/f')))
    assert (r["n"], r["k"], r["s"], r["p"], r["c"]) == ("full width text", "api-design-v2", "category", "boxes", "UserNote") and r["red"] == "password: [redacted] in [path]" and "=" not in r["b"]
    h = one(spark, h=T.heading_lines(F.lit("# A\n```\n# no\n```\n## B ##\ntext")))["h"]
    assert [(x["line"], x["depth"], x["text"]) for x in h] == [(1, 1, "A"), (5, 2, "B")]
    j = spark.createDataFrame([("{}",), ('"k": 1}',), ("1],[2",), ("",), (None,), ("[1, 2]",)], "t string").select(T.is_json(F.col("t")).alias("j"))
    assert [x["j"] for x in j.collect()] == [True, False, False, False, False, True]


def test_paths(spark):
    rows = {"a/./b/../c": "a/c", "../x": None, "/abs": None, "a//b": "a/b", "..": None, "a/..": ""}
    d = spark.createDataFrame([(k,) for k in rows], "p string").select("p", P.canonical(F.col("p")).alias("c"))
    assert {r["p"]: r["c"] for r in d.collect()} == rows
    d = spark.createDataFrame([("a/b", "a/b"), ("a/b/c", "a/d"), ("x", "y"), ("a", "a/b/c")], "a string, b string").select(P.distance(F.col("a"), F.col("b")).alias("d"))
    assert [r["d"] for r in d.collect()] == [0, 3, 2, 2]
    rules = P.ignore_rules("*.log\n!keep.log\n/build/\nsrc/gen\nlit%_x\n#c\n")
    want = {"a.log": True, "x/keep.log": False, "build/o": True, "a/build/o": False, "src/gen/a": True, "lit%_x": True, "litabx": False, "src/genx": False}
    d = spark.createDataFrame([(k,) for k in want], "p string").select("p", P.ignored_by(F.col("p"), rules).alias("i"))
    assert {r["p"]: r["i"] for r in d.collect()} == want
    want = {".env": "secret", ".env.example": "source", "x/.env.local": "secret", "id.pem": "secret", "config/credentials/a.yml": "secret", "a/node_modules/b.js": "vendor", "dist/x": "generated", ".github/w.yml": "source", ".secretdir/x": "hidden", "a~": "generated", "src/a.py": "source", "lib/.x-tests/a": "generated"}
    d = spark.createDataFrame([(k,) for k in want], "p string").select("p", P.policy(F.col("p"))["category"].alias("c"))
    assert {r["p"]: r["c"] for r in d.collect()} == want


def test_authority(spark):
    text = '---\nstatus: "Accepted"\nsuperseded_by: b.md\nother: 1\n---\nbody'
    m = one(spark, m=A.front_matter(F.lit(text)), n=A.front_matter(F.lit("---\nstatus: x\nno end")))
    assert m["m"] == {"status": "Accepted", "superseded_by": "b.md"} and not m["n"]
    none = F.lit(None).cast("string")
    state = lambda p, title=none, body=none, declared=none: A.status(F.lit(p), title, body, declared)
    r = one(spark, a=state("docs/archive/x.md"), b=state("notes.md", body=F.lit("old-legacy-thing")), c=state("x.md", title=F.lit("My template")), d=state("README.md"), e=state("x.md", body=F.lit("Status: draft now")), f=state("docs/archive/x.md", declared=F.lit("published")))
    assert tuple(r) == ("archived", "legacy", "template", "current", "draft", "current")
    cur = lambda *a: A.currency(*(F.lit(x) if x is not None else none for x in a), "2024-01-01")
    r = one(spark, a=cur("x", "current", None, "y", "2000-01-01", None), b=cur("x", "unknown", None, None, None, "x"), c=cur("x", "draft", "o.md", None, "2000-01-01", None), d=cur("x", "current", None, None, "bad", None))
    assert [(x["state"], x["priority"]) for x in r] == [("superseded", -12), ("current", 4), ("stale", -3), ("current", 6)]


def test_paging_concatenates(spark):
    r = random.Random(3)
    rows = [(i, r.randrange(9)) for i in range(57)]
    r.shuffle(rows)
    d = spark.createDataFrame(rows, "id long, v int").repartition(5)
    order = [F.desc("v"), F.asc("id")]
    got, start = [], 0
    while True:
        page = R.offset_page(d, order, start, 10).orderBy("rank").collect()
        got += [(x["id"], x["v"]) for x in page]
        if not page[-1]["more"]:
            break
        start += 10
    assert got == sorted(rows, key=lambda x: (-x[1], x[0]))
    keys, after = [], None
    while page := R.after_key(d, "id", after, 7).collect():
        keys += [x["id"] for x in page]
        after = keys[-1]
    assert keys == list(range(57))


@pytest.mark.parametrize("n,over", [(0, False), (4, False), (5, False), (6, True)])
def test_cap(spark, n, over):
    rows = R.within_cap(spark.range(n), [F.col("id")], 5).collect()
    if over:
        assert len(rows) == 1 and rows[0]["id"] is None and rows[0]["overflow"] and rows[0]["seen"] == 6
    else:
        assert [x["id"] for x in rows if x["id"] is not None] == list(range(n)) and not rows[0]["overflow"]


def test_relations(spark):
    e = spark.createDataFrame([(3, "a", "b", None), (1, "a", "b", None), (2, "a", "b", 4), (9, "a", None, 4)], "id long, s string, t string, l int")
    assert {(r["id"], r["l"]) for r in R.distinct_edges(e, ["s", "t"], ["l"], "id").collect()} == {(1, None), (2, 4), (9, 4)}
    u = spark.createDataFrame([("root", "."), ("b", "a"), ("a", "a"), ("ab", "a/b")], "k string, p string")
    f = spark.createDataFrame([("a/b/c",), ("a/bc",), ("x",), ("a",)], "path string")
    assert {r["path"]: r["unit"] for r in R.longest_prefix(f, "path", u, "p", "k").collect()} == {"a/b/c": "ab", "a/bc": "a", "x": "root", "a": "a"}
    b = R.budgeted(spark.createDataFrame([(c, 10) for c in "abcdef"], "p string, n long"), "p", "n", 4, 35).collect()
    assert [(r["p"], r["stop"]) for r in b] == [("a", "bytes"), ("b", "bytes"), ("c", "bytes")]
    assert R.budgeted(spark.createDataFrame([("a", 1)], "p string, n long"), "p", "n", 4, 35).first()["stop"] == "exhausted"
    z = R.zero_filled(spark.createDataFrame([("a",), ("a",)], "k string"), "k", ["a", "b"])
    assert {r["k"]: r["n"] for r in z.collect()} == {"a": 2, "b": 0}
    bad = schemas.violations(spark.createDataFrame([("fresh", 0.5, 1), ("odd", 0.5, 2), ("cold", 2.0, 3), ("cold", 0.1, 3)], "f string, c double, i int"), {"f": "freshness"}, ["i"], ["c"])
    assert sorted(r["violation"] for r in bad.collect()) == ["c outside 0..1", "f not in freshness", "repeated i", "repeated i"]


def test_search(spark, tmp_path):
    d = spark.createDataFrame([(1, "alpha beta"), (2, "alpha alpha gamma"), (3, "delta"), (4, None)], "id long, text string")
    hits = S.bm25(d, {"text": 1.0}, ["alpha", "beta"]).orderBy(F.desc("score")).collect()
    assert [h["id"] for h in hits] == [1, 2]
    band = S.relevance_band("data model", F.col("t"), F.col("h"), F.col("b"), F.col("f"), F.col("o"))
    rows = [("The data model", [], "", True, False, 0), ("model of data", [], "", True, False, 1), ("x", ["data"], "model", True, False, 4), ("x", [], "the model, data", True, False, 2), ("data model", [], "", False, True, 3)]
    got = spark.createDataFrame(rows, "t string, h array<string>, b string, f boolean, o boolean, want int").withColumn("got", band).collect()
    assert all(r["got"] == r["want"] for r in got), got
    u = S.Universes(spark, f"file://{tmp_path}/u")
    u.put("q1", R.ranked(spark.range(7), [F.col("id")], 10), "2030-01-01T00:00:00Z")
    assert [r["id"] for r in u.page("q1", 3, 2, "2029-01-01").collect()] == [3, 4]
    with pytest.raises(IndexError):
        u.page("q1", 8, 2, "2029-01-01")
    with pytest.raises(KeyError):
        u.page("q1", 0, 2, "2031-01-01")
    with pytest.raises(KeyError):
        u.page("q1", 0, 2, "2029-01-01")


def test_graph(spark):
    e = spark.createDataFrame([(1, "a", "b"), (2, "a", "c"), (3, "b", "a"), (4, "c", "d"), (5, "d", "e"), (6, "z", "a"), (7, "a", "a"), (8, "b", None)], "edge_id long, source string, target string")
    n = spark.createDataFrame([(x,) for x in "abcdez"], "node string")
    start = spark.createDataFrame([("a",), ("gone",)], "node string")
    walk = lambda **k: [(r["node"], r["depth"]) for r in G.traverse(n, e, start, **k).orderBy("rank").collect()]
    assert walk(max_depth=2) == [("a", 0), ("b", 1), ("c", 1), ("d", 2)]
    assert walk(max_depth=9, max_nodes=3) == [("a", 0), ("b", 1), ("c", 1)]
    assert walk(max_depth=1, direction="incoming") == [("a", 0), ("b", 1), ("z", 1)] and walk(max_depth=1, direction="incoming", mode="strict") == [("a", 0)]
    assert walk(max_depth=1, direction="both") == [("a", 0), ("b", 1), ("c", 1), ("z", 1)]
    assert G.traverse(n, e, start, max_depth=9, max_nodes=3).first()["truncated"]
    nodes = spark.createDataFrame([("1", "Run", "m.Run", "function", "go", "svc/a.go"), ("2", "run", "m.T.run", "method", "go", "svc/a.go"), ("3", "Open", None, "function", "go", "store/s.go"), ("4", "open", None, "function", "go", "other/o.go"), ("5", "Post", "Blog.Post", "class", "ruby", "p.rb"), ("6", "h", None, "module", "python", "src/app.py")], "node_id string, name string, qualified_name string, kind string, language string, path string")
    cols = "ref_id string, source string, name string, kind string, language string, static boolean, receiver string, import_dir string, paths array<string>"
    refs = spark.createDataFrame([("r1", "x", "run", "go_selector", "go", True, "receiver_or_package_local", None, []), ("r2", "x", "open", "go_selector", "go", True, "import_selector", "store", []), ("r3", "x", "open", "go_identifier", "go", True, None, None, []), ("r4", "x", "none", "call", "go", True, None, None, []), ("r5", "x", "Blog::Post", "constant", "ruby", True, None, None, []), ("r6", "x", "Blog::Post", "constant", "ruby", False, None, None, []), ("r7", "x", "main", "lambda_handler_file", "yaml", True, None, None, ["src/app.py", "src/app.js"])], cols)
    got = {r["ref_id"]: (r["target"], r["resolution"], r["kind"]) for r in G.resolve_references(refs, nodes).collect()}
    assert got["r1"][:2] == ("2", "resolved") and got["r2"][:2] == ("3", "resolved") and got["r3"][:2] == (None, "ambiguous") and got["r4"][1] == "unresolved"
    assert got["r5"][:2] == ("5", "resolved") and got["r6"][1] == "unresolved" and got["r7"] == ("6", "resolved", "routes_to_handler_file")
    hits = G.lexical_references(spark.createDataFrame([("p", "run xrun\r\n run(run) é run_"), ("q", None)], "id string, text string"), "id", "text", "run").collect()
    assert sorted((r["line"], r["col"]) for r in hits) == [(1, 0), (2, 1), (2, 5)]
    s = G.search_symbols(nodes, "RUN")
    assert [(r["node_id"], r["match"]) for r in s.orderBy("rank").collect()] == [("1", 2), ("2", 2)]
    assert all(r["exact_miss"] for r in G.search_symbols(nodes, "pe").collect())


def test_documents(spark):
    md = "---\nowner: x\n---\n# A\n### B\n# C\n## D\n## D\n1. x\n3. y\n[k](ok.md) [b](bad.md) [h](http://x)\n| a | b |\n| - | - |\n| c |\n```\n# code\n```\n"
    d = spark.createDataFrame([("docs/a.md", md)], "path string, text string")
    known = spark.createDataFrame([("docs/ok.md",)], "path string")
    got = sorted((r["rule"], r["line"], r["detail"]) for r in D.markdown_quality(d, "path", "text", known).collect())
    assert got == [("broken_relative_link", 11, "bad.md"), ("duplicate_heading", 8, "D"), ("list_numbering", 10, "3"), ("required_frontmatter", 1, "status"), ("skipped_heading_level", 5, "B"), ("table_readability", 14, "column mismatch")]
    o = {r["heading_id"]: r["line"] for r in D.outline(d, "path", "text").collect()}
    assert o == {"a": 4, "b": 5, "c": 6, "d": 7, "d-2": 8}
    s = D.read_section(d, "path", "text", "a").first()
    assert (s["line"], s["until"], s["section"]) == (4, 6, "# A\n### B")


def test_snapshots(spark):
    p = SN.Publications()
    p.start(1, 1, 0)
    assert p.finish(1, 1, 0) == "published" and p.current() == 1
    p.start(2, 1, 0)
    assert p.finish(2, 1, 5) == "superseded" and p.current() == 1
    p.start(3, 1, 5)
    assert p.recover(2) == [3]
    with pytest.raises(SN.PublicationConflict):
        p.finish(3, 1, 5)
    st = spark.createDataFrame([("valid",), ("missing",)], "state string")
    assert SN.validity(st).first()["validity"] == "stale" and SN.validity(st.where("state = 'valid'")).first()["validity"] == "valid" and SN.validity(st.where("state = 'valid'"), None).first()["validity"] == "degraded"


def fold(events):
    state = {}
    for _, kind, path, at in sorted(events):
        old = state.get(path)
        if kind == "deleted" or old is None:
            state[path] = (kind, at)
        elif old[0] == "created" and kind == "modified":
            pass
        elif old[0] == "deleted" and kind == "created":
            state[path] = ("modified", at)
        else:
            state[path] = (kind, at)
    return state


def test_changes(spark, tmp_path):
    r = random.Random(8)
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, r.choice(["created", "modified", "deleted"]), f"p{r.randrange(60)}", t0 + dt.timedelta(seconds=i)) for i in range(400)]
    e = spark.createDataFrame(rows, "seq long, kind string, path string, at timestamp").repartition(4)
    assert {x["path"]: (x["kind"], x["at"]) for x in C.coalesced(e).collect()} == fold(rows)
    ids = {C.batch_identity(e.repartition(n)).first()["batch_id"] for n in (1, 3)}
    assert len(ids) == 1
    assert C.drained(e, 10).collect()[0]["status"] == "overflow" and C.drained(e, 100).count() == len(fold(rows))
    ren = spark.createDataFrame([(1, t0, "renamed", "new", "old"), (2, t0, "modified", "new", None)], "seq long, at timestamp, kind string, path string, old_path string")
    assert [(x["kind"], x["path"]) for x in C.split_renames(ren).orderBy("seq").collect()] == [("deleted", "old"), ("modified", "new"), ("modified", "new")]
    src = f"{tmp_path}/in"
    e.withColumn("old_path", F.lit(None).cast("string")).write.parquet(src)
    seen, scans = {}, []
    stream = spark.readStream.schema("seq long, kind string, path string, at timestamp, old_path string").parquet(src)
    q = C.run(stream, lambda df, i: seen.update({x["path"]: x["kind"] for x in df.collect()}), scans.append, f"{tmp_path}/cp")
    q.awaitTermination(120)
    assert seen == {k: v[0] for k, v in fold(rows).items()} and not scans
    q = C.run(stream, lambda df, i: None, scans.append, f"{tmp_path}/cp2", most=5)
    q.awaitTermination(120)
    assert scans == [0]
    s = C.quiet_periods(e.where("path = 'p1'"), ["path"], "at", "10 seconds").agg(F.sum("n")).first()[0]
    assert s == sum(x[2] == "p1" for x in rows)


def test_planning(spark):
    t = PL.trust("docs_routing", ["parser"], "semantic")
    assert "local_structure_reference" in t["safe_to_use_for"] and "closure_claim" in t["not_safe_to_use_for"]
    assert "passed_validation_claim" in PL.trust("validation_plan", status="planned")["not_safe_to_use_for"] and "resolve_blocked_environment" in PL.trust("context_routing", freshness="stale")["must_verify_by"]
    f = spark.createDataFrame([("go.mod",), ("a/x.go",), ("web/package.json",), ("web/i.ts",), ("README.md",)], "path string")
    plan = lambda sel, **k: [(r["family"], r["status"]) for r in PL.verification_plan(f, spark.createDataFrame([(s,) for s in sel], "path string"), **k).collect()]
    assert plan([]) == [("go", "planned"), ("package", "planned"), ("docs", "planned")] and plan(["a/x.go"], host_blocked=True) == [("go", "blocked")]
    u = PL.project_units(f, f.where("path like 'web/%'")).collect()
    assert [(r["root"], r["ecosystem"], r["selected"]) for r in u] == [("web", "node", 2), (".", "go", 0)]
    s = PL.package_scripts(spark.createDataFrame([("web/package.json", '{"scripts": {"test": "vitest"}}'), ("x/package.json", "{")], "path string, text string")).collect()
    assert [(r["root"], r["script"], r["command"]) for r in s] == [("web", "test", "vitest")]
    rel = PL.related_files(f, "fix web typescript", ["web/i.ts"], 2).orderBy("rank").collect()
    assert [r["path"] for r in rel][0] in ("web/package.json", "web/i.ts")


def test_api(spark):
    c = api.Cursors(b"k")
    ident = {"snapshot": 3, "query": "q"}
    cur = c.make(ident, 20)
    assert c.read(cur, ident) == 20
    for bad, who in ((cur[:-2] + "xx", ident), (cur, {"snapshot": 4, "query": "q"})):
        with pytest.raises(api.BadRequest):
            c.read(bad, who)
    with pytest.raises(api.BadRequest):
        api.Cursors(b"k", 2).read(cur, ident)
    assert api.limits("impact") == {"depth": 2, "nodes": 50}
    with pytest.raises(api.BadRequest):
        api.limits("impact", depth=6)
    env = api.page(spark.range(5).orderBy("id"), 3, "docs_routing", c, ident).to_dict()
    assert [r["id"] for r in env["data"]] == [0, 1, 2] and env["meta"]["truncated"] and c.read(env["meta"]["next_cursor"], ident) == 3


def test_plans_are_pushed_down(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").select("o_orderkey", "o_custkey")
    plan = R.after_key(d, "o_orderkey", 5, 3)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderkey), GreaterThan(o_orderkey,5)]" in plan and "o_totalprice" not in plan and "TakeOrderedAndProject" in plan
