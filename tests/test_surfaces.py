"""Hidden files, durable publication, admission, snapshot tables, search pages, references and traversal on hand-made rows."""

import random

import pytest
from pyspark.sql import functions as F

from lodestack.functions import authority as A
from lodestack.functions import text as T
from lodestack.functions.arrays import scan
from lodestack.operators import docs_map as DM
from lodestack.operators import documentation as DOC
from lodestack.operators import graph as G
from lodestack.operators import references as REF
from lodestack.operators import search as S
from lodestack.operators import snapshots as SN
from lodestack.operators import store as ST
from lodestack.plans.api import BadRequest, Cursors
from lodestack.sources import files
from lodestack.streaming import changes as C


def test_hidden_files_are_read(spark, tmp_path):
    for p in ("a.py", "pkg/__init__.py", "pkg/_x.py", ".github/workflows/w.yml", "_site/deep/b.md", ".git/config", "pkg/sub/c.py"):
        f = tmp_path / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text("text of " + p)
    got = {r["path"]: r["content"].decode() for r in files.read_tree(spark, str(tmp_path)).collect()}
    assert got == {p: "text of " + p for p in ("a.py", "pkg/__init__.py", "pkg/_x.py", ".github/workflows/w.yml", "_site/deep/b.md", "pkg/sub/c.py")}
    assert {r["path"] for r in files.read_tree(spark, f"file://{tmp_path}", hidden=False).collect()} == {"a.py", "pkg/sub/c.py"}
    page = files.scan(files.read_tree(spark, str(tmp_path)))["files"]
    assert "pkg/__init__.py" in {r["path"] for r in page.collect()}


def test_publications_survive_a_restart(spark, tmp_path):
    a = SN.Publications(spark, f"file://{tmp_path}/p")
    a.start(1, 7, 0)
    a.start(2, 7, 0)
    assert a.finish(1, 7, 0) == "published"
    b = SN.Publications(spark, f"file://{tmp_path}/p")  # another driver
    assert b.current() == 1 and b.rows[2]["state"] == "building"
    late = SN.Publications(spark, f"file://{tmp_path}/p")
    assert late.rows[2]["state"] == "building"
    assert b.finish(2, 7, 5) == "superseded"
    with pytest.raises(SN.PublicationConflict):
        late._put(2, {"state": "published"})  # it had seen the state before
    with pytest.raises(SN.PublicationConflict):
        late.start(1, 9, 0)
    a.start(3, 7, 0)
    assert b.recover(8) == [3] and a.current() == 1


def test_admission():
    a = SN.Admission()
    assert [a.ask(), a.ask(), a.ask()] == ["start", "reuse", "reuse"]
    assert a.done() and not a.done() and a.ask() == "start" and not a.done()
    with pytest.raises(RuntimeError):
        a.done()


def test_drain_status_and_hooks(spark):
    assert C.drain_status(0, 0, False) == ("idle", "fresh") and C.drain_status(3, 10, True) == ("idle", "refreshing")
    assert C.drain_status(3, 250, False) == ("drained", "stale") and C.drain_status(1001, 0, False) == ("overflow", "stale")
    s = spark.createDataFrame([(1, "write", "a", None), (2, "move", "c", "b"), (3, "edit", None, None)], "seq long, tool string, path string, old_path string").withColumn("at", F.lit("2026-01-01").cast("timestamp"))
    assert sorted((r["kind"], r["path"]) for r in C.split_renames(C.hook_signals(s)).collect()) == [("created", "a"), ("deleted", "b"), ("modified", "c")]


def test_snapshot_tables(spark, tmp_path):
    st = ST.SnapshotTables(spark, f"file://{tmp_path}/t")
    rows = lambda *xs: spark.createDataFrame(list(xs), "path string, name string")
    st.replace(1, nodes=rows(("a", "x"), ("a", "y"), ("b", "z")), coverage=spark.createDataFrame([("graph", "complete", None)], "evidence_class string, state string, reason string"))
    st.replace(2, nodes=rows(("q", "q")))
    st.replace(1, nodes=rows(("a", "x"), ("b", "z")))
    got = lambda s: sorted((r["path"], r["name"]) for r in st.read("nodes", s).collect())
    assert got(1) == [("a", "x"), ("b", "z")] and got(2) == [("q", "q")]
    st.replace_files(1, rows(("a", "-")), nodes=rows(("a", "new")))
    assert got(1) == [("a", "new"), ("b", "z")]
    st.remove_file(1, "b", "nodes")
    assert got(1) == [("a", "new")] and st.read("coverage", 1).first()["state"] == "stale"
    st.drop_snapshot(2, "nodes")
    assert got(2) == []


def test_search_pages(spark, tmp_path):
    index = DOC.docs_index(spark.createDataFrame([(f"docs/d{k}.md", f"# T{k}\nalpha word {'alpha ' * k}\nstatus: draft\n") for k in range(9)], "path string, text string"))
    u, c = S.Universes(spark, f"file://{tmp_path}/u"), Cursors(b"k")
    ask = lambda cursor=None, now="2030-01-01", q="alpha": DM.docs_search(index, q, u, c, "s", now, "2030-01-02", cursor=cursor, results=4)
    seen, cursor = [], None
    while True:
        e = ask(cursor)
        seen += [r["path"] for r in e.data]
        cursor = e.next_cursor
        if not cursor:
            break
    assert len(seen) == 9 and len(set(seen)) == 9
    first = ask()
    assert ask().data == first.data and [r["rank"] for r in ask(first.next_cursor).data] == [5, 6, 7, 8]  # another first page takes nothing from this one
    with pytest.raises(BadRequest):
        ask(first.next_cursor, q="other")
    with pytest.raises(BadRequest):
        ask(first.next_cursor, now="2031-01-01")
    ask()
    assert len(u.purge("2031-01-01")) == 3 and u.purge("2031-01-01") == []
    assert DM.docs_search(index, "alpha", u, c, "s", "2030-01-01", "2030-01-02", ready=("blocked", "refresh")).status == "blocked"
    assert DM.searchable_counts(index, "docs").first().asDict() == {"documents": 9, "in_scope": 9}


def test_map_budget(spark):
    page = spark.createDataFrame([(k, "x" * 100) for k in range(1, 9)], "rank int, title string")
    cut = DM.within_bytes(page, "rank", 400)
    assert cut.count() == 3 and cut.first()["cut"]
    assert DM.within_bytes(page, "rank", 10).count() == 1 and not DM.within_bytes(page, "rank").first()["cut"]


def test_context_for_task(spark):
    f = spark.createDataFrame([("src/core/parser.py",), ("vendor/core.py",), ("README.md",)], "path string")
    d = spark.createDataFrame([("docs/parser.md", "current", "current"), ("docs/old.md", "archived", "historical")], "path string, status string, currency string")
    n = spark.createDataFrame([("1", "parser", "src/core/parser.py", "python"), ("2", "zebra", "x.go", "go")], "node_id string, name string, path string, language string")
    got = [(r["part"], r["item"]) for r in DM.context_for_task("fix the parser", f, d, n, ["src/core/parser.py"]).orderBy("part", "rank").collect()]
    assert ("file", "src/core/parser.py") in got and ("doc", "docs/parser.md") in got and ("symbol", "parser") in got and ("symbol", "zebra") not in got


def test_status_from_the_body(spark):
    row = lambda text, declared=None: spark.range(1).select(A.status(F.lit("notes/a.md"), F.lit("t"), F.lit(text), F.lit(declared).cast("string")).alias("s")).first()["s"]
    assert row("x\nStatus: Archived\n") == "archived" and row("x\nstatus: accepted\n") == "current" and row("x\nstatus: review of it\n") == "draft"
    assert row("x\nstatus: archived\n", "current") == "current" and row("nothing") == "unknown"


def test_nfkc_and_leading_words(spark):
    rows = [("Ｆｕｌｌ－width ﬁle ½ x",), ("  --- a b!c d e",), ("one",), ("",), (None,)]
    df = spark.createDataFrame(rows, "t string")
    got = [r[0] for r in df.select(T.normalised(F.col("t"))).collect()]
    assert got == ["full width file 1 2 x", "a b c d e", "one", "", None]
    for n in (1, 2, 3):
        r = df.select(F.slice(F.split(T.normalised(F.col("t")), " "), 1, n).alias("a"), F.slice(F.split(T.normalised(T.leading_words(F.col("t"), n)), " "), 1, n).alias("b")).collect()
        assert all(x["a"] == x["b"] for x in r)


def test_scan_against_a_loop(spark):
    r = random.Random(2)
    rows = [([r.randrange(9) for _ in range(n)],) for n in (0, 1, 63, 64, 65, 129, 1000)]
    for x, y in zip(rows, spark.createDataFrame(rows, "v array<int>").select(scan(F.col("v"), lambda a, b: a + b).alias("s")).collect()):
        assert y["s"] == [sum(x[0][: k + 1]) for k in range(len(x[0]))]


def test_lexical_scan_takes_the_name_as_it_is(spark):
    df = spark.createDataFrame([("p", "a.b axb a.b\r\noperator+ x operator+"), ("q", "the " * 20_000)], "id string, text string")
    at = lambda w: sorted((r["id"], r["line"], r["col"]) for r in G.lexical_references(df, "id", "text", w, "id").collect())
    assert at("a.b") == [("p", 1, 0), ("p", 1, 8)] and at("operator+") == [("p", 2, 0), ("p", 2, 12)]
    assert at("the") == [("q", 1, 4 * k) for k in range(20_000)]


def brute_walk(nodes, edges, starts, depth, most, direction, expand):
    queue, taken, out, seen, cut = [(s, 0) for s in dict.fromkeys(starts)], [], [], set(), False
    while queue:
        n, d = queue.pop(0)
        if len(taken) >= most:
            cut = True
            break
        if n in [t for t, _ in taken] or n not in nodes:
            continue
        taken.append((n, d))
        if d >= depth:
            continue
        limit = max(1, most - len(taken))
        own = []
        if direction != "incoming":
            own += [(e, e[2], True) for e in sorted(x for x in edges if x[1] == n)[:limit]]
        if direction != "outgoing":
            own += [(e, e[1], expand) for e in sorted((x for x in edges if x[2] == n), key=lambda x: (x[1], x[0]))[:limit]]
        for e, to, go in own:
            if e[0] not in seen:
                seen.add(e[0])
                out.append(e)
            if go and to in nodes and to not in [t for t, _ in taken]:
                queue.append((to, d + 1))
    return taken, out, cut


def test_walk_against_a_queue(spark, monkeypatch):
    r = random.Random(11)
    nodes = [f"n{k}" for k in range(14)]
    edges = [(k, r.choice(nodes), r.choice([*nodes, "gone"])) for k in range(40)]
    n, e = spark.createDataFrame([(x,) for x in nodes], "node string"), spark.createDataFrame(edges, "edge_id long, source string, target string").repartition(3)
    monkeypatch.setattr(G, "LITERALS", 3)
    for depth, most, direction, expand in [(2, 50, "both", True), (3, 6, "outgoing", True), (2, 5, "both", True), (2, 9, "incoming", True), (2, 9, "incoming", False), (1, 3, "both", False), (0, 3, "both", True)]:
        t = G.walk(n, e, ["n3", "none", "n5"], depth, most, direction, "expand" if expand else "strict")
        want = brute_walk(set(nodes), edges, ["n3", "none", "n5"], depth, most, direction, expand)
        assert (t.nodes, t.edges, t.truncated) == want, (depth, most, direction)


def test_impact_guards(spark):
    n = spark.createDataFrame([("a", "f1", ["parser"]), ("b", "f2", ["parser"])], "node string, path string, evidence_kinds array<string>")
    e = spark.createDataFrame([(1, "a", "b", "parser", 0.9)], "edge_id long, source string, target string, provenance string, confidence double")
    ok = G.impact(n, e, "a").first()
    assert (ok["symbols"], ok["edges"], ok["confidence"], ok["files"]) == (2, 1, "high/graph", ["f1", "f2"])
    gone = G.impact(n, e, "a", missing=spark.createDataFrame([("f2",)], "path string")).first()
    assert gone["stale"] and gone["confidence"] == "low/empty" and gone["files"] == [] and gone["symbols"] == 0
    assert G.impact(n, e, "b", direction="outgoing").first()["confidence"] == "low/empty"
    with pytest.raises(KeyError):
        G.impact(n, e, "zz")


def test_ruby_targets_never_fall_to_lexical(spark):
    t = spark.createDataFrame([("r", "run", None, "ruby", True), ("g", "go", None, "go", True)], "node_id string, name string, qualified_name string, language string, parsed boolean")
    rng = ", ".join(f"{c} int" for c in REF.RANGE)
    e = spark.createDataFrame([], f"edge_id long, source_node_id string, target_node_id string, kind string, provenance string, metadata string, {rng}, confidence double")
    u = spark.createDataFrame([], f"ref_id long, source_node_id string, name string, kind string, path string, {rng}, resolution string")
    x = spark.createDataFrame([("r", "p", 1, 0, 1, 3), ("g", "p", 1, 0, 1, 2)], f"target string, path string, {rng}")
    assert [(r["target"], r["route"], r["confidence"], r["more"]) for r in REF.find_references(t, e, u, x).collect()] == [("g", "lexical", 0.2, False)]


def test_bm25_ways_agree(spark, tmp_path):
    r = random.Random(5)
    rows = [(k, " ".join(r.choice(["alpha", "beta", "al", "gamma_x", "Delta"]) for _ in range(r.randint(0, 12))), r.choice([None, "beta", "alpha beta"])) for k in range(60)]
    df = spark.createDataFrame(rows, "id long, body string, title string")
    index = S.TermIndex.build(df, "id", ["body", "title"], f"file://{tmp_path}/ix")
    for terms, prefix, every in ((["alpha", "beta"], False, False), (["al", "gam"], True, True), (["nothing"], False, False)):
        a = {x["id"]: round(x["score"], 9) for x in S.bm25(df, {"body": 1.0, "title": 3.0}, terms, prefix, every).collect()}
        b = {x["key"]: round(x["score"], 9) for x in index.search(terms, [1.0, 3.0], prefix, every).collect()}
        assert a == b and (terms == ["nothing"]) == (not a)
    docs = spark.createDataFrame([(1, "How-To guide"), (2, "how to"), (3, "how not to"), (4, "show to"), (5, "--")], "id long, body string")
    assert {r["id"] for r in S.bm25(docs, {"body": 1.0}, ["how-to"]).collect()} == {1, 2} and S.bm25(docs, {"body": 1.0}, ["--"]).count() == 0
    assert S.bm25(df.withColumn("score", F.lit("mine")), {"body": 1.0}, ["beta"]).columns == ["id", "body", "title", "score"]


def test_ruby_requires_mean_files(spark):
    nodes = spark.createDataFrame([("1", "tool", "lib.tool", "module", "ruby", "lib/tool.rb"), ("2", "tool", "app.tool", "module", "ruby", "app/tool.rb"), ("3", "deep", "x.deep", "module", "ruby", "lib/x/deep.rb"), ("4", "tool", "t", "function", "go", "t.go")], "node_id string, name string, qualified_name string, kind string, language string, path string")
    cols = "ref_id string, source string, name string, kind string, language string, static boolean, receiver string, import_dir string, paths array<string>, source_path string"
    r = lambda i, name, kind, at, static=True: (i, "s", name, kind, "ruby", static, None, None, [], at)
    refs = spark.createDataFrame([r("a", "x/deep", "require", "main.rb"), r("b", "tool", "require", "main.rb"), r("c", "../tool.rb", "require_relative", "lib/x/deep.rb"), r("d", "lib/tool", "require", "main.rb"), r("e", "json", "require", "main.rb"), r("f", "x/deep", "require", "main.rb", False)], cols)
    got = {x["ref_id"]: (x["target"], x["resolution"]) for x in G.resolve_references(refs, nodes).collect()}
    assert got == {"a": ("3", "resolved"), "b": (None, "ambiguous"), "c": ("1", "resolved"), "d": ("1", "resolved"), "e": (None, "unresolved"), "f": (None, "unresolved")}


def test_packages_and_providers(spark):
    from lodestack.plans import planning as PL

    pk = spark.createDataFrame([("package.json", '{"scripts": {"test": "t0", "other": "o"}}'), ("a/package.json", '{"scripts": {"test": "t1"}}'), ("b/package.json", "{")], "path string, text string")
    f = spark.createDataFrame([("a/x/y.js", None), ("z.js", "<<<<<<< ours\n"), ("c.json", "{"), ("d.json", "{}")], "path string, text string")
    assert {(r["path"], r["root"]) for r in PL.nearest_packages(f, pk).collect()} == {("a/x/y.js", "a"), ("z.js", "."), ("c.json", "."), ("d.json", ".")}
    assert {(r["root"], r["script"], r["command"]) for r in PL.scripts_for(f, pk).collect()} == {(".", "test", "t0"), ("a", "test", "t1")}
    assert [(r["path"], r["provider"]) for r in PL.diagnose(f, F.when(F.col("path") == "a/x/y.js", "vendor").otherwise("source")).collect()] == [("c.json", "json_syntax"), ("z.js", "merge_markers"), ("a/x/y.js", "path_policy")]


def test_rank_reasons(spark):
    row = spark.createDataFrame([(0, 3, 0, "canonical", "current", None, "matched_owner")], "owner_priority int, band int, owner_tier int, authority string, currency string, lexical double, candidate_source string")
    assert row.select(S.rank_reasons()).first()[0] == ["owner of a matched concern", "match: intent owner match", "owner tier: 0", "authority: canonical", "currency: current", "found by: matched owner"]


def test_offset_cursors_and_time():
    from lodestack.operators import relational as R
    from lodestack.plans import api

    c = api.offset_cursor("docs", 20)
    assert api.read_offset(c, "docs") == 20 and api.read_offset(None, "docs", True) == 0
    for bad in (c[:-3], "%%", api.offset_cursor("other", 5), api.offset_cursor("docs", -1), "bnVsbA"):
        assert api.read_offset(bad, "docs") == 0
        with pytest.raises(BadRequest):
            api.read_offset(bad, "docs", True)
    ticks = iter(range(0, 1000, 40))
    assert R.within_time(range(9), 100, lambda: next(ticks)) == ([0, 1, 2], "time")
    assert R.within_time(range(2), 100, lambda: 0) == ([0, 1], "exhausted")


def test_redaction_is_cut_after_it(spark):
    row = spark.range(1).select(T.redacted(F.lit("token = abcdefghij and é more"), 22).alias("t"), T.redacted(F.lit("/home/me/x y"), None).alias("p")).first()
    assert row["t"] == "token = [redacted] and"[:22] and row["p"] == "[path] y"


def test_edit_preview(spark):
    f = spark.createDataFrame([("a", "h1", "source"), ("b", "h2", "source"), ("v", "h3", "vendor")], "path string, content_hash string, reason string")
    e = spark.createDataFrame([("a", "h1", "n"), ("b", "hx", "n"), ("v", "h3", "n"), ("new", None, "n"), ("gone", "h", "n"), ("a", None, "n")], "path string, old_hash string, new_hash string")
    got = {(r["path"], r["state"]): r["token"] for r in ST.preview_edits(f, e, "reason").collect()}
    assert set(got) == {("a", "applies"), ("b", "drifted"), ("v", "refused"), ("new", "applies"), ("gone", "missing"), ("a", "drifted")} and got["a", "applies"] != got["new", "applies"] and got["b", "drifted"] is None


def test_git_facts(spark, tmp_path):
    import subprocess

    from lodestack.sources import git as GIT

    def run(*a):
        subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True)

    run("init", "-q")
    (tmp_path / "a é.txt").write_text("1")
    run("add", ".")
    run("commit", "-qm", "one")
    (tmp_path / "a é.txt").write_text("2")
    (tmp_path / "b.txt").write_text("x")
    run("add", ".")
    run("update-index", "--add", "--cacheinfo", "160000," + "1" * 40 + ",sub")
    run("commit", "-qm", "two")
    repo = str(tmp_path)
    assert GIT.links(spark, repo).collect()[0].asDict() == {"path": "sub", "head_oid": "1" * 40, "index_oid": "1" * 40}
    got = {r["path"]: r for r in GIT.touches(spark, repo).collect()}
    assert got["a é.txt"]["first_commit"] != got["a é.txt"]["last_commit"] and got["b.txt"]["first_commit"] == got["b.txt"]["last_commit"] == got["a é.txt"]["last_commit"]
    s = GIT.state(spark, repo).first()
    assert len(s["head"]) == 40 and s["head"] == got["b.txt"]["last_commit"]
    (tmp_path / "b.txt").write_text("y")
    assert GIT.state(spark, repo).first()["cleanliness"] == "dirty"
    none = GIT.state(spark, str(tmp_path / "nowhere")).first()
    assert (none["head"], none["cleanliness"]) == (None, "blocked") and GIT.touches(spark, str(tmp_path / "nowhere")).count() == 0


def test_ranked_hits_with_files_and_reasons(spark):
    index = DOC.docs_index(spark.createDataFrame([("docs/a.md", "# A\nalpha beta"), ("docs/b.md", "# B\nbeta")], "path string, text string"))
    f = spark.createDataFrame([("docs/a.md", 1_000)], "path string, mtime_ms long")
    got = {r["path"]: r for r in DOC.ranked_search(index, "beta", files=f, explain=True).collect()}
    assert got["docs/a.md"]["modified_at"].timestamp() == 1 and got["docs/b.md"]["modified_at"] is None and "found by: fts" in got["docs/b.md"]["reasons"]
    over = DOC.ranked_search(index, "beta", cap=1, files=f, explain=True).collect()
    assert len(over) == 1 and over[0]["overflow"] and over[0]["modified_at"] is None


def test_changed_context(spark):
    from lodestack.plans import planning as PL

    f = spark.createDataFrame([("a.json", "{"), ("pyproject.toml", ""), ("m.py", "x = 1"), ("other.json", "{")], "path string, text string")
    one = lambda *xs: spark.createDataFrame([(x,) for x in xs], "path string")
    got = [tuple(r) for r in PL.changed_context({"staged": one("a.json", "m.py"), "caller": one("m.py")}, f).orderBy("part", "ord").collect()]
    assert got == [("command", 7, None, "python -m pytest"), ("diagnostic", 1, "a.json", "error: json_syntax: not one JSON value"), ("file", 1, "a.json", "staged"), ("file", 2, "m.py", "caller,staged")]


def test_a_name_that_many_share_makes_no_product(spark):
    """1,000 references and 1,000 targets of one name: each target gets its page, and no more than pages are made."""
    refs = spark.range(1000).selectExpr("id ref_id", "concat('s', id) source_node_id", "'run' name", "'call' kind", "concat('f', id % 10) path", "cast(id as int) start_line", "0 start_column", "cast(id as int) end_line", "3 end_column", "'unresolved' resolution")
    refs = refs.unionByName(refs.withColumn("ref_id", F.col("ref_id") + 5000))  # each twice
    targets = spark.range(1000).selectExpr("concat('t', id) node_id", "'run' name", "case when id % 2 = 0 then 'run' else 'a.run' end qualified_name")
    out = REF.unresolved_references(refs, targets, 5, 2)
    rows = out.collect()
    assert len(rows) == 5000 and {(r["position"], r["ref_id"]) for r in rows} == {(3, 20), (4, 30), (5, 40), (6, 50), (7, 60)}
    plan = out._jdf.queryExecution().executedPlan()
    made = []

    def walk(node):
        if "Join" in node.nodeName():
            made.append(node.metrics().apply("numOutputRows").value())
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    out._jdf.collectToPython()
    walk(plan.executedPlan() if "AdaptiveSparkPlan" in plan.nodeName() else plan)
    assert all(n <= 15_000 for n in made)
