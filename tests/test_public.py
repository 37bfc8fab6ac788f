"""Public shapes: other fields go, texts are redacted before they are cut."""

from lodestack.plans import public as PB


def test_documents(spark):
    rows = [("a.md", "Title " + "é" * 100, ["h1", "password: hunter22 x", "h3"], ["l1", "l2"], "draft", "private body"), ("b.md", None, None, None, None, "x"), ("c.md", "t", [], [], "current", "y")]
    df = spark.createDataFrame(rows, "path string, title string, headings array<string>, links array<string>, doc_status string, content string")
    out = PB.public_documents(df, max_headings=2, field_bytes=21)
    assert "content" not in out.columns and "links" not in out.columns
    got = {r["path"]: r.asDict() for r in out.collect()}
    a = got["a.md"]
    assert a["title"] == "Title " + "é" * 7 and a["title_truncated"] and a["headings"] == ["h1", "password: [redacted] "] and (a["total_heading_count"], a["headings_truncated"], a["total_link_count"]) == (3, True, 2)
    assert got["b.md"]["title"] is None and not got["b.md"]["title_truncated"] and got["b.md"]["total_heading_count"] == 0 and got["c.md"]["headings"] == []


def test_symbols_and_sections(spark):
    key = "AKIA" + "Q" * 16
    nodes = spark.createDataFrame([("n", "f", f"def f(k='{key}')", "/home/me/x " * 3, "secret row", 3)], "node_id string, name string, signature string, docstring string, metadata string, start_line int")
    r = PB.public_symbols(nodes, 24).first()
    assert r["signature"] == "def f(k='[redacted]')" and not r["signature_truncated"] and r["docstring"] == "[path] [path] [path] " and r["language"] is None and r["start_line"] == 3
    assert "metadata" not in PB.public_symbols(nodes).columns
    s = PB.public_sections(spark.createDataFrame([("p", 1, 9, f"x {key} tail"), ("q", 1, 1, None)], "path string, start_line int, end_line int, text string"), 6).collect()
    assert [(x["text"], x["byte_count"], x["truncated"]) for x in s] == [("x [red", 17, True), (None, None, False)]
