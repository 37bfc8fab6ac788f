"""Requested reads: containment, links, policy, stat, prefix, bytes."""

import pytest
from pyspark.sql import functions as F

from lodestack.sources import reads as RD

ROOT = "/work/repo"


def ask(spark, requests, links=None, **options):
    df = spark.createDataFrame(requests, "path string, mode string")
    ln = spark.createDataFrame(links, "path string, target string") if links else None
    return RD.resolved(df, ROOT, ln, **options)


def decisions(df):
    return {(r["path"], r["mode"]): (r["relative"], r["allowed"], r["read_only"], r["reason"]) for r in df.collect()}


def test_containment_and_policy(spark):
    got = decisions(ask(spark, [("src/a.py", "text"), ("/work/repo/src/../src/./a.py", "write"), ("../repo/src/a.py", "text"), ("/work/repository/a", "text"), ("/etc/passwd", "stat"), ("src/../../x", "text"), ("", "text"), (None, "text"), ("/work/repo", "stat"), ("node_modules/x.js", "text"), ("node_modules/x.js", "write"), (".env", "write"), ("new/file.py", "write")]))
    out = (None, False, None, "path_refused")
    assert got[("src/a.py", "text")] == ("src/a.py", True, False, None) == got[("/work/repo/src/../src/./a.py", "write")]
    assert all(got[k] == out for k in [("../repo/src/a.py", "text"), ("/work/repository/a", "text"), ("/etc/passwd", "stat"), ("src/../../x", "text"), ("", "text"), (None, "text")])
    assert got[("/work/repo", "stat")][:2] == ("", True) and got[("new/file.py", "write")][1]
    assert got[("node_modules/x.js", "text")] == ("node_modules/x.js", True, True, None) and got[("node_modules/x.js", "write")] == ("node_modules/x.js", False, True, "write_refused")
    free = decisions(ask(spark, [("node_modules/x.js", "write"), (".env", "write")], allow_generated=True))
    assert free[("node_modules/x.js", "write")][1] and not free[(".env", "write")][1] and not got[(".env", "write")][1]


def test_links(spark):
    links = [("in", "src"), ("src/up", "../lib"), ("away", "/etc"), ("home", "/work/repo/lib"), ("deep", "in/up"), ("loop", "pool"), ("pool", "loop"), ("out", "../other")]
    got = decisions(ask(spark, [(p, "text") for p in ("in/a.py", "src/up/b.py", "away/passwd", "home/c.py", "deep/d.py", "loop", "loop/x", "out/x", "plain/in")], links))
    where = {p: r[0] for (p, _), r in got.items()}
    assert where == {"in/a.py": "src/a.py", "src/up/b.py": "lib/b.py", "away/passwd": None, "home/c.py": "lib/c.py", "deep/d.py": "lib/d.py", "loop": None, "loop/x": None, "out/x": None, "plain/in": "plain/in"}


def test_answers(spark):
    text = "ab€cd"
    tree = spark.createDataFrame([("a.txt", 7, 5, bytearray(text.encode())), ("b.bin", 2, 6, bytearray(b"\xff\x00"))], "path string, size_bytes long, mtime_ms long, content binary")
    asks = [("a.txt", "text"), ("a.txt", "prefix"), ("a.txt", "binary"), ("a.txt", "stat"), ("b.bin", "text"), ("b.bin", "binary"), ("none", "text"), ("../x", "binary"), ("a.txt", "stat")]
    rows = RD.answers(ask(spark, asks), tree, 4).collect()
    got = {(r["path"], r["mode"]): (r["exists"], r["size_bytes"], r["mtime_ms"], r["text"], None if r["content"] is None else bytes(r["content"])) for r in rows}
    assert len(rows) == len(asks)
    assert got == {
        ("a.txt", "text"): (True, 7, 5, text, None), ("a.txt", "prefix"): (True, 7, 5, "ab", None), ("a.txt", "binary"): (True, 7, 5, None, text.encode()), ("a.txt", "stat"): (True, 7, 5, None, None),
        ("b.bin", "text"): (True, 2, 6, None, None), ("b.bin", "binary"): (True, 2, 6, None, b"\xff\x00"), ("none", "text"): (False, 0, 0, None, None), ("../x", "binary"): (None, None, None, None, None),
    }
    with pytest.raises(ValueError):
        RD.answers(ask(spark, asks), tree, 0)
    assert RD.answers(ask(spark, asks).where(F.lit(False)), tree).count() == 0
