"""The identifier index against a scan of texts, and bounded pages that join to the whole."""

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestack.operators import graph as G
from lodestack.operators import identifiers as ID


def corpus():
    r = random.Random(3)
    words = ["run", "runs", "go", "x_1", "é", "Tool", "a.b", "-", "日本run"]
    files = [(f"f{k:03d}.py", "".join(r.choice(words) + r.choice([" ", "  ", "\n", "\r\n", "(", ") "]) for _ in range(r.randrange(30)))) for k in range(60)]
    return [*files, ("g_empty", ""), ("g_null", None), ("h_big", "run " * 400), (None, "run")]


def places(text):
    return {(m[0], n, m.start()) for n, line in enumerate(re.split("\r?\n", text or ""), 1) for m in re.finditer("[A-Za-z0-9_]+", line)}


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    return ID.IdentifierIndex.build(spark.createDataFrame(corpus(), "path string, text string").repartition(4), f"file://{tmp_path_factory.mktemp('ids')}", file_bytes=1000)


NAMES = ["run", "go", "x_1", "absent", "b"]


def test_places(spark, index):
    got = {(r["name"], r["path"], x["line"], x["col"]) for r in index.places(spark.createDataFrame([(n,) for n in NAMES], "name string")).collect() for x in r["places"]}
    want = {(w, p, n, c) for p, t in corpus() if p for w, n, c in places(t) if w in NAMES}
    assert got == want and len(want) > 50
    docs = spark.createDataFrame(corpus(), "path string, text string").where("path IS NOT NULL")
    scan = {("run", r["path"], r["line"], r["col"]) for r in G.lexical_references(docs, "path", "text", "run").collect()}
    assert scan == {w for w in want if w[0] == "run"}


def brute_page(name, at, seen, results, most_files, most_bytes, cap=1000):
    """A loop over the files, as a single scan would go."""
    files = sorted((p, t or "") for p, t in corpus() if p)
    hits, n, size, oversized, stop, last = [], 0, 0, 0, "catalog_exhausted", at
    for p, t in files:
        if at is not None and (p < at or p == at and not seen):
            continue
        b = len(t.encode())
        if b > cap:
            oversized += p != at
            continue
        if n >= most_files or size + b > most_bytes:
            stop = "file" if n >= most_files else "byte"
            oversized -= sum(1 for q, u in files if len(u.encode()) > cap and (last or "") < q < p)
            break
        n, size, last = n + 1, size + b, p
        own = sorted((line, c) for w, line, c in places(t) if w == name)
        hits += [(name, k, p, *x) for k, x in enumerate(own, 1) if p != at or k > seen]
    page = hits[:results]
    if len(page) >= results:
        return page, (name, len(page), "result", n, size, False, page[-1][2], page[-1][1])
    return page, (name, len(page), stop, n, size, stop == "catalog_exhausted" and not any(len((t or "").encode()) > cap for _, t in corpus()), None if stop == "catalog_exhausted" else last, None if stop == "catalog_exhausted" else 0)


@pytest.mark.parametrize("results,most_files,most_bytes", [(7, 10, 100_000), (1000, 9, 700), (5, 1000, 400), (1, 3, 10_000)])
def test_pages_are_those_of_a_loop_and_join_to_the_whole(spark, index, results, most_files, most_bytes):
    names = spark.createDataFrame([(n, None, None) for n in NAMES], "name string, next_path string, next_ordinal int")
    seen = {n: [] for n in NAMES}
    at = {n: (None, 0) for n in NAMES}
    for _ in range(4):
        page = index.page(names, results, most_files, most_bytes)
        hits, receipts = page.hits.orderBy("name", "path", "ordinal").collect(), page.receipts.collect()
        for r in receipts:
            own = [tuple(h) for h in hits if h["name"] == r["name"]]
            want, receipt = brute_page(r["name"], *at[r["name"]], results, most_files, most_bytes)
            assert own == want
            assert (r["name"], r["hits"], r["stop"], r["files"], r["bytes"], r["complete"], r["next_path"], r["next_ordinal"]) == receipt
            seen[r["name"]] += own
            at[r["name"]] = (r["next_path"], r["next_ordinal"])
        going = [(r["name"], r["next_path"], r["next_ordinal"]) for r in receipts if r["next_path"]]
        if not going:
            break
        names = spark.createDataFrame(going, "name string, next_path string, next_ordinal int")
    for n in NAMES:
        assert len(seen[n]) == len(set(seen[n])) and seen[n] == sorted(seen[n], key=lambda h: (h[2], h[1]))


def test_oversized_files_are_told(spark, index):
    r = index.page(spark.createDataFrame([("run",)], "name string"), 10_000, 10_000, 10_000_000).receipts.first()
    assert (r["stop"], r["oversized"], r["complete"], r["files"]) == ("catalog_exhausted", 1, False, 62)
    assert index.page(spark.createDataFrame([("run", "none", 0)], "name string, next_path string, next_ordinal int")).receipts.count() == 0
    with pytest.raises(ValueError):
        index.page(spark.createDataFrame([("run",)], "name string"), 0)


def test_running_sums(spark):
    df = spark.range(500).select(F.format_string("p%04d", (F.col("id") * 7 % 500)).alias("p"), (F.col("id") % 5).alias("v"))
    got = [(r["p"], r["s"], r["n"]) for r in ID.running(df, "p", s=F.col("v"), n=F.lit(1)).orderBy("p").collect()]
    values = dict((r["p"], r["v"]) for r in df.collect())
    total, want = 0, []
    for k, p in enumerate(sorted(values), 1):
        total += values[p]
        want.append((p, total, k))
    assert got == want


def test_index_is_made_where_files_are_read(spark, monkeypatch):
    """No occurrence goes through a shuffle, and where rows are passed on in parts nothing changes."""
    files = spark.createDataFrame(corpus(), "path string, text string").coalesce(1)
    got = ID.identifiers(files)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    want = {(r["ident"], r["path"], x["line"], x["col"]) for r in got.collect() for x in r["places"]}
    batch = pa.RecordBatch.from_pylist([{"path": p, "text": t} for p, t in corpus() if p and t is not None])
    monkeypatch.setattr(ID, "GATHERED", 3)
    parts = list(ID._placed(iter([batch])))
    assert len(parts) > 10 and {(r["ident"], r["path"], x["line"], x["col"]) for part in parts for r in part.to_pylist() for x in r["places"]} == want == {(w, p, n, c) for p, t in corpus() if p for w, n, c in places(t)}
