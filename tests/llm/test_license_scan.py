"""Operator 13 against brute force: every block with every template, phrases at every word."""

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestack.llm import license_scan as L

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans(L._UPPER, L._LOWER)


def brute(i, text, templates=L.TEMPLATES, threshold=L.THRESHOLD):
    ws = WORD.findall((text or "").translate(LOWER))
    places = {p: [k for k in range(len(ws)) if ws[k : k + len(p.split())] == p.split()] for p in L.PHRASES}
    starts = sorted(k for v in places.values() for k in v)
    own = {L.PHRASES[p] for p, v in places.items() if v}
    found, score = set(), 0.0
    for lo in range(0, len(ws), L.STEP):
        block = ws[lo : lo + L.BLOCK]
        pairs = set(zip(block, block[1:]))
        for label, t in templates:
            want = set(zip(t.split(), t.split()[1:]))
            if len(want & pairs) >= threshold * len(want) - 1e-9:
                found.add(label)
                score = max(score, len(want & pairs) / len(want))
    return (i, len(ws), len(starts), starts[0] if starts else None, starts[-1] if starts else None, ",".join(sorted(own)), ",".join(sorted(own | found)), 1.0 if starts else score)


def rows():
    r = random.Random(7)
    prose = "the of and license software copy work under mit public notice files gnu terms 4 0 2 by cc version straße".split()
    noise = lambda n: [r.choice(prose) for _ in range(n)]
    out = [None, "", "...", "CC BY cc by CC-BY", "MIT License", "mit licenses", "The GNU General Public Licence", "GNU\nGeneral, Public (License)\x00Apache License", "émit license", "cc by " * 20000]
    for label, t in L.TEMPLATES:
        for drop in (0.0, 0.1, 0.3):
            ws = [w for w in t.split() if r.random() >= drop]
            for k in sorted(r.sample(range(len(ws)), r.randrange(0, 3)), reverse=True):
                ws.insert(k, "extra")
            sep = r.choice((" ", "\n# ", ", "))
            out.append(sep.join(noise(r.choice((0, 5, 47, 48, 95, 200))) + [w.upper() if drop == 0.1 else w for w in ws] + noise(r.randrange(90))))
    return [(k, t) for k, t in enumerate(out)] + [(None, "Released under the MIT License."), (3, "x"), (3, "x")]


COLUMNS = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
KEY = lambda r: (r[0] is None, r[0] or 0)


def test_against_brute_force(spark):
    data = rows()
    docs = spark.createDataFrame([(*d, "x", 1) for d in data], "doc_id long, text string, words string, score int").repartition(3)
    got = [tuple(r) for r in L.license_scan(docs).select(COLUMNS).collect()]
    want = [brute(*d) for d in data]
    assert sorted(got, key=KEY) == sorted(want, key=KEY)
    labels = {x for w in want for x in w[6].split(",")}
    assert labels >= {label for label, _ in L.TEMPLATES} and any(0 < w[7] < 1 for w in want) and sum(w[7] == 0 for w in want) > 5


@pytest.mark.parametrize("threshold", [0.4, 1.0])
def test_other_templates_and_thresholds(spark, threshold):
    r = random.Random(3)
    vocabulary = [f"w{k}" for k in range(12)]
    templates = [(f"l{k % 5}", " ".join(r.choice(vocabulary) for _ in range(r.randrange(2, 20)))) for k in range(25)]
    data = [(k, " ".join(r.choice(vocabulary) for _ in range(r.randrange(150)))) for k in range(60)] + [(100 + k, t) for k, (_, t) in enumerate(templates)]
    found = L.license_scan(spark.createDataFrame(data, "doc_id long, text string"), templates=templates, threshold=threshold)
    got = [tuple(x) for x in found.select(COLUMNS).collect()]
    assert sorted(got, key=KEY) == sorted((brute(i, t, templates, threshold) for i, t in data), key=KEY)
    blocks = found.select("doc_id", F.explode("found").alias("f")).select("doc_id", "f.*").collect()
    assert blocks and all(x["containment"] >= threshold and x["label"] == templates[x["template"]][0] for x in blocks)


def test_a_changed_word_is_another_license(spark):
    data = [(0, "Released under the BSD License."), (1, "licensed under the mozilla license version 2.0"), (2, "released under the mit license")]
    got = {r["doc_id"]: r["labels"] for r in L.license_scan(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == {0: "", 1: "", 2: "mit"}


def test_empty_table_and_bounds(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string")
    assert L.license_scan(docs.limit(0)).count() == 0
    assert {r["labels"] for r in L.license_scan(docs, templates=[]).collect()} >= {"", "mit", "cc-by"}
    for bad in ([("x", "word")], [("x", "w " * 60)]):
        with pytest.raises(ValueError):
            L.license_scan(docs, templates=bad)


def test_sql_agrees(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({L.SQL}) ORDER BY 1").fetchall()
    got = [tuple(r) for r in L.op13_license_scan(spark, sf).select(COLUMNS).orderBy("doc_id").collect()]
    assert got == want and any(r[6] for r in got)
