"""Operator 12 against brute force."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from lodestack.llm import ranked_search as R
from lodestack.llm._spark import table

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k):
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n_docs, words = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        asked, scored = Counter(terms(text)), []
        for i, c in counted:
            m, s = 75 + (25 * sum(c.values()) * n_docs) // words, 0
            for t, times in asked.items():
                if c[t]:
                    s += times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m))
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k], 1)]
    return out


def corpus():
    r = random.Random(2)
    vocabulary = ["the", "The", "a", "of", "straße", "日本", "x1", "don't", "é"] + [f"w{i}" for i in range(60)]
    docs = [(i * 3 - 20, " ".join(r.choice(vocabulary[: r.choice((9, 30, 69))]) for _ in range(r.randrange(1, 60)))) for i in range(150)]
    docs += [(None, "w1 w2 w3"), (None, None), (900, None), (901, ""), (902, "... --- !"), (903, "w1 w2 w3"), (904, "w1 w2 w3"), (904, "w1 w2 w3"), (905, "w5 " * 60000)]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randrange(1, 25)))) for i in range(25)]
    items += [(100, "w1 W1 w1 w2"), (101, None), (102, ""), (103, "absent"), (104, "the"), (105, "w1 W1 w1 w2"), (None, "w3"), (106, "é-日本!straße")]
    return docs, items


@pytest.mark.parametrize("k,block", [(20, 8192), (3, 7), (1, 1)])
def test_against_brute_force(spark, k, block):
    docs, items = corpus()
    index = R.RankedIndex.build(spark.createDataFrame([(*d, "s", 1) for d in docs], "doc_id long, text string, term string, score int").repartition(3), block_docs=block)
    found = index.search(spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, key int"), k)
    got = sorted((tuple(x) for x in found.select("item_id", "rank", "doc_id", "score").collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    assert got == sorted(brute(docs, items, k), key=lambda x: (x[0] is None, x[0] or 0, x[1]))


def test_empty_tables(spark):
    docs, items = corpus()
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert R.RankedIndex.build(frame.limit(0)).search(asked).count() == 0
    assert R.RankedIndex.build(frame.where("doc_id > 900 and doc_id < 903")).search(asked).count() == 0
    assert R.RankedIndex.build(frame).search(asked.limit(0)).count() == 0


def test_treaps():
    """Ids in search order, impacts in heap order, every posting below its root; descents find the topmost node of an interval."""
    r = random.Random(1)
    docs = [np.array(sorted(r.sample(range(200), n)), np.int32) for n in (0, 1, 50, 200)]
    impacts = [np.array([r.randrange(9) for _ in d], np.int64) for d in docs]
    t = R.Treaps(docs, impacts)

    def walk(x, lo, hi, most):
        if x < 0:
            return []
        assert lo <= t.doc[x] < hi and t.impact[x] <= most
        return walk(t.left[x], lo, t.doc[x], t.impact[x]) + [int(t.doc[x])] + walk(t.right[x], t.doc[x] + 1, hi, t.impact[x])

    for root, d in zip(t.root, docs):
        assert walk(root, 0, 200, 99) == d.tolist()
    for _ in range(200):
        lo = r.randrange(200)
        hi = r.randrange(lo, 201)
        got = t.descend(t.root, np.full(4, lo), np.full(4, hi))
        for x, d, v in zip(got, docs, impacts):
            inside = v[(d >= lo) & (d < hi)]
            assert (x < 0) == (not len(inside)) and (x < 0 or (lo <= t.doc[x] < hi and t.impact[x] == inside.max()))


def test_subtrees_are_pruned():
    """With a full set of better scores elsewhere nothing is scored; without, the traversal stops above most documents."""
    r = random.Random(6)
    n = 4000
    docs = [np.arange(n), np.array(sorted(r.sample(range(n), 40)))]
    impacts = [np.array([r.randrange(100, 110) for _ in range(n)]), np.full(40, 900)]
    t = R.Treaps(docs, impacts)
    (d, s), = R.traverse(t, n, [[(0, 1), (1, 5)]], 20, [np.full(20, 10_000)])
    assert not len(d)
    (d, s), = R.traverse(t, n, [[(0, 1), (1, 5)]], 20, [np.zeros(0, np.int64)])
    assert set(np.sort(s)[-20:]) <= set(range(4600, 4610)) and len(d) < 400


def test_sql_agrees(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    want = con.execute(f"SELECT item_id, rank, doc_id, score FROM ({R.SQL}) ORDER BY 1, 2").fetchall()
    got = R.op12_ranked_search(spark, sf).select("item_id", "rank", "doc_id", "score").orderBy("item_id", "rank").collect()
    assert [tuple(r) for r in got] == want
    docs = [tuple(r) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    items = [tuple(r) for r in table(spark, sf, "benchmark").select("item_id", "text").collect()]
    assert sorted(brute(docs, items, 20)) == want
