"""Operator 10 against scoring every item for every passage."""

import random

import numpy as np

from lodestack.llm import decontaminate as D
from lodestack.llm._tokens import shingles, words


def material():
    r = random.Random(2)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(r.randint(1, 6))) for _ in range(400)]
    common = vocabulary[:12]
    sentence = lambda n: " ".join(r.choice(common) if r.random() < 0.5 else r.choice(vocabulary) for _ in range(n)).capitalize() + r.choice(".?")
    items = [(i, sentence(r.randint(8, 20)) + " " + sentence(r.randint(3, 12))) for i in range(60)] + [(100, " ".join(sentence(30) for _ in range(5))), (101, None), (102, ""), (103, "...")]
    docs = []
    for k in range(120):
        parts = [sentence(r.randint(5, 30)) for _ in range(r.randint(0, 12))]
        if k % 4 == 0:
            parts.insert(r.randint(0, len(parts)), r.choice(items[:61])[1])
        if k % 10 == 1:  # one word changed
            w = r.choice(items[:60])[1].split()
            w[len(w) // 2] = "zzz"
            parts.append(" ".join(w))
        if k % 10 == 2:  # a short fragment only
            parts.append(" ".join(r.choice(items[:60])[1].split()[:6]))
        docs.append(" ".join(parts))
    return items, docs + ["", None]


def exhaustive(index, h):
    f, item, value = index.all
    s = np.zeros(len(index.ids))
    for t in np.unique(index.terms(h)[1]):
        s[item[f[t] : f[t + 1]]] += value[f[t] : f[t + 1]]
    return {int(i): float(s[i]) for i in np.flatnonzero(s >= index.threshold - 1e-9)}


def seen_by(passage, n):
    return np.unique(shingles(passage, n))


def brute(indexes, texts):
    out = set()
    for k, t in enumerate(texts):
        h = words([t or ""])[0]
        for index in indexes:
            for cell in range(-1, len(h) // index.stride + 1):
                p = h[max(0, cell) * index.stride : (cell + 2) * index.stride]
                if len(p):
                    for i in exhaustive(index, p):
                        whole, q, a = (D.share(x, seen_by(p, n)) for x, n in zip(index.parts[i], index.sizes[i]))
                        if whole >= 0.5 or q >= 0.8 or q >= 0.3 and a >= 0.5:
                            out.add((k, index.ids[i]))
    return out


def test_search_is_exact():
    items, docs = material()
    indexes = D.build(items)
    assert len(indexes) == 2
    n = 0
    for t in docs:
        h, cuts = words([t or ""])
        for index in indexes:
            found = {c for _, c in index.passages(h, cuts).tolist()}
            for cell in range(-1, len(h) // index.stride + 1):
                p = h[max(0, cell) * index.stride : (cell + 2) * index.stride]
                want = exhaustive(index, p) if len(p) else {}
                got = dict(index.search(p))
                assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)
                assert not want or cell in found  # what the bound dismisses holds nothing
                n += len(want)
    assert n > 50


def test_query(spark):
    items, docs = material()
    d = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(docs)], "doc_id long, text string, item_id int, overlap int")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = brute(D.build(items), docs)
    got = {(r["doc_id"], r["item_id"]) for r in D.contaminated(d, b).collect()}
    assert got == want
    assert {k for k, _ in want} >= {k for k in range(120) if k % 4 == 0 or k % 10 == 1} and not {k for k, _ in want} & {k for k in range(120) if k % 4 and k % 10 not in (1,)}
    clean = D.keep_clean(d, b)
    assert clean.columns == d.columns and sorted(r["doc_id"] for r in clean.collect()) == sorted(set(range(len(docs))) - {k for k, _ in want})
    assert D.contaminated(d, b.limit(0)).count() == 0 and D.contaminated(d.limit(0), b).count() == 0 and D.keep_clean(d, b.limit(0)).count() == len(docs)


def test_items_in_blocks(spark):
    items, docs = material()
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    planted = {(k, i) for k, t in enumerate(docs[:120]) if k % 4 == 0 for i, x in items[:61] if x in t}
    b = spark.createDataFrame(items, "item_id long, text string")
    one, many = (sorted(map(tuple, D.contaminated(d, b, item_block=n).collect()), key=str) for n in (1000, 20))
    assert one == many and planted <= {(r[0], r[2]) for r in one}
    held = {r[0] for r in one}
    for n in (1000, 20):
        assert sorted(r["doc_id"] for r in D.keep_clean(d, b, item_block=n).collect()) == sorted(set(range(len(docs))) - held)
