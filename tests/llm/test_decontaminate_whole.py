"""Operator 10 against the rule of overlaps alone, without a retrieval before it."""

import random

import numpy as np

from lodestack.llm import decontaminate as D
from lodestack.llm._tokens import shingles, words


def material():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghijkl") for _ in range(r.randint(3, 7)))
    common = [word() for _ in range(40)]
    sentence = lambda n, rare: " ".join(word() if r.random() < rare else r.choice(common) for _ in range(n)) + "."
    # questions of usual words, answers that are longer and rarer
    items = [(i, sentence(r.randint(5, 12), 0.1) + " " + sentence(r.randint(10, 45), 0.9)) for i in range(80)]
    docs = []
    for k in range(160):
        parts = [sentence(r.randint(3, 40), 0.3) for _ in range(r.randint(0, 9))]
        q, a = D.question_and_answer(items[k % 80][1])
        part = {0: q, 1: " ".join(q.split()[:-1]), 2: a, 3: " ".join((q + " " + a).split()[: r.randint(5, 40)])}[k % 4]
        parts.insert(r.randint(0, len(parts)), part)
        docs.append(" ".join(parts))
    return items, docs + ["", None]


def by_rule(items, docs):
    """Pairs whose overlaps decide, over all passages and items."""
    out = set()
    for index in D.build(items):
        for k, t in enumerate(docs):
            h = words([t or ""])[0]
            for cell in range(-1, len(h) // index.stride + 1):
                passage = h[max(0, cell) * index.stride : (cell + 2) * index.stride]
                seen = {n: np.unique(shingles(passage, n)) for n in range(1, 6)}
                for i, parts in enumerate(index.parts):
                    whole, q, a = (D.share(x, seen[n]) for x, n in zip(parts, index.sizes[i]))
                    if whole >= 0.5 or q >= 0.8 or q >= 0.3 and a >= 0.5:
                        out.add((k, index.ids[i]))
    return out


def test_question_without_its_answer():
    items, docs = material()
    want = by_rule(items, docs)
    assert {(k, k % 80) for k in range(0, 160, 4)} <= want
    for some in (D.build(items), D.build(items, 0.9)):
        rows = list(D.matches(some, [t or "" for t in docs]))
        assert {(k, i) for k, i, *_ in rows} == want and len(rows) == len(want)
    assert any(score < D.THRESHOLD for _, _, score, *_ in D.matches(D.build(items), [t or "" for t in docs]))


def test_texts_longer_than_a_span():
    items, docs = material()
    old, D.SPAN = D.SPAN, 7
    try:
        assert {(k, i) for k, i, *_ in D.matches(D.build(items), [t or "" for t in docs])} == by_rule(items, docs)
    finally:
        D.SPAN = old


def test_blocks_change_no_row(spark):
    items, docs = material()
    items = items + [(100 + k, " ".join(t for _, t in items[k : k + 4])) for k in range(0, 12, 4)]  # a second length class
    d, b = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    rows = lambda n: sorted((r["doc_id"], r["item_id"], round(r["bm25_share"], 9), r["overlap"]) for r in D.contaminated(d, b, item_block=n).collect())
    assert len(D.build(items)) == 2 and len(rows(1000)) > 80
    assert rows(1000) == rows(20)


def test_statistics_are_of_all_items():
    items, _ = material()
    alone, both = D.build(items[:40]), D.build(items[:40] + [(500, "long " * 300 + items[0][1])])
    h = words([items[0][1][:60]])[0]
    assert len(both) == 2 and alone[0].score(h, 0) != both[0].score(h, 0)


def test_items_of_few_words():
    items, docs = material()
    short = [(200, "zalo"), (201, "Zuri, zamo!"), (202, "zeta zalo zuri."), (203, "zuri zalo zamo zeta"), (204, "Zeta. Zuri zuri"), (205, "Zeko? " + items[0][1])]
    r = random.Random(9)
    some = [" ".join([*t.split()[: r.randint(0, 200)], *(r.choice(["zalo", "zuri", "zamo", "zeta", "zeko"]) for _ in range(k % 6)), *(short[k % 5][1].split() if k % 7 == 0 else []), *t.split()[5:]]) for k, t in enumerate(docs[:-1])]
    tokens = lambda t: "".join(c if c.isalnum() else " " for c in t.lower()).split()
    want = {(k, i) for k, d in enumerate(some) for i, t in short[:5] if f" {' '.join(tokens(t))} " in f" {' '.join(tokens(d))} "}
    got = {(k, i) for k, i, *_ in D.matches(D.build(items + short), some)}
    assert {i for _, i in want} == {200, 201, 202, 203, 204}
    assert {(k, i) for k, i in got if 200 <= i < 205} == want
    lone = {k for k, d in enumerate(some) if "zeko" in tokens(d)} - {k for k, i in got if i == 0}
    assert lone and not {k for k, i in got if i == 205} & lone  # its question alone tells too little
    assert [m[4] for m in D.matches(D.build([(1, "Zuri, zamo!")]), ["a b zuri zamo c d e"])] == [1.0]


def test_the_answer_decides():
    """A third of a long question counts with the answer behind it, and not without."""
    w = [f"w{k}x" for k in range(60)]
    q, a = " ".join(w[:48]) + "?", " ".join(w[48:]) + "."
    part = " ".join(w[:22])
    filler = " ".join(f"f{k}" for k in range(20))
    index = D.build([(1, f"{q} {a}")])
    held = [k for k, *_ in D.matches(index, [f"{filler} {part} {filler}", f"{filler} {part} {filler} {a}", f"{filler} {a} {filler}", f"{filler} {q}"])]
    assert held == [1, 3]
    short = D.build([(1, f"{q} blue zebra.")])
    assert [k for k, *_ in D.matches(short, [f"{part} {filler}", f"{part} {filler} blue zebra {filler}"])] == [1]
