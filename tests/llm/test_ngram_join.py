"""Operator 4 against brute force over all pairs."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack.llm import ngram_join as N


def corpus():
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 6)))
    texts = [None, "", "...", "one", "one", "One!", "two words", "a b c d e", "a b c d e."]
    for _ in range(25):
        base = [word() for _ in range(r.choice([20, 60, 150]))]
        for _ in range(r.randint(1, 9)):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, 6])):
                w[r.randrange(len(w))] = word()
            texts.append(" ".join(w) + r.choice(["", ".", "\n"]))
    hub = [word() for _ in range(200)]  # a large group of different near copies
    for i in range(60):
        w = list(hub)
        w[r.randrange(len(w))] = word()
        w[r.randrange(len(w))] = word()
        texts.append(" ".join(w))
    texts.append(" ".join(word() for _ in range(30000)))
    return texts


def brute(texts, threshold=0.8):
    toks = [tuple(re.findall(r"\w+", (t or "").lower())) for t in texts]
    sets = {w: {w[i : i + 5] for i in range(max(1, len(w) - 4))} if w else set() for w in toks}
    links = defaultdict(set)
    keys = list(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            inter = len(sets[a] & sets[b])
            if inter and inter >= threshold * (len(sets[a]) + len(sets[b]) - inter):
                links[a].add(b)
                links[b].add(a)
    root = {}
    for k in keys:
        if k not in root:
            todo = [k]
            while todo:
                x = todo.pop()
                if x not in root:
                    root[x] = k
                    todo += links[x]
    return toks, links, root


@pytest.mark.parametrize("block", [256, 7])
def test_against_all_pairs(spark, block):
    texts = corpus()
    toks, links, root = brute(texts)
    docs = spark.createDataFrame([(i, t, "x", 5) for i, t in enumerate(texts)], "doc_id long, text string, cls string, root int").repartition(5)
    got = {r["doc_id"]: r for r in N.jaccard_join(docs, recall=0.99999, most_hashes=400, block=block).collect()}
    assert len(got) == len(texts)
    first = {}
    for i, w in enumerate(toks):
        first.setdefault(root[w], i)
    for i, w in enumerate(toks):
        assert got[i]["n_links"] == len(links[w]), i
        assert got[i]["class_id"] == first[root[w]], i
        assert got[i]["copies"] == toks.count(w)
        assert got[i]["kept"] == (first[root[w]] == i)
    kept = N.keep_one_of_each(docs, recall=0.99999, most_hashes=400, block=block)
    assert kept.columns == docs.columns
    assert sorted(r[0] for r in kept.collect()) == sorted(first.values())


def test_recall_of_the_shipped_bands(spark):
    """Pairs from 0.8 upward, at the shipped parameters, against all pairs."""
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 6)))
    texts = []
    for _ in range(260):  # pairs that lie between 0.8 and 0.85 for the most part
        n = r.choice([100, 200])
        base = [word() for _ in range(n)]
        w = list(base)
        for at in r.sample(range(0, n, 8), n // 50):
            w[at] = word()
        texts += [" ".join(base), " ".join(w)]
    toks, links, _ = brute(texts)
    near = []
    for a in links:
        for b in links[a]:
            x, y = ({w[i : i + 5] for i in range(len(w) - 4)} for w in (a, b))
            near.append(len(x & y) / len(x | y))
    assert sum(0.8 <= j < 0.85 for j in near) >= 200
    got = {row["doc_id"]: row["n_links"] for row in N.jaccard_join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    want = sum(len(links[w]) for w in toks)
    assert sum(got.values()) <= want and sum(got.values()) / want >= 0.99


def test_chain_of_weak_copies(spark):
    """Each text shares half of its shingles with the next: none is a link, and no task gathers the chain."""
    r = random.Random(7)
    words = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(4000)]
    texts = [" ".join(words[k * 20 : k * 20 + 60]) for k in range(150)] + [" ".join(words[:60]) + " end"]
    got = {row["doc_id"]: row for row in N.jaccard_join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), block=4).collect()}
    assert [got[k]["n_links"] for k in range(151)] == [1] + [0] * 149 + [1] and got[150]["class_id"] == 0


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", 0, 0), (2, "a b c d e f.", 0, 0)], "doc_id long, text string, _gone_id int, text_hash int")
    kept = N.keep_one_of_each(docs)
    assert kept.columns == docs.columns and [tuple(x) for x in kept.collect()] == [(1, "a b c d e f", 0, 0)]


def test_awkward_rows(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (None, None), (3, "a b c d e f"), (3, "a b c d e f"), (4, "")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["class_id"], r["copies"]) for r in N.jaccard_join(docs).collect()), key=str)
    assert got == [(3, 3, 3), (3, 3, 3), (4, 4, 2), (None, 3, 3), (None, 4, 2)]
    assert N.jaccard_join(docs.limit(0)).count() == 0


def test_band_choice():
    for recall in (0.9, 0.99, 0.999):
        b, r = N.bands_for(0.8, recall, 220)
        assert b * r <= 220 and 1 - (1 - 0.8**r) ** b >= recall


def test_a_repeated_row_travels_once(spark):
    """3,000 rows without an id that have one text, and a near copy: two texts go to the place where they meet."""
    text = " ".join(f"word{k}" for k in range(200))
    rows = [(None, text)] * 3000 + [(7, text + " more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    base = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("th"), F.col("text").alias("body"))
    reps = base.distinct().select(F.struct(F.col("id").isNull().alias("none"), "id", "th").alias("rep"), F.array(F.struct(F.lit(1).cast("long").alias("home"), F.lit(1).alias("blocks"), F.lit(0).alias("block"))).alias("homes"), F.array(F.lit(1).cast("long")).alias("leads"))
    sent = N._texts(base, reps).collect()
    assert sorted((r["none"], r["id"], r["body"]) for r in sent) == sorted([(True, None, text), (False, 7, text + " more")], key=lambda r: r[0])
    got = N.jaccard_join(docs).groupBy("class_id", "n_links", "copies", "kept").count().collect()
    assert sorted(tuple(r) for r in got) == [(7, 1, 1, True, 1), (7, 1, 3000, False, 3000)]


def test_blocks_by_bytes(spark):
    """Long near copies are dealt out to more blocks than their number asks for, with the same links."""
    texts = corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted(tuple(r) for r in N.jaccard_join(docs).collect())
    assert sorted(tuple(r) for r in N.jaccard_join(docs, block_bytes=20_000).collect()) == want


def test_shingles_are_compared_in_ranges(monkeypatch):
    r = np.random.default_rng(3)
    pool = r.integers(0, 1 << 63, 4000, np.uint64) * np.uint64(2)
    sets = [np.unique(pool[lo : lo + 900]) for lo in (0, 40, 90, 200, 1500, 1500, 3200)] + [np.zeros(0, np.uint64)]
    want = [[i != j and len(a) > 0 and len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)) for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    for size in (1 << 20, 500, 7):
        monkeypatch.setattr(N, "SLICE", size)
        assert N.linked(sets, 0.8).tolist() == want
