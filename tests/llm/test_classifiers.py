"""Operators 1, 3 and 7: held-out accuracy, isolation from labels, awkward rows."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack.llm import language_id, quality, toxicity
from lodestack.llm._spark import table

SF = "/root/testdata/sf0.01"


def crc(i, n):
    return zlib.crc32(str(i).encode()) % n


def test_language_held_out(spark):
    got = language_id.op1_language_id(spark, SF).collect()
    truth = {r["doc_id"]: r["lang"] for r in table(spark, SF, "documents").collect()}
    assert sorted(r["doc_id"] for r in got) == sorted(truth)
    assert all(r["held_out"] == (crc(r["doc_id"], 4) == 2) and 0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) / len(held) > 0.98
    assert sum(r["rejected"] for r in got) <= 0.01 * len(got)


def test_language_uses_text_alone(spark):
    docs = table(spark, SF, "documents")
    model = language_id.fit(docs.limit(400))
    a = language_id.identify(docs, model).select("lang_pred", "score").collect()
    b = language_id.identify(docs.select("doc_id", "text"), model).select("lang_pred", "score").collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_language_awkward(spark):
    docs = spark.createDataFrame([(1, None, "en", 0), (2, "", "en", 0), (3, "123 !!", None, 0), (None, "the cat", "en", 0), (4, "der hund und die katze " * 9000, "de", 0), (4, "the cat and the dog " * 30, "en", 0)], "doc_id long, text string, lang string, score int")
    model = language_id.fit(docs)
    got = sorted(((r["doc_id"], r["lang_pred"], r["rejected"]) for r in language_id.identify(docs, model).collect()), key=str)
    assert [g[1:] for g in got if g[0] in (1, 2, 3)] == [("und", True)] * 3 and len(got) == 6
    kept = language_id.keep_identified(docs, model)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} <= {None, 4}
    none = language_id.identify(docs, language_id.train([], []))
    assert {r["lang_pred"] for r in none.collect()} == {"und"}
    assert language_id.identify(docs.limit(0), model).count() == 0


@pytest.mark.parametrize("query,label,threshold,least", [(quality.op7_quality, "quality", 0.3, 0.97), (toxicity.op3_toxicity, "toxic", 0.5, 0.85)])
def test_labels_held_out(spark, query, label, threshold, least):
    sf = "/root/testdata/sf0.1"
    got = query(spark, sf).collect()
    truth = {r["doc_id"]: r[label] for r in table(spark, sf, "labels").collect()}
    assert len(got) == table(spark, sf, "documents").count()
    assert all(r["held_out"] == (crc(r["doc_id"], 5) == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= threshold) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held) > least


def test_scores_of_parts_agree():
    """Batches, lone texts and blocks give the same scores."""
    texts = ["you idiot of a man", "a kind and gentle man", "", "idiot", "good " * 50, "fine day " * 200 + "idiot " + "calm sea " * 200] * 4
    labels = [1, 0, 0, 1, 0, 1] * 4
    m = toxicity.train(texts, labels, None)
    z = m.logits(texts)
    assert np.allclose(z, np.concatenate([m.logits([t]) for t in texts]), atol=1e-4)
    old, toxicity.BLOCK = toxicity.BLOCK, 16
    try:
        assert np.allclose(z, m.logits(texts), atol=1e-4)
    finally:
        toxicity.BLOCK = old
    q = quality.train(texts, labels)
    assert np.allclose(q.scores(texts), np.concatenate([q.scores([t]) for t in texts]))


def test_without_labels(spark):
    for m in (quality.train([], []), quality.train(["a", "b"], [1, 1]), toxicity.train([], []), toxicity.train(["a"], [0])):
        assert np.isfinite(m.scores(["", "x y z", "w " * 5000])).all()
    assert (toxicity.train([], []).scores(["", "a"]) < 0.5).all()
    docs = spark.createDataFrame([(1, None, 9), (None, "a b", 9), (1, "a b", 9)], "doc_id long, text string, score int")
    got = quality.score(docs, quality.train([], []), 0.3, F.lit(None).cast("boolean")).collect()
    assert len(got) == 3 and not any(r["held_out"] for r in got)
    assert quality.score(docs.limit(0), quality.train([], []), 0.3).count() == 0
    assert quality.labelled(docs, spark.createDataFrame([], "doc_id long, quality int"), "quality", F.lit(True), 5) == ([], [])


def test_rare_class_keeps_its_places(spark):
    """1 : 4,000 labels and a text that a third of the rows share: the rare class still gets its bound, the copies one place."""
    docs = spark.range(40_000).selectExpr("id doc_id", "case when id % 3 = 0 and id >= 4000 then 'hot text' else concat('words of ', id) end text")
    labels = spark.range(40_000).selectExpr("id doc_id", "case when id < 10 then 1 else 0 end toxic")
    texts, y = quality.labelled(docs, labels, "toxic", F.lit(True), 8)
    assert sum(y) == 8 and len(y) == 16 and len(set(texts)) == 16


def test_rare_language_and_hot_text(spark):
    docs = spark.range(30_000).selectExpr("id doc_id", "case when id < 12 then concat('rare ', id) when id % 3 = 0 then 'hot text' else concat('words of ', id) end text", "case when id < 12 then 'xx' when id % 3 = 0 then 'hh' else 'en' end lang")
    texts, langs = language_id.labelled_sample(docs, "text", "lang", F.lit(True), 6)
    assert langs.count("xx") == 6 and langs.count("en") == 6 and langs.count("hh") == 1 and len(set(texts)) == 13


def test_pieces_change_nothing(monkeypatch):
    """A text far longer than a piece is read whole, and its features do not depend on what stands beside it."""
    from lodestack.llm import _tokens

    t = "Ünder the Moon, we're 12-fold BOLD  idiot\n" * 40 + "ΟΔΟΣ straße"
    model = language_id.train([t, "der hund"], ["en", "de"])
    whole = _tokens.words([t, "", "a", t], (2,)), [v.tolist() for _, v in quality.features([t, "", "a b", t])], model.logits([t, "", "abc"])
    monkeypatch.setattr(_tokens, "PIECE", 64)
    monkeypatch.setattr(quality, "BLOCK", 7)
    _tokens._powers.cache_clear()
    cut = _tokens.words([t, "", "a", t], (2,)), [v.tolist() for _, v in quality.features([t, "", "a b", t])], model.logits([t, "", "abc"])
    giant = [_tokens.words([a + "x" * 200])[0][-4:].tolist() for a in ("", "some words before ")]
    _tokens._powers.cache_clear()
    assert all((a == b).all() for a, b in zip(whole[0], cut[0])) and [set(v) for v in whole[1]] == [set(v) for v in cut[1]]
    assert np.allclose(whole[2][0], cut[2][0]) and (whole[2][1] == cut[2][1]).all() and giant[0] == giant[1]


def test_log_count_ratios_by_hand():
    ids = [np.array([0, 1]), np.array([1]), np.array([2])]
    got = quality.log_count_ratio(ids, np.array([1.0, 1.0, -1.0]), 4, 1.0)
    pos, neg = np.array([2, 3, 1, 1]) / 7, np.array([1, 1, 2, 1]) / 5
    assert np.allclose(got, np.log(pos / neg))


def test_dual_descent_finds_the_least_primal():
    """The primal objective is convex: where no change in any direction lowers it, it is least."""
    rng = np.random.default_rng(1)
    n, size = 60, 12
    rows = [(np.sort(rng.choice(size, 4, replace=False)), rng.standard_normal(4)) for _ in range(n)]
    y = np.where(rng.random(n) < 0.5, 1.0, -1.0)
    c = np.full(n, 0.7)
    w, b = quality.dual_descent(rows, y, size, c, 400, 3)

    def primal(w, b):
        return 0.5 * (w @ w + b * b) + sum(ci * max(0.0, 1 - yi * (w[i] @ v + b)) for (i, v), yi, ci in zip(rows, y, c))

    best = primal(w, b)
    for scale in (1e-3, 1e-2, 0.1, 1):
        for _ in range(150):
            assert primal(w + scale * rng.standard_normal(size), b + scale * rng.standard_normal()) >= best - 1e-4
    assert best < primal(np.zeros(size), 0.0)


def test_language_scores_against_plain_loops():
    """Mean of the subwords' rows, listed one by one."""
    mask = (1 << 64) - 1

    def mix(h):
        h ^= h >> 33
        h = h * 0xFF51AFD7ED558CCD & mask
        h ^= h >> 29
        h = h * 0xC4CEB9FE1A85EC53 & mask
        return h ^ (h >> 32)

    mul = [int(x) for x in language_id._MUL]

    def bucket(s):
        h = len(s)
        for j, ch in enumerate(s):
            h = (h * mul[0] + ord(ch) * mul[1 + j % 3]) & mask
        return mix(h) & (language_id.BUCKETS - 1)

    texts = ["Der Hund, 12 ÉTÉS", "x", "12 !", "the cat's  whiskers\nare long", ""]
    m = language_id.train(texts[:1] * 6 + texts[3:4] * 6, ["de"] * 6 + ["en"] * 6)
    z, count = m.logits(texts)
    for k, t in enumerate(texts):
        words = "".join(c if c.isalpha() else " " for c in t.lower()).split()
        subs = [f" {w} "[i : i + n] for w in words for n in language_id.ORDERS for i in range(len(w) + 3 - n)]
        assert count[k] == len(subs)
        want = sum((m.table[bucket(s)].astype(float) for s in subs), np.zeros(2)) / max(1, len(subs)) + m.bias
        assert np.allclose(z[k], want, atol=1e-5)


def test_filters_over_several_words():
    """Word order decides the label: only a filter wider than one word can tell."""
    rng = np.random.default_rng(4)
    words = [f"w{k}" for k in range(30)]
    rows, y = [], []
    for k in range(400):
        pair = ["kick", "dog"] if k % 2 else ["dog", "kick"]
        t = list(rng.choice(words, 12))
        at = int(rng.integers(0, 11))
        rows.append(" ".join(t[:at] + pair + t[at:]))
        y.append(k % 2)
    m = toxicity.train(rows[:300], y[:300], None, prior=0.5, epochs=20)
    assert np.mean((m.scores(rows[300:]) >= 0.5) == np.array(y[300:])) > 0.9


def test_convolution_against_plain_loops():
    m = toxicity.train(["you idiot", "kind man here", "idiot of a man", "calm sea"] * 3, [1, 0, 1, 0] * 3, None)
    for t in ("", "one", "you are an idiot of a man", "a b c d e f g h"):
        h, _ = toxicity.words([t], toxicity.PREFIXES)
        e = [sum(m.tables[k][toxicity.buckets(h[k])[i]] for k in range(len(m.tables))) for i in range(h.shape[1])] or [np.zeros(toxicity.DIM)]
        e = [*e, *[np.zeros(toxicity.DIM)] * 2]
        pooled = [max(sum(e[i + k] @ m.filters[w][k][:, j] for k in range(w + 1)) + m.offset[w][j] for i in range(len(e) - 2)) for w in range(3) for j in range(toxicity.FILTERS)]
        assert abs(m.logits([t])[0] - (sum(max(0.0, p) * o for p, o in zip(pooled, m.out)) + m.bias)) < 1e-3


def test_choices_are_cross_validated():
    """The choice that tells the classes apart wins, and the model keeps its prefixes."""
    r = np.random.default_rng(2)
    word = lambda stem: stem + "".join(r.choice(list("abcdefgh"), 9))
    texts = [" ".join([word("q"), word("vile" if i % 2 else "good"), word("z")]) for i in range(160)]
    found = toxicity.cross_validated(texts, [i % 2 for i in range(160)], 0.2, [(), (4,)], [0.3, 0.5])
    assert len(found) == 4 and found[0][1] == (4,) and found[0][0] > 0.9 > found[-1][0] and found[-1][1] == ()
    m = toxicity.train(texts, [i % 2 for i in range(160)], prefixes=(4,))
    assert m.prefixes == (4,) and (m.scores(["qa vilexyz za", "qa goodxyz za"]) > 0.5).tolist() == [True, False]


def test_toxicity_learns_from_every_labelled_row(spark):
    """More rows of a class than the sample of 1,500 that once was: counts and steps take all of them, in several replicas."""
    docs = spark.range(6000).selectExpr("id doc_id", "concat('word', id, case when id % 2 = 0 then ' you vile ' else ' a calm ' end, 'thing ', id % 7) text")
    labels = spark.range(5000).selectExpr("id doc_id", "cast(1 - id % 2 as int) toxic").union(spark.createDataFrame([(5500, None)], "doc_id long, toxic int"))
    rows = toxicity.labelled_rows(docs, labels, F.col("doc_id") % 10 != 3, 700)
    n, seen = toxicity._gathered(rows, toxicity._counts)
    h, _ = toxicity.words(["vile"], toxicity.PREFIXES)
    assert rows.count() == 4500 and n.tolist() == [2000, 2500] and seen[1, 0, toxicity.buckets(h[0])[0]] >= 2500
    fitted = rows.where("not held")
    assert 0 < fitted.count() < 4500 and fitted.rdd.getNumPartitions() > 1
    m = toxicity.fit(rows, None, epochs=2)
    assert (m.scores(["word9 you vile thing 3", "word9 a calm thing 3", "vile", "calm"]) >= 0.5).tolist() == [True, False, True, False]
    assert (toxicity.fit(rows.where("y = 1")).scores(["vile", ""]) < 0.5).all() and (toxicity.fit(rows.limit(0)).scores(["vile"]) < 0.5).all()


def test_labelled_texts_are_shuffled_once(spark, monkeypatch):
    """As on tables too large to broadcast: texts without a label stay where they are read, the others move once, and no row is lost."""
    import random

    r = random.Random(3)
    data = [(k % 1900 if k % 50 else None, None if k % 40 == 1 else r.randbytes(1000).hex()) for k in range(4000)]
    marks = [(k, (None, 0, 1)[k % 3]) for k in range(0, 4000, 2)] + [(4, 0), (8, 0), (None, 1)]
    docs, labels = spark.createDataFrame(data, "doc_id long, text string").repartition(4).localCheckpoint(), spark.createDataFrame(marks, "doc_id long, toxic int")
    sc = spark.sparkContext._jsc.sc()

    def moved():
        sc.listenerBus().waitUntilEmpty()
        own = sc.statusStore().executorList(False)
        return sum(own.apply(k).totalShuffleWrite() for k in range(own.size()))

    before, most = moved(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        rows = toxicity.labelled_rows(docs, labels, F.col("doc_id") % 5 != 0, 300)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
    want = sorted((i, y, t or "") for i, t in data for k, y in marks if i is not None and i == k and y is not None and i % 5)
    assert sorted((x["i"], x["y"], x["body"]) for x in rows.collect()) == want and len(want) > 1000
    assert moved() - before < 1.2 * sum(len(t) for _, _, t in want)  # LZ4 finds nothing in these texts
    monkeypatch.setattr(toxicity, "MOST", 4)  # a map so full that it tells nothing
    again = toxicity.labelled_rows(docs, labels, F.col("doc_id") % 5 != 0, 300)
    assert sorted((x["i"], x["y"], x["body"]) for x in again.collect()) == want
    toxicity.dropped(rows, again)


def test_cuts_of_counts_against_every_cut():
    r = np.random.default_rng(8)
    z, t = np.round(r.standard_normal(300) * 4) / 4, r.integers(0, 2, 300)
    z += t
    c = toxicity.best_cut(z, t, 0.1)
    error = lambda c: 0.1 * (z[t == 1] < c).mean() + 0.9 * (z[t == 0] >= c).mean()
    assert error(c) <= min(error(k) for k in np.arange(-10, 10, 0.01)) + 1e-9
