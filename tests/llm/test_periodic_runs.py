"""Operator 11 against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from lodestack.llm import periodic_runs as P

WHITE = " \t\n\x0b\x0c\r"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(ws, least=6, times=4):
    """All maximal stretches of each period, the smallest period of equal ones."""
    best = {}
    for q in range(1, len(ws) // times + 1):
        i = 0
        while i + q < len(ws):
            j = i
            while j + q < len(ws) and ws[j] == ws[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q):
                best.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((s, n, p) for (s, n), p in best.items())


def numbers(ws):
    known = {}
    return [known.setdefault(w, len(known)) for w in ws]


def strings():
    r = random.Random(3)
    yield []
    for n in range(1, 40):
        yield [0] * n
    for _ in range(1500):
        yield [r.randrange(r.choice((2, 2, 3))) for _ in range(r.randrange(90))]
    for _ in range(300):  # runs with periods beyond the rounds, next to each other, overlapping, and cut by other words
        s = []
        for _ in range(r.randrange(1, 4)):
            unit = [r.randrange(r.choice((2, 50))) for _ in range(r.choice((1, 2, 7, 8, 9, 13, 20)))]
            k = int(len(unit) * r.uniform(1.5, 6))
            s += (unit * 7)[:k] + [r.randrange(50) for _ in range(r.randrange(4))]
        yield s
    a, b = [0], [0, 1]
    for _ in range(12):
        a, b = b, b + a
    yield b
    tm = [0]
    for _ in range(9):
        tm += [1 - x for x in tm]
    yield tm
    yield ([0] * 100 + [1]) * 6 + [0] * 100
    yield (([0] * 30 + [1]) * 3 + [2]) * 5


def test_runs_of_many_strings_at_once():
    every = list(strings())
    bounds = np.concatenate(([0], np.cumsum([len(s) for s in every])))
    got = P.find_runs(np.array(sum(every, []), np.int32), bounds)
    for s, g in zip(every, got):
        assert g == brute(s), s


def test_values_of_the_z_function():
    r = random.Random(5)
    for _ in range(300):
        v = np.array([r.randrange(2) for _ in range(60)])
        z = {q: P.common(v[q:], v) for q in range(1, 60)}
        for q, value in P.periods(v, [q for q in range(1, 31) if z[q] >= 2]):
            assert value == z[q] >= q
        want = [q for q in range(1, 31) if z[q] >= max(q, 2)]
        got = [q for q, _ in P.periods(v, [q for q in range(1, 31) if z[q] >= 2])]
        assert all(any(w % q == 0 for q in got) for w in want if w >= 2)


def test_long_runs_cost_no_square():
    n = 400_000
    ids = np.concatenate((np.zeros(n, np.int32), np.arange(n, dtype=np.int32), np.tile(np.arange(37, dtype=np.int32), n // 37)))
    (got,) = P.find_runs(ids, np.array([0, len(ids)]))
    assert got == [(0, n + 1, 1), (2 * n, n // 37 * 37, 37)]


def texts():
    r = random.Random(8)
    out = [None, "", "  \n\t ", "one", "la " * 6, "la\x0bla\x0cla la\rla", "É x É x É x É x", "a b " * 4000 + "c " + "a b c d e f g h i " * 900, "x" * 3_000_000 + " " + "y y " * 5]
    for _ in range(150):
        unit = [r.choice("abcdé") for _ in range(r.choice((1, 2, 3, 10)))]
        out.append(r.choice(WHITE).join(unit * r.randrange(1, 9) + [r.choice("abc") for _ in range(r.randrange(30))]))
    return out


def planted(i, ws):
    h = zlib.crc32(str(i).encode())
    g = h // 10
    if h % 10 or not ws:
        return ws
    a = g % len(ws)
    p = 1 + (len(ws) - a) // (3 + g % 8)
    return [ws[k] if k < a else ws[a + (k - a) % p] for k in range(len(ws))]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def expected(i, text):
    ws = planted(i, words_of(text)) if i is not None else words_of(text)
    runs = brute(ws)
    gone = {k for s, n, p in runs for k in range(s + p, s + n)}
    best = min(((-n, s, p) for s, n, p in runs), default=None)
    tail = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
    return (i, len(runs), *tail, sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)), sha(" ".join(w for k, w in enumerate(ws) if k not in gone)))


def test_digests_with_planted_runs(spark):
    rows = [(i - 3, t, "x", 1) for i, t in enumerate(texts()) if len(t or "") < 2000] + [(None, "la " * 9, "x", 1), (7, "b b", "x", 1), (7, "b b", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, n int").repartition(3)
    got = P.digests(P.periodic_runs(P.planted(docs))).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[-1])
    assert sorted((tuple(r) for r in got), key=key) == sorted((expected(r[0], r[1]) for r in rows), key=key)
    assert sum(r["n_runs"] > 0 and zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0 for r in got) > 5


def test_runs_and_collapsed_texts(spark):
    """Long texts, pieces of a text that end within no word, words with other spaces inside."""
    rows = list(enumerate(texts()))
    got = {r["doc_id"]: r for r in P.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        ws = words_of(t)
        if len(ws) > 3000:
            assert [tuple(x) for x in got[i]["runs"]] == [(0, 8000, 2), (8001, 8100, 9)] and got[i]["collapsed"] == "a b c a b c d e f g h i"
            continue
        runs = brute(ws)
        gone = {k for s, n, p in runs for k in range(s + p, s + n)}
        assert got[i]["n_words"] == len(ws) and [tuple(x) for x in got[i]["runs"]] == runs
        assert got[i]["collapsed"] == " ".join(w for k, w in enumerate(ws) if k not in gone)
    assert P.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string").limit(0)).count() == 0


def test_bounds_of_parameters():
    with pytest.raises(ValueError):
        P.find_runs(np.zeros(3, np.int32), np.array([0, 3]), times=2)


def test_whole_table(spark):
    """Every document of a table with its planted runs, against all periods of all words compared as arrays."""
    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in P.table(spark, sf, "documents").select("doc_id", "text").collect()}
    got = {r[0]: tuple(r) for r in P.op11_periodic_runs(spark, sf).collect()}
    assert set(got) == set(docs)
    found = 0
    for i, text in docs.items():
        ws = planted(i, words_of(text))
        ids, best = np.array(numbers(ws), np.int64), {}
        for q in range(1, len(ws) // 4 + 1):
            edge = np.flatnonzero(np.diff((ids[:-q] == ids[q:]).astype(np.int8), prepend=0, append=0))
            for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
                if b - a + q >= max(6, 4 * q):
                    best.setdefault((a, b - a + q), q)
        runs = sorted((s, n, p) for (s, n), p in best.items())
        gone = {k for s, n, p in runs for k in range(s + p, s + n)}
        top = min(((-n, s, p) for s, n, p in runs), default=None)
        tail = (top[1], -top[0], top[2], 1000 * -top[0] // top[2]) if top else (None,) * 4
        assert got[i] == (i, len(runs), *tail, sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)), sha(" ".join(w for k, w in enumerate(ws) if k not in gone)))
        found += bool(runs)
    assert found > 10
