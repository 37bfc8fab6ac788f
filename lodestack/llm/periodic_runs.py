"""Periodic runs of words: Main-Lorentz divide and conquer over interned word ids.

A run is a stretch of consecutive words with smallest period q, at least `least` words and `times` periods long, that no
neighbouring word extends keeping period q. Words are maximal stretches without ASCII white space, interned within an Arrow
batch; all documents of a batch are halved together, one level after another. At a midpoint, a run that crosses it has two
periods on one side of it at least (times >= 4), so the values Z(q) >= q of the half's Z-function name its period. Z-values
that end within a few words are found for all midpoints of a level at once; the others by the Z-algorithm with its box,
at the positions left. What a half finds is extended to both sides; a run that goes beyond its node belongs to a node above.

Time is about n log n numpy steps; memory is some 20 bytes for each word of a batch and its distinct words once, so that a
text of 20 MB takes no list of its words.

Defined cases: null and empty texts have no words, no runs and an empty collapsed text; equal rows give equal rows; null ids
are kept; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm._spark import arrow_map, table
from lodestack.llm._tokens import interned

LEAST, TIMES = 6, 4
#: Z-values up to so many words are found for all midpoints at once. Words that are joined at a time.
ROUNDS, PIECE = 8, 1 << 20


def common(a: np.ndarray, b: np.ndarray, at: int = 0) -> int:
    """Length of the common prefix of two arrays, known to be `at` at least."""
    n, step = min(len(a), len(b)), 16
    while at < n:
        unlike = np.flatnonzero(a[at : at + step][: n - at] != b[at : at + step][: n - at])
        if len(unlike):
            return at + int(unlike[0])
        at, step = at + step, step * 4
    return n


def periods(v: np.ndarray, at: list[int]) -> Iterator[tuple[int, int]]:
    """(q, Z(q)) for the q of `at` (ascending) with Z(q) >= q, without those that a smaller one divides.

    Values inside the box of an earlier one are copied, others compared; as Z(q) >= q, every period up to Z(q) is
    a multiple of q (Fine and Wilf) and names the same run, so these are passed over.
    """
    z: dict[int, int] = {}
    left = right = over = 0
    for q in at:
        if q <= over:
            continue
        known = min(z.get(q - left, 0), right - q) if q < right else 0
        if q >= right or known == right - q or q - left not in z:
            known = common(v[q:], v, known)
        if q + known > right:
            left, right = q, q + known
        z[q] = known
        if known >= q:
            over = known
            yield q, known


def _halves(ids: np.ndarray, edge: np.ndarray, size: np.ndarray, sign: int) -> tuple[np.ndarray, np.ndarray]:
    """(node, q) with Z(q) >= min(q, ROUNDS) in the halves that begin at `edge` and go in the direction `sign`."""
    reach = np.where(size >= 3, size // 2, 0)
    node = np.repeat(np.arange(len(edge), dtype=np.int32), reach)
    q = np.arange(1, len(node) + 1, dtype=np.int32) - np.repeat(np.cumsum(reach) - reach, reach).astype(np.int32)
    first = edge[node]
    hit = np.flatnonzero(ids[first + sign * q] == ids[first])
    node, q, first = node[hit], q[hit], first[hit]
    found = []
    for r in range(1, ROUNDS):
        whole = q <= r - (r < 2)  # a run of one word repeated has three on one side
        found.append((node[whole], q[whole]))
        keep = ~whole
        keep[keep] = ids[first[keep] + sign * (q[keep] + r)] == ids[first[keep] + sign * r]
        node, q, first = node[keep], q[keep], first[keep]
    found.append((node, q))
    node, q = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((q, node))
    return node[order], q[order]


def find_runs(ids: np.ndarray, bounds: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each stretch ids[bounds[d]:bounds[d + 1]], by start and then period; starts count within it."""
    if least < 6 or times < 4:
        raise ValueError("two periods must lie on one side of a midpoint: least >= 6, times >= 4")
    found: list[dict[tuple[int, int], int]] = [{} for _ in range(len(bounds) - 1)]
    doc = np.arange(len(bounds) - 1)
    lo, hi = bounds[:-1].astype(np.int64), bounds[1:].astype(np.int64)
    while True:
        keep = hi - lo >= least
        doc, lo, hi = doc[keep], lo[keep], hi[keep]
        if not len(doc):
            break
        mid = (lo + hi) // 2
        for sign, edge, size in ((1, mid, hi - mid), (-1, mid - 1, mid - lo)):
            node, q = _halves(ids, edge, size, sign)
            cuts = np.flatnonzero(np.diff(node, prepend=-1, append=-1)) if len(node) else np.zeros(1, np.int64)
            for a, b in zip(cuts.tolist(), cuts[1:].tolist()):
                k = int(node[a])
                l, m, h, d = int(lo[k]), int(mid[k]), int(hi[k]), int(doc[k])
                half = ids[m:h] if sign > 0 else ids[l:m][::-1]
                for p, z in periods(half, q[a:b].tolist()):
                    if sign > 0:
                        start, end = m - common(ids[l:m][::-1], ids[l : m + p][::-1]), m + p + z
                    else:
                        start, end = m - p - z, m + common(ids[m:h], ids[m - p : h])
                    beyond = start == l > bounds[d] and ids[l - 1] == ids[l - 1 + p] or end == h < bounds[d + 1] and ids[h] == ids[h - p]
                    if not beyond and end - start >= max(least, times * p):
                        key = start - int(bounds[d]), end - start
                        found[d][key] = min(p, found[d].get(key, p))
        doc, lo, hi = np.concatenate((doc, doc)), np.concatenate((lo, mid)), np.concatenate((mid, hi))
    return [sorted((s, n, p) for (s, n), p in runs.items()) for runs in found]


def collapsed(names: list[bytes], ids: np.ndarray, runs: list[tuple[int, int, int]]) -> bytes:
    """The words outside runs and those of each run's first period, joined by one space."""
    if runs:
        marks = np.zeros(len(ids) + 1, np.int32)
        for start, length, period in runs:
            marks[start + period] += 1
            marks[start + length] -= 1
        ids = ids[np.cumsum(marks[:-1]) == 0]
    return b" ".join(b" ".join(map(names.__getitem__, ids[lo : lo + PIECE].tolist())) for lo in range(0, len(ids), PIECE))


def _runs(least: int, times: int):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            known: dict[bytes, int] = {}
            each = [interned(t.as_py() or b"", known) for t in b.column("body")]
            bounds = np.concatenate(([0], np.cumsum([len(x) for x in each]))).astype(np.int64)
            ids = np.concatenate(each) if each else np.zeros(0, np.int32)
            runs = find_runs(ids, bounds, least, times)
            names = list(known)
            texts = [collapsed(names, x, r) for x, r in zip(each, runs)]
            rows = [[{"start": s, "length": n, "period": p} for s, n, p in r] for r in runs]
            yield pa.record_batch([b.column("id"), pa.array([len(x) for x in each], pa.int64()), pa.array(rows, kind), pa.array(texts, pa.binary())], ["id", "n", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """One row per row of docs: doc_id, n_words, runs (array of start, length, period, by start and then period), collapsed.

    collapsed is the text without the repetitions: a word goes if a run contains it behind that run's first period.
    """
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("body"))
    out = arrow_map(base, _runs(least, times), "id long, n long, runs array<struct<start:long,length:long,period:long>>, collapsed binary")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_words"), "runs", F.col("collapsed").cast("string").alias("collapsed"))


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text), the text of every tenth document (by crc32 of its id) made periodic from one of its words on.

    With h = crc32(doc_id), g = floor(h / 10) and n words, each word i >= a becomes word a + (i - a) mod p for
    a = g mod n, p = 1 + floor((n - a) / (3 + g mod 8)). Null ids and texts without words stay as they are.
    """
    words = F.filter(F.split("text", "[ \t\n\x0b\f\r]+"), lambda w: w != "")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    base = docs.select("doc_id", "text", h.alias("h"), F.floor(h / 10).cast("long").alias("g"), F.when(h % 10 == 0, words).alias("w"))
    base = base.withColumn("n", F.size("w")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    p = (F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)) + 1).cast("int")
    made = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.get("w", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))))
    return base.withColumn("p", p).select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(made, " ")).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """Of the rows of periodic_runs: number of runs, the longest one (ties: least start, then period), and digests of runs and collapsed text."""
    key = lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))
    out = found.withColumn("best", F.array_min(F.transform("runs", key)))
    line = lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))
    length: Column = -F.col("best.l")
    return out.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.s").alias("start"),
        length.alias("length"),
        F.col("best.p").alias("period"),
        F.expr("(1000 * -best.l) div best.p").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(periodic_runs(planted(table(spark, sf_dir, "documents"))))
