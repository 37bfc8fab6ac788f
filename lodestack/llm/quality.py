"""Quality classifier: naive Bayes support vectors over n-gram indicators.

Tokens are runs of non-space characters. Features of a text are the hashed n-grams it contains, each
once however often it occurs: word 1- and 2-grams, 1- to 3-grams of token shapes (case, digits and
punctuation, runs collapsed), and a mark where a token repeats the one before. Indicators are scaled
by the log-count ratio of the two classes; a linear model with hinge loss is fitted on them by dual
coordinate descent in numpy, on a bounded sample of labelled rows. Margins become scores by a logistic
fitted on rows that training leaves out, shifted so that the best threshold there lies at 0.3.

Defined cases: null and empty texts have no n-grams and get the score of the bias alone; without
labels of both classes every score is the share of label 1 (0.5 without labels); rows without label
are scored like all others; null ids count as not held out; a label on a repeated doc_id counts for each of
its rows; other columns are ignored; whole texts are read, in pieces.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm._spark import arrow_map, crc_mod, table
from lodestack.llm._tokens import code_points, joined, mix, pieces, run_hashes, runs

BITS = 18
#: Distinct labelled texts of each class that training may use: a documented bound. So many times as many rows are fetched for it.
SAMPLE_PER_CLASS, FETCH = 1500, 2
THRESHOLD = 0.3
#: Tokens of a text whose n-grams are made at once.
BLOCK = 1 << 17
_CLASS: list[np.ndarray] = []
_P = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def _classes() -> np.ndarray:
    """0 space, 1 upper, 2 other letter, 3 digit; other characters are their own class."""
    if not _CLASS:
        def of(c: int) -> int:
            s = chr(c)
            return 0 if s.isspace() else 1 if s.isupper() else 2 if s.isalpha() else 3 if s.isdigit() else c + 4

        _CLASS.append(np.fromiter((of(c) for c in range(0x110000)), np.uint32, 0x110000))
    return _CLASS[0]


@functools.lru_cache(1)
def _solid() -> np.ndarray:
    return _classes() > 0


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the tokens and of their shapes, and offsets by text."""
    text, bounds = joined(texts)
    low, _ = joined([t.lower() if len(t.lower()) == len(t) else t for t in texts])
    word, shape, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for lo, cp in pieces(text, _solid()):
        cls = _classes()[cp]
        starts, ends = runs(cls > 0)
        word.append(run_hashes(code_points(low[lo : lo + len(cp)]), starts, ends))
        keep = np.ones(len(cls), bool)  # classes with runs collapsed
        keep[1:] = cls[1:] != cls[:-1]
        new = np.concatenate(([0], np.cumsum(keep)))
        shape.append(run_hashes(cls[keep], new[starts], new[ends - 1] + keep[ends - 1]) if len(starts) else shape[0])
        at.append(starts + lo)
    offsets = np.zeros(len(texts) + 1, np.int64)
    offsets[1:] = np.searchsorted(np.concatenate(at), bounds)
    return np.concatenate(word), np.concatenate(shape), offsets


def features(texts: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    """(text number, its distinct feature buckets), in order."""
    stamp, seen = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, bool)
    word, shape, cuts = tokens(texts)
    for i, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
        found = []
        for at in range(lo, max(hi, lo + 1), BLOCK):  # the n-grams that begin in this block
            k = min(BLOCK, hi - at)
            w, s = word[at : min(hi, at + BLOCK + 1)], shape[at : min(hi, at + BLOCK + 2)]
            s2 = s[: len(w)]
            grams = [w[:k], mix(w[:-1] * _P[0] + w[1:]), s[:k] + _P[1], mix(s2[:-1] * _P[1] + s2[1:]), mix((s[:-2] * _P[1] + s[1:-1]) * _P[2] + s[2:])]
            if (w[1:] == w[:-1]).any():
                grams.append(np.array([_P[2]]))
            ids = (np.concatenate(grams) & np.uint64((1 << BITS) - 1)).astype(np.int64)
            if found:
                ids = ids[~seen[ids]]
            n = np.arange(len(ids))
            stamp[ids] = n
            ids = ids[stamp[ids] == n]  # each bucket once
            found.append(ids)
            if hi - lo > BLOCK:
                seen[ids] = True
        ids = np.concatenate(found) if len(found) > 1 else found[0]
        seen[ids] = False
        yield i, ids


@dataclass
class QualityModel:
    weight: np.ndarray  # by bucket, log-count ratio times linear weight
    bias: float
    slope: float
    shift: float

    def margins(self, texts: list[str]) -> np.ndarray:
        out = np.full(len(texts), self.bias)
        for i, ids in features(texts):
            if len(ids):
                out[i] += self.weight[ids].sum(dtype=np.float64) / np.sqrt(len(ids))
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(texts) + self.shift, -50, 50)))


def dual_descent(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, size: int, c: np.ndarray, epochs: int, seed: int) -> tuple[np.ndarray, float]:
    """Linear hinge-loss model by dual coordinate descent; c bounds each row's dual variable. The bias is a constant feature."""
    w, b, alpha = np.zeros(size), 0.0, np.zeros(len(rows))
    norm = np.array([float(v @ v) + 1 for _, v in rows])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            ids, v = rows[i]
            gradient = y[i] * (w[ids] @ v + b) - 1
            new = min(max(alpha[i] - gradient / norm[i], 0.0), c[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[ids] += step * v
                b += step
                alpha[i] = new
    return w, b


def log_count_ratio(ids: list[np.ndarray], y: np.ndarray, size: int, smooth: float) -> np.ndarray:
    """Log of the ratio of the smoothed shares of each feature in the two classes (y: 1 or -1)."""
    counts = {s: np.full(size, smooth) for s in (1.0, -1.0)}
    for own, s in zip(ids, y):
        counts[s][own] += 1
    return np.log(counts[1.0] / counts[1.0].sum()) - np.log(counts[-1.0] / counts[-1.0].sum())


def train(texts: list[str], labels: list[int], cost: float = 1.0, epochs: int = 8, smooth: float = 1.0, seed: int = 3) -> QualityModel:
    y = np.where(np.array(labels, int) > 0, 1.0, -1.0) if labels else np.zeros(0)
    size = 1 << BITS
    if not len(y) or abs(y.sum()) == len(y):
        share = float((y > 0).mean()) if len(y) else 0.5
        share = min(max(share, 1e-3), 1 - 1e-3)
        return QualityModel(np.zeros(size, np.float32), 0.0, 1.0, float(np.log(share / (1 - share))))
    ids = [v for _, v in features(texts)]
    held = np.arange(len(y)) % 4 == 3
    if abs(y[held].sum()) == held.sum() or abs(y[~held].sum()) == (~held).sum():
        held = np.zeros(len(y), bool)
    ratio = log_count_ratio([ids[i] for i in np.flatnonzero(~held)], y[~held], size, smooth)
    rows = [(v, ratio[v] / np.sqrt(max(1, len(v)))) for v in ids]
    fit = np.flatnonzero(~held)
    c = np.where(y > 0, cost * (y[fit] < 0).sum() / len(fit) * 2, cost * (y[fit] > 0).sum() / len(fit) * 2)[fit]
    w, b = dual_descent([rows[i] for i in fit], y[fit], size, c, epochs, seed)
    model = QualityModel((ratio * w).astype(np.float32), float(b), 1.0, 0.0)
    cal = np.flatnonzero(held) if held.any() else fit
    z = model.margins([texts[i] for i in cal])
    t = (y[cal] > 0).astype(float)
    slope, shift = 1.0, 0.0
    for _ in range(50):  # Newton steps for the logistic, lightly damped
        p = 1 / (1 + np.exp(-np.clip(slope * z + shift, -50, 50)))
        h = np.maximum(p * (1 - p), 1e-6)
        a = np.array([[(h * z * z).sum() + 1e-2, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-2]])
        g = np.array([((p - t) * z).sum() + 1e-2 * slope, (p - t).sum() + 1e-2 * shift])
        d = np.linalg.solve(a, g)
        slope, shift = slope - d[0], shift - d[1]
    slope = max(float(slope), 1e-3)
    # the cut with the best balanced accuracy on the held rows gets the score THRESHOLD
    cuts = np.unique(z)
    cuts = (np.concatenate((cuts[:1] - 1, cuts)) + np.concatenate((cuts, cuts[-1:] + 1))) / 2
    good = [((z >= k) & (t > 0)).sum() / max(1, t.sum()) + ((z < k) & (t == 0)).sum() / max(1, (1 - t).sum()) for k in cuts]
    best = float(np.mean(cuts[np.flatnonzero(np.array(good) >= max(good) - 1e-9)]))
    model.slope, model.shift = slope, float(np.log(THRESHOLD / (1 - THRESHOLD)) - slope * best)
    return model


def labelled(docs: DataFrame, labels: DataFrame, label_col: str, learn, per_class: int, id_col: str = "doc_id", text_col: str = "text", fetch: int = FETCH) -> tuple[list[str], list[int]]:
    """At most per_class distinct texts of each class, those of the labelled rows with the least id hashes; whole texts.

    Each class has its own top-k, so a rare class is not crowded out however large the other one is. fetch * per_class
    rows of a class are read, in order of their hashes, to find per_class texts that differ.
    """
    lab = labels.where(F.col(label_col).isin(0, 1) & learn).select(F.col("doc_id").cast("long").alias("i"), F.col(label_col).cast("int").alias("y")).where("i is not null")
    lab = lab.withColumn("h", F.xxhash64("i"))
    few = [lab.where(F.col("y") == k).orderBy("h", "i").limit(fetch * per_class) for k in (0, 1)]
    base = docs.select(F.col(id_col).cast("long").alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    got = base.join(F.broadcast(few[0].unionByName(few[1])), "i").groupBy("y", F.xxhash64("t").alias("g")).agg(F.min("h").alias("h"), F.any_value("t").alias("t")).orderBy("h", "g", "y").collect()
    texts, out, taken = [], [], {0: 0, 1: 0}
    for r in got:
        if taken[r["y"]] < per_class:
            taken[r["y"]] += 1
            texts.append(r["t"])
            out.append(r["y"])
    return texts, out


def score(docs: DataFrame, model, threshold: float, held_out=None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, score, predicted, by any model with scores(texts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.scores(b.column("body").to_pylist())
            yield pa.record_batch([b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.lit(False) if held_out is None else held_out, F.lit(False)).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    return arrow_map(base, run, "doc_id long, held_out boolean, score double, predicted int")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learn = crc_mod(F.col("doc_id"), 5) != 0
    model = train(*labelled(docs, table(spark, sf_dir, "labels"), "quality", learn, SAMPLE_PER_CLASS))
    return score(docs, model, THRESHOLD, crc_mod(F.col("doc_id"), 5) == 0)
