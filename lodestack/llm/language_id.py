"""Language identification: averaged hashed subword embeddings under a linear softmax, with calibrated rejection.

Letters of the lower-cased text form words bounded by one space; their character 2- to 4-grams, each
inside one word with its bounds, are hashed to buckets. A text is the average of its subwords'
embeddings; a linear softmax gives the language. Embeddings and weights are trained by stochastic
gradient descent in numpy on a bounded sample of labelled rows; a temperature and the rejection
threshold are calibrated on rows of the sample that training leaves out. For prediction the
embeddings are multiplied by the weights once, so a subword costs one lookup of a row of that table.

Defined cases: null texts and texts without a letter get `und`, score 0, rejected; rows with null
lang are never learned from; a corpus with no labelled row predicts `und`; null ids count as not held
out and are not learned from; other columns are ignored; whole texts are read, in pieces. The number of
languages bounds the model as it bounds the sample: both have a row, or rows, for each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestack.llm._spark import arrow_map, crc_mod, table
from lodestack.llm._tokens import joined, mix, pieces

BUCKETS, DIM, ORDERS = 1 << 16, 12, (2, 3, 4)
#: Distinct labelled texts that training may fetch for each language: a documented bound.
SAMPLE_PER_LANG = 400
#: Share of rightly predicted calibration rows that rejection may cost.
REJECT = 0.001
_LETTER: list[np.ndarray] = []
_MUL = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def subwords(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """By pieces: bucket of each subword, and the number of its text."""
    text, ends = joined([t.lower() for t in texts])
    for lo, cp in pieces(text, _letters()):
        first, last = np.searchsorted(ends, (lo, lo + len(cp) - 1), side="right")
        own = np.diff(np.clip(ends[first : last + 1], lo, lo + len(cp)), prepend=lo)
        doc = np.repeat(np.arange(first, last + 1, dtype=np.int32), own)
        letter = _letters()[cp]
        keep = letter.copy()
        keep[1:] |= letter[:-1]  # one space after each word
        c = np.where(letter, cp, 32)[keep].astype(np.uint64)
        doc = doc[keep]
        if not len(c):
            continue
        if c[-1] != 32:  # a run without an end, cut at the end of the piece
            c, doc = np.append(c, np.uint64(32)), np.append(doc, doc[-1])
        c = np.concatenate((np.array([32], np.uint64), c))
        doc = np.concatenate((doc[:1], doc))
        space = c == 32
        ids, docs = [], []
        for n in ORDERS:
            m = len(c) - n + 1
            if m <= 0:
                continue
            h = np.full(m, np.uint64(n))
            ok = np.ones(m, bool)
            for j in range(n):
                h = h * _MUL[0] + c[j : j + m] * _MUL[1 + j % 3]
                if 0 < j < n - 1:
                    ok &= ~space[j : j + m]  # a space only at either end
            ok &= ~(space[:m] & space[n - 1 : n - 1 + m]) if n == 2 else ok
            # a subword's text is that of its last character: the space before a text's first word is its predecessor's
            ids.append((mix(h[ok]) & np.uint64(BUCKETS - 1)).astype(np.int32))
            docs.append(doc[n - 1 : n - 1 + m][ok])
        yield np.concatenate(ids), np.concatenate(docs)


@dataclass
class LanguageModel:
    langs: list[str]
    table: np.ndarray  # buckets x languages
    bias: np.ndarray
    temperature: float = 1.0
    few: float = 0.0  # subwords at which confidence is halved
    least: float = 0.0

    def logits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Mean scores by text and language, and the number of subwords."""
        k = max(1, len(self.langs))
        total, count = np.zeros((len(texts), k)), np.zeros(len(texts), np.int64)
        for ids, doc in subwords(texts):
            lo, hi = (int(doc.min()), int(doc.max()) + 1) if len(doc) else (0, 0)
            count[lo:hi] += np.bincount(doc - lo, minlength=hi - lo)
            for j in range(len(self.langs)):
                total[lo:hi, j] += np.bincount(doc - lo, weights=self.table[ids, j], minlength=hi - lo)
        return total / np.maximum(count, 1)[:, None] + (self.bias if self.langs else 0), count

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, rejected) of each text."""
        z, n = self.logits(texts)
        p = softmax(sharpened(z, n, self.temperature, self.few))
        best, score = p.argmax(1), p.max(1)
        none = (n == 0) | (not self.langs)
        score = np.where(none, 0.0, score)
        return ["und" if u else self.langs[i] for i, u in zip(best.tolist(), none.tolist())], score, none | (score < self.least)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def sharpened(z: np.ndarray, n: np.ndarray, temperature: float, few: float) -> np.ndarray:
    """Calibrated scores: evidence counts in full only where there are many subwords."""
    return z * (n / (n + few + 1e-9) / temperature)[:, None]


def train(texts: list[str], langs: list[str], epochs: int = 6, rate: float = 4.0, seed: int = 1) -> LanguageModel:
    """Four of five rows train, the fifth calibrates."""
    names = sorted(set(langs))
    if not names:
        return LanguageModel([], np.zeros((BUCKETS, 1), np.float32), np.zeros(1))
    y = np.array([names.index(v) for v in langs])
    rows: list[tuple[np.ndarray, np.ndarray]] = []
    for t in texts:
        parts = [ids for ids, _ in subwords([t])]
        u, c = np.unique(np.concatenate(parts) if parts else np.zeros(0, np.int32), return_counts=True)
        rows.append((u, (c / max(1, c.sum())).astype(np.float32)))
    rng = np.random.default_rng(seed)
    e = (rng.standard_normal((BUCKETS, DIM)) / DIM).astype(np.float32)
    w, b = np.zeros((len(names), DIM), np.float32), np.zeros(len(names), np.float32)
    held = np.arange(len(rows)) % 5 == 4
    fit = np.flatnonzero(~held)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(fit):
            u, c = rows[i]
            if not len(u):
                continue
            v = c @ e[u]
            g = softmax((w @ v + b)[None])[0]
            g[y[i]] -= 1
            back = g @ w
            w -= step * 0.5 * np.outer(g, v)
            b -= step * 0.02 * g
            e[u] -= step * c[:, None] * back[None]
    model = LanguageModel(names, (e @ w.T).astype(np.float32), b.astype(np.float64))
    cal = np.flatnonzero(held)
    if len(cal):
        # calibration rows as they are, and three words from each: confidence must also be right for short texts
        whole = [texts[i] for i in cal]
        short = [" ".join(ws[j] for j in rng.integers(0, len(ws), 3)) for ws in (t.split() or [""] for t in whole)]
        z, n = model.logits(whole + short)
        t, ok = np.tile(y[cal], 2), n > 0
        if ok.any():
            loss = {(k, f): -np.log(np.maximum(softmax(sharpened(z[ok], n[ok], k, f))[np.arange(ok.sum()), t[ok]], 1e-12)).mean() for k in np.geomspace(0.005, 10, 40) for f in (0, 3, 10, 30, 100, 300)}
            model.temperature, model.few = map(float, min(loss, key=loss.get))
            ok[len(cal) :] = False
            p = softmax(sharpened(z[ok], n[ok], model.temperature, model.few))
            right = p.max(1)[p.argmax(1) == t[ok]]
            model.least = float(min(0.5, np.quantile(right, REJECT))) if len(right) else 0.0
    return model


def labelled_sample(docs: DataFrame, text_col: str, lang_col: str, learn, per_lang: int) -> tuple[list[str], list[str]]:
    """The per_lang distinct texts of each language with the least text hashes (all where there are fewer); whole texts.

    A first pass counts the distinct texts of each language roughly; the second keeps hashes below a language's cut,
    which lets about twice per_lang of them through, folds copies where they lie, and ranks inside the language. So
    neither a rare language beside large ones nor a text with many copies loses or takes more than its places.
    """
    rows = docs.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("l"), F.col(text_col).alias("t"), F.pmod(F.xxhash64(text_col), F.lit(1 << 62)).alias("h"))
    sizes = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.approx_count_distinct("h").alias("n")).collect()}  # a row a language
    if not sizes:
        return [], []
    cuts = docs.sparkSession.createDataFrame([(k, int((1 << 62) * min(1.0, (2.0 * per_lang + 100) / max(1, n)))) for k, n in sizes.items()], "l string, cut long")
    few = rows.join(F.broadcast(cuts), "l").where("h <= cut").groupBy("l", "h").agg(F.any_value("t").alias("t"))
    nth = F.row_number().over(Window.partitionBy("l").orderBy("h"))
    got = few.withColumn("n", nth).where(F.col("n") <= per_lang).orderBy("h", "l").collect()
    return [r["t"] for r in got], [r["l"] for r in got]


def fit(docs: DataFrame, learn=None, text_col: str = "text", lang_col: str = "lang", per_lang: int = SAMPLE_PER_LANG) -> LanguageModel:
    return train(*labelled_sample(docs, text_col, lang_col, F.lit(True) if learn is None else learn, per_lang))


_OUT = "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean"


def identify(docs: DataFrame, model: LanguageModel, held_out=None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score, rejected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, score, rejected = model.predict(b.column("body").to_pylist())
            yield pa.record_batch([b.column("doc_id"), b.column("held_out"), pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.lit(False) if held_out is None else held_out, F.lit(False)).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    return arrow_map(base, run, _OUT)


def keep_identified(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """Rows of docs that the model does not reject, with their columns unchanged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(~model.predict([t or "" for t in b.column(text_col).to_pylist()])[2]))

    return arrow_map(docs, run, docs.schema)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = crc_mod(F.col("doc_id"), 4) == 2
    return identify(docs, fit(docs, ~held), held)
