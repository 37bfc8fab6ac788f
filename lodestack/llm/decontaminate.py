"""Benchmark decontamination: BM25 over an inverted index of test items, searched by block-max WAND.

Items are indexed by words. Impacts are BM25 weights divided by the item's score for itself, so one
threshold serves all items: a passage that holds every word of an item scores 1. Every document is
cut into overlapping passages of two strides, a stride being at least as long as any item of its
length class, so that an item that occurs lies within one passage whole. For each passage all items at
or above the threshold are retrieved, and a retrieved item is verified by the shares of its five-word shingles
that occur in the passage: of its question (all sentences but the last) and its answer (the last one). It counts when
the question is there (0.8), when a part of the question (0.3) stands with its answer (0.5), or half of the item in all.

Most passages can be dismissed without a search: an item's words of least impact, up to a small share
of its score, are its non-essential ones; a passage whose essential words of an item, each counted once,
plus all its non-essential ones, stay below the threshold cannot hold it. That bound is computed for whole batches.
Passages that pass it for some item are searched by block-max WAND, which gives exact results.

An item whose question carries little of its weight stays below the threshold where the question stands
without the answer, so passages are also found by shingles: one that holds k of a unit's m shingles
(a unit is an item or a question) holds one of any m - k + 1 of them, and the rarest ones are looked up.
With both, a pair is reported exactly when those shares say so.

Items are indexed in blocks of bounded size (one for usual benchmarks), so what is broadcast is bounded; all blocks
have the BM25 statistics of all items. Where there are several blocks, the words of the documents are found once,
written to the shared folder, and searched block by block.

Defined cases: null and empty texts have no passages; null, empty and wordless items match nothing;
an item of one to four words counts wherever they stand in a row; a question of one to four words
that is not the whole item would tell too little and counts only where a passage has no other words; an answer of
one to four words is looked for as these words in a row;
repeated items and rows are reported each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm._spark import arrow_map, table, written
from lodestack.llm._tokens import shingles, words

K1, B, THRESHOLD, SPARE = 1.2, 0.75, 0.4, 0.1
#: Shares of shingles that verify: of the whole item, of the question alone, or of a part of the question with the answer.
OVERLAP, QUESTION_OVERLAP, QUESTION_PART, ANSWER_OVERLAP = 0.5, 0.8, 0.3, 0.5
#: Items indexed at once, postings in a block, the shortest stride in words, words in a shingle, and words whose shingles are looked up at once.
ITEM_BLOCK, POSTING_BLOCK, STRIDE, SHINGLE, SPAN = 20_000, 8, 64, 5, 1 << 18


def question_and_answer(text: str) -> tuple[str, str]:
    """All sentences but the last, and the last; a single sentence is the question."""
    parts = [p for p in re.split(r"(?<=[.?!])\s+", text.strip()) if re.search(r"\w", p)]
    return (" ".join(parts[:-1]), parts[-1]) if len(parts) > 1 else (" ".join(parts), "")


def verified(overlap: float, question: float, answer: float) -> bool:
    return overlap >= OVERLAP or question >= QUESTION_OVERLAP or (question >= QUESTION_PART and answer >= ANSWER_OVERLAP)


class Stats:
    """What BM25 weights need of all items that have words: their number, average length and document frequencies."""

    def __init__(self):
        self.n, self.words, self.df = 0, 0, Counter()

    def add(self, texts: list[str]) -> Stats:
        h, cuts = words(texts)
        self.n += int((np.diff(cuts) > 0).sum())
        self.words += len(h)
        for a, b in zip(cuts, cuts[1:]):
            self.df.update(set(h[a:b].tolist()))
        return self

    @property
    def average(self) -> float:
        return max(1.0, self.words / max(1, self.n))


class Grams:
    """Postings of the rarest shingles of units (item, shingles, least overlap): as many as no passage can lack that reaches it."""

    def __init__(self, units: list[tuple[int, np.ndarray, float]], n: int):
        self.n = n
        df = Counter(g for _, own, _ in units for g in own.tolist())
        lists: dict[int, set[int]] = {}
        for i, own, least in units:
            m = len(own)
            k = next(k for k in range(1, m + 1) if k / m >= least)
            for g in sorted(own.tolist(), key=lambda g: (df[g], g))[: m - k + 1]:
                lists.setdefault(g, set()).add(i)
        self.grams = np.array(sorted(lists), np.uint64)
        own = [sorted(lists[g]) for g in sorted(lists)]
        self.first = np.concatenate(([0], np.cumsum([len(x) for x in own]))).astype(np.int64)
        self.item = np.array([i for x in own for i in x], np.int64)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.grams & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def passages(self, h: np.ndarray, cuts: np.ndarray, stride: int) -> np.ndarray:
        """(document, stride number, item) of passages that may hold a unit."""
        where, gram = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for lo in range(0, len(h) - self.n + 1 if len(self.grams) else 0, SPAN):
            s = shingles(h[lo : lo + SPAN + self.n - 1], self.n)
            at = np.flatnonzero(self.maybe[(s & np.uint64((1 << 20) - 1)).astype(np.int64)])
            g = np.minimum(np.searchsorted(self.grams, s[at]), len(self.grams) - 1)
            ok = self.grams[g] == s[at]
            where.append(at[ok] + lo)
            gram.append(g[ok])
        where, gram = np.concatenate(where), np.concatenate(gram)
        doc = np.searchsorted(cuts, where, side="right") - 1
        ok = where + self.n <= cuts[doc + 1]  # within one text
        where, gram, doc = where[ok], gram[ok], doc[ok]
        place = where - cuts[doc]
        both = place % stride + self.n <= stride  # ends in the stride where it starts, so the passage before holds it too
        cell = np.concatenate((place // stride, (place // stride - 1)[both]))
        doc, gram = np.concatenate((doc, doc[both])), np.concatenate((gram, gram[both]))
        n = self.first[gram + 1] - self.first[gram]
        at = np.repeat(self.first[gram] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.unique(np.stack((np.repeat(doc, n), np.repeat(cell, n), self.item[at]), 1), axis=0)


class Index:
    """Inverted index of items whose length in words is at most `stride`."""

    def __init__(self, items: list[tuple[int | None, str]], stride: int, threshold: float, stats: Stats):
        self.stride, self.threshold = stride, threshold
        self.ids = [i for i, _ in items]
        h, cuts = words([t for _, t in items])
        self.parts, units = [], {n: [] for n in range(1, SHINGLE + 1)}
        self.sizes = []  # words in a shingle of an item, of its question (fewer only for a whole item of few words) and of its answer
        for i, (_, t) in enumerate(items):
            q, a = question_and_answer(t)
            w, c = words([t, q, a])
            self.parts.append(tuple(np.unique(shingles(w[c[k] : c[k + 1]])) for k in range(3)))
            size = min(SHINGLE, int(c[1]))
            self.sizes.append((size, SHINGLE if len(w) > c[2] else size, min(SHINGLE, max(1, int(c[3] - c[2])))))
            units[size].append((i, self.parts[i][0], OVERLAP))
            # the question, at the least share that any rule asks of it: what the passage holds of the answer is seen then
            if c[2] - c[1] >= SHINGLE:
                units[SHINGLE].append((i, self.parts[i][1], QUESTION_PART if c[3] > c[2] else QUESTION_OVERLAP))
        self.grams = [Grams(own, n) for n, own in units.items() if own]
        n, average, df = stats.n, stats.average, stats.df
        tfs = [Counter(h[a:b].tolist()) for a, b in zip(cuts, cuts[1:])]
        vocabulary = sorted({t for tf in tfs for t in tf})
        at = {t: k for k, t in enumerate(vocabulary)}
        self.vocabulary = np.array(vocabulary, np.uint64)
        self.own: list[tuple[np.ndarray, np.ndarray]] = []  # terms and impacts of each item
        lists: list[list[tuple[int, float]]] = [[] for _ in vocabulary]
        essential: list[list[tuple[int, float]]] = [[] for _ in vocabulary]
        self.spare = np.zeros(len(items))  # what an item's non-essential words can give
        for i, tf in enumerate(tfs):
            length = sum(tf.values())
            impact = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * f * (K1 + 1) / (f + K1 * (1 - B + B * length / average)) for t, f in tf.items()}
            own = sum(impact.values())
            self.own.append((np.array([at[t] for t in impact], np.int64), np.array([v / own for v in impact.values()])))
            rest = 0.0
            for t in sorted(impact, key=lambda t: (impact[t], t)):
                v = impact[t] / own
                lists[at[t]].append((i, v))
                if rest + v <= SPARE * threshold / THRESHOLD:
                    rest += v
                else:
                    essential[at[t]].append((i, v))
            self.spare[i] = rest
        pack = lambda ls: (np.concatenate(([0], np.cumsum([len(x) for x in ls]))).astype(np.int64), np.array([i for x in ls for i, _ in x], np.int64), np.array([v for x in ls for _, v in x]))
        self.all, self.key = pack(lists), pack(essential)
        self.most = np.array([max((v for _, v in x), default=0.0) for x in lists])
        self.block_max = [[max(v for _, v in x[b : b + POSTING_BLOCK]) for b in range(0, len(x), POSTING_BLOCK)] for x in lists]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.vocabulary & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def terms(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions of words in the vocabulary, their terms)."""
        where = np.flatnonzero(self.maybe[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
        t = np.searchsorted(self.vocabulary, h[where])
        ok = self.vocabulary[np.minimum(t, len(self.vocabulary) - 1)] == h[where]
        return where[ok], t[ok]

    def passages(self, h: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """(document, stride number) of passages that may hold an item at the threshold."""
        if not len(h) or not len(self.vocabulary):
            return np.zeros((0, 2), np.int64)
        where, term = self.terms(h)
        first, item, value = self.key
        n = first[term + 1] - first[term]
        where, term, n = where[n > 0], term[n > 0], n[n > 0]
        if not len(where):
            return np.zeros((0, 2), np.int64)
        doc = np.searchsorted(cuts, where, side="right") - 1
        bins_before = np.concatenate(([0], np.cumsum(np.diff(cuts) // self.stride + 2)))
        cell = bins_before[doc] + (where - cuts[doc]) // self.stride + 1
        # a passage is a stride and the one after it: each hit counts for two passages, once however often it occurs
        size = np.int64(len(self.vocabulary))
        pair = np.unique(np.concatenate((cell, cell - 1)) * size + np.tile(term, 2))
        cell, term = pair // size, pair % size
        n = first[term + 1] - first[term]
        at = np.repeat(first[term] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        keys, inverse = np.unique(np.repeat(cell, n) * len(self.ids) + item[at], return_inverse=True)
        bound = np.bincount(inverse, weights=value[at]) + self.spare[keys % len(self.ids)]
        cells = np.unique(keys[bound >= self.threshold - 1e-9] // len(self.ids))
        doc = np.searchsorted(bins_before, cells, side="right") - 1
        return np.stack((doc, cells - bins_before[doc] - 1), 1)

    def search(self, h: np.ndarray) -> list[tuple[int, float]]:
        """All (item, score) at or above the threshold for the words of a passage, by block-max WAND."""
        first, item, value = self.all
        cursors = [[int(first[t]), int(first[t + 1]), int(first[t]), t] for t in np.unique(self.terms(h)[1]).tolist()]
        out, least = [], self.threshold - 1e-9
        while cursors:
            cursors.sort(key=lambda c: item[c[0]])
            total, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                total += self.most[c[3]]
                if total >= least:
                    pivot = k
                    break
            if pivot < 0:
                break
            d = int(item[cursors[pivot][0]])
            while pivot + 1 < len(cursors) and item[cursors[pivot + 1][0]] == d:
                pivot += 1
            bound, until = 0.0, len(self.ids)
            for c in cursors[: pivot + 1]:
                # shallow move: the block that would hold d
                b = (c[0] - c[2]) // POSTING_BLOCK
                blocks = self.block_max[c[3]]
                while b < len(blocks) and item[min(c[1], c[2] + (b + 1) * POSTING_BLOCK) - 1] < d:
                    b += 1
                if b < len(blocks):
                    bound += blocks[b]
                    until = min(until, int(item[min(c[1], c[2] + (b + 1) * POSTING_BLOCK) - 1]) + 1)
            if bound >= least:
                score, target = 0.0, d + 1
                for c in cursors[: pivot + 1]:
                    while c[0] < c[1] and item[c[0]] < d:
                        c[0] += 1
                    if c[0] < c[1] and item[c[0]] == d:
                        score += value[c[0]]
                if score >= least:
                    out.append((d, float(score)))
            else:  # no item of these blocks can reach the threshold with these terms alone
                target = max(d + 1, min([until, *(int(item[c[0]]) for c in cursors[pivot + 1 :])]))
            for c in cursors[: pivot + 1]:
                while c[0] < c[1] and item[c[0]] < target:
                    c[0] += 1
            cursors = [c for c in cursors if c[0] < c[1]]
        return out

    def score(self, h: np.ndarray, i: int) -> float:
        """Score of an item for the words of a passage."""
        term, value = self.own[i]
        return float(value[np.isin(term, self.terms(h)[1])].sum())


def share(part: np.ndarray, seen: np.ndarray) -> float:
    return float(np.isin(part, seen, assume_unique=True).mean()) if len(part) else 0.0


def matches(indexes: list[Index], texts: list[str]) -> Iterator[tuple[int, int | None, float, float, float, float]]:
    """(text number, item id, BM25 share, overlaps of item, question and answer), the best passage of each pair."""
    yield from found_in(indexes, *words(texts))


def found_in(indexes: list[Index], h: np.ndarray, cuts: np.ndarray) -> Iterator[tuple[int, int | None, float, float, float, float]]:
    """matches() of texts given by their words."""
    for index in indexes:
        best: dict[tuple[int, int], tuple[float, float, float, float]] = {}
        weighty = set(map(tuple, index.passages(h, cuts).tolist()))
        held: dict[tuple[int, int], list[int]] = {}
        for grams in index.grams:
            for doc, cell, i in grams.passages(h, cuts, index.stride).tolist():
                held.setdefault((doc, cell), []).append(i)
        for doc, cell in sorted(weighty | held.keys()):
            lo = cuts[doc] + max(0, cell) * index.stride
            passage = h[lo : min(cuts[doc + 1], cuts[doc] + (cell + 2) * index.stride)]
            found = index.search(passage) if (doc, cell) in weighty else []
            known = {i for i, _ in found}
            found += [(i, None) for i in held.get((doc, cell), ()) if i not in known]
            seen: dict[int, np.ndarray] = {}
            for i, score in found:
                for n in index.sizes[i]:
                    if n not in seen:
                        seen[n] = np.unique(shingles(passage, n))
                overlap, question, answer = (share(p, seen[n]) for p, n in zip(index.parts[i], index.sizes[i]))
                if verified(overlap, question, answer):
                    best[doc, i] = max(best.get((doc, i), (-1.0,) * 4), (overlap, question, answer, index.score(passage, i) if score is None else score))
        for (doc, i), (overlap, question, answer, score) in sorted(best.items()):
            yield doc, index.ids[i], round(score, 9), overlap, question, answer


def build(items: list[tuple[int | None, str]], threshold: float = THRESHOLD, stats: Stats | None = None) -> list[Index]:
    """One index for each length class that has items; stats: those of all items where these are some of them."""
    stats = stats or Stats().add([t or "" for _, t in items])
    by: dict[int, list] = {}
    for i, t in items:
        n = int(words([t])[1][-1]) if t else 0
        if n:
            stride = STRIDE
            while stride < n:
                stride *= 4
            by.setdefault(stride, []).append((i, t))
    return [Index(own, stride, threshold, stats) for stride, own in sorted(by.items())]


class Items:
    """Test items (i, t) dealt into blocks of about item_block; all indexes have the statistics of all items."""

    def __init__(self, items: DataFrame, item_block: int, threshold: float):
        self.items, self.threshold, self.stats = items, threshold, Stats()
        self.blocks = max(1, -(-items.count() // item_block))
        self.only = None
        for k in range(self.blocks):
            own = self._block(k)
            self.stats.add([t for _, t in own])
            self.only = own if self.blocks == 1 else None

    def _block(self, k: int) -> list[tuple[int | None, str]]:
        rows = self.items.where(F.pmod(F.xxhash64("i", "t"), F.lit(self.blocks)) == k).collect()
        return sorted(((r["i"], r["t"]) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))

    def indexes(self, k: int) -> list[Index]:
        return build(self.only if self.only is not None else self._block(k), self.threshold, self.stats)


def _worded(base: DataFrame, keep: list[str]) -> DataFrame:
    """base with the words of `body` (hashes, as `words`) in its place, in the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, cuts = words(b.column("body").to_pylist())
            yield pa.record_batch([*(b.column(c) for c in keep), pa.LargeListArray.from_arrays(pa.array(cuts), pa.array(h.view(np.int64))).cast(pa.list_(pa.int64()))], [*keep, "words"])

    types = dict(base.dtypes)
    return written(arrow_map(base, run, ", ".join(f"{c} {types[c]}" for c in keep) + ", words array<long>"), "passage-words")


def _words_of(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Words of a batch, from `body` or from `words`."""
    if "body" in b.schema.names:
        return words(b.column("body").to_pylist())
    lists = b.column("words")
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    return lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)


_OUT = "doc_id long, text_hash long, item_id long, bm25_share double, overlap double, question_overlap double, answer_overlap double"


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", item_block: int = ITEM_BLOCK, threshold: float = THRESHOLD) -> DataFrame:
    """A row for each document and test item that it holds: doc_id, text_hash, item_id, bm25_share, overlap, question_overlap, answer_overlap."""
    own = Items(items.select(F.col(item_id_col).cast("long").alias("i"), F.coalesce(F.col(item_text_col), F.lit("")).alias("t")), item_block, threshold)
    body = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(body).alias("text_hash"), body.alias("body"))
    if own.blocks > 1:
        base = _worded(base, ["doc_id", "text_hash"])
    out = None
    for k in range(own.blocks):
        indexes = own.indexes(k)

        def run(batches: Iterator[pa.RecordBatch], indexes=indexes) -> Iterator[pa.RecordBatch]:
            for b in batches:
                got = list(found_in(indexes, *_words_of(b)))
                if got:
                    at = pa.array([g[0] for g in got])
                    yield pa.record_batch([b.column("doc_id").take(at), b.column("text_hash").take(at), pa.array([g[1] for g in got], pa.int64()), *(pa.array([g[j] for g in got], pa.float64()) for j in range(2, 6))], ["doc_id", "text_hash", "item_id", "bm25_share", "overlap", "question_overlap", "answer_overlap"])

        part = arrow_map(base, run, _OUT)
        out = part if out is None else out.unionByName(part)
    return out


def keep_clean(docs: DataFrame, items: DataFrame, text_col: str = "text", threshold: float = THRESHOLD, item_block: int = ITEM_BLOCK) -> DataFrame:
    """Rows of docs that hold no test item; columns unchanged, whatever their names."""
    own = Items(items.select(F.col("item_id").cast("long").alias("i"), F.coalesce("text", F.lit("")).alias("t")), item_block, threshold)
    if own.blocks > 1:  # texts that hold an item, by hash, from the search of all blocks
        gone = contaminated(docs.select(F.lit(0).alias("doc_id"), F.col(text_col).alias("text")), items, item_block=item_block, threshold=threshold).select("text_hash").distinct()
        whole = docs.select(F.struct("*").alias("r"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("h"))
        return whole.join(gone, F.col("h") == F.col("text_hash"), "left_anti").select(*(F.col("r")[c].alias(c) for c in docs.columns))
    indexes = own.indexes(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bad = {m[0] for m in matches(indexes, [t or "" for t in b.column(text_col).to_pylist()])}
            yield b.filter(pa.array([i not in bad for i in range(b.num_rows)], pa.bool_()))

    return arrow_map(docs, run, docs.schema)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")
