"""Ranked lexical search: an index of inverted treaps, traversed together for the best k documents of an item.

Terms are maximal stretches of ASCII letters (lower-cased), digits and characters beyond ASCII. The index lies in the shared
folder in blocks of bounded size: one row for each term of a block with the documents (ascending ids) and counts, and one
header row with the ids and lengths of the block's documents. Blocks are made where the documents are read; nothing is shuffled
to build it. A search reads the rows of the terms that are asked for, brings each block together, and gives each term
its treap: document ids in search order, impacts in heap order, so the root of a subtree has the greatest impact in it.

An interval of documents carries, for each term, the root of the part of its treap within the interval. The sum of these
impacts bounds every score in it; where the bound is below the k-th best score so far the interval goes. Else the document
of the largest impact splits it: its score is the sum over the treaps that hold it, and both sides descend to their own roots.
Intervals of one depth and of several items are worked on at once. A task carries its best k from block to block.

All arithmetic but the logarithm is in 64-bit integers, so scores do not depend on blocks, tasks or order. Items are searched
in blocks of bounded bytes, equal texts once; what is broadcast is one such block with its terms.

Defined cases: null and empty texts have no terms: such documents count nowhere and such items find nothing; documents with
equal ids are ranked each for itself; null ids come after all others of the same score; items with equal texts each get
the same rows; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestack.llm._spark import arrow_map, table
from lodestack.llm._tokens import group_stream, interned
from lodestack.shared import filesystem, shared_dir

#: Results of an item.
K = 20
#: Text bytes and documents of a block of the index; text bytes of a block of items; items traversed at once.
BLOCK_BYTES, BLOCK_DOCS, ITEM_BYTES, TOGETHER = 16 << 20, 8192, 8 << 20, 8
#: Bytes of postings that a search task should get.
TASK_BYTES = 64 << 20
#: Lower-cases ASCII letters and turns what separates terms into spaces.
_TERMS = bytes(c | 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: Rows of an output batch.
OUT_ROWS = 8192

_INDEX = "block long, term binary, df int, total long, nulls int, docs binary, counts binary"


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TERMS).split()


def weight(df: int, n_docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _slices(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Binary values: the bytes of values[cuts[i]:cuts[i + 1]]."""
    offsets = (cuts * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.tobytes())])


def _block(number: int, ids: list[int | None], each: list[np.ndarray], names: list[bytes]) -> Iterator[pa.RecordBatch]:
    """Index rows of a block: its header (the empty term), then a row for each term."""
    none = np.array([i is None for i in ids])
    values = np.array([i or 0 for i in ids], np.int64)
    order = np.lexsort((values, none))
    lengths = np.array([len(x) for x in each], np.int64)
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.arange(len(ids))
    key, counts = np.unique(np.concatenate(each).astype(np.int64) * len(ids) + np.repeat(rank, lengths), return_counts=True)
    term, doc = key // len(ids), (key % len(ids)).astype(np.int32)
    cuts = np.flatnonzero(np.diff(term, prepend=-1, append=-1)) if len(term) else np.zeros(1, np.int64)
    head = [[number], [b""], [int((lengths > 0).sum())], [int(lengths.sum())], [int(none.sum())], [values[order].tobytes()], [lengths[order].astype(np.int32).tobytes()]]
    kinds = [pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
    columns = [c.split()[0] for c in _INDEX.split(", ")]
    yield pa.record_batch([pa.array(v, t) for v, t in zip(head, kinds)], columns)
    n = len(cuts) - 1
    whole = pa.record_batch([pa.array(np.full(n, number)), pa.array(names, pa.binary()), pa.array(np.diff(cuts).astype(np.int32)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), _slices(doc, cuts), _slices(counts.astype(np.int32), cuts)], columns)
    for lo in range(0, n, OUT_ROWS):
        yield whole.slice(lo, OUT_ROWS)


def _index(block_bytes: int, block_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 24
        known: dict[bytes, int] = {}
        ids: list[int | None] = []
        each: list[np.ndarray] = []
        size = 0
        for b in batches:
            for i, text in zip(b.column("id").to_pylist(), b.column("body")):
                body = text.as_py() or b""
                ids.append(i)
                each.append(interned(body.translate(_TERMS), known))
                size += len(body)
                if size >= block_bytes or len(ids) >= block_docs:
                    yield from _block(number, ids, each, list(known))
                    known, ids, each, size, number = {}, [], [], 0, number + 1
        if ids:
            yield from _block(number, ids, each, list(known))

    return run


class Treaps:
    """The treaps of a block's terms in one set of arrays: document, impact, left and right child by posting; the root of each term."""

    def __init__(self, docs: list[np.ndarray], impacts: list[np.ndarray]):
        none = np.zeros(0, np.int64)
        self.doc = np.concatenate([*docs, none]).astype(np.int64)
        self.impact = np.concatenate([*impacts, none])
        left, right, self.root = [-1] * len(self.doc), [-1] * len(self.doc), np.full(len(docs), -1, np.int64)
        at, value = 0, self.impact.tolist()
        for t, d in enumerate(docs):
            path: list[int] = []  # from the root to the last document, always to the right
            for i in range(at, at + len(d)):
                below = -1
                while path and value[path[-1]] < value[i]:
                    below = path.pop()
                left[i] = below
                if path:
                    right[path[-1]] = i
                path.append(i)
            at += len(d)
            if path:
                self.root[t] = path[0]
        self.left, self.right = np.array(left, np.int64), np.array(right, np.int64)

    def descend(self, node: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The topmost node below (or at) each node whose document lies in [lo, hi); -1 where there is none."""
        node, live = node.copy(), np.flatnonzero(node >= 0)
        while len(live):
            at = node[live]
            d = self.doc[at]
            high, low = d >= hi[live], d < lo[live]
            node[live] = np.where(high, self.left[at], np.where(low, self.right[at], at))
            live = live[(high | low) & (node[live] >= 0)]
        return node


def traverse(treaps: Treaps, n_docs: int, items: list[list[tuple[int, int]]], k: int, held: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(documents, scores) of each item, of which none of its best k is missing.

    items: (term, weight) pairs; held: scores of documents elsewhere, which count for the k-th best one.
    """
    found: list[tuple[list, list]] = [([], []) for _ in items]
    best = [np.sort(h)[::-1][:k] for h in held]
    bar = np.array([int(b[k - 1]) if len(b) >= k else 1 for b in best], np.int64)
    pairs = [(i, t, w) for i, terms in enumerate(items) for t, w in terms if treaps.root[t] >= 0 and w > 0]
    own, term, weights = (np.array(x, np.int64) for x in (zip(*pairs) if pairs else ((), (), ())))
    node = treaps.root[term] if len(term) else term
    item = np.arange(len(items))
    lo, hi = np.zeros(len(items), np.int64), np.full(len(items), n_docs, np.int64)
    while len(own):
        value = weights * treaps.impact[node]
        starts = np.flatnonzero(np.diff(own, prepend=-1))
        bound = np.add.reduceat(value, starts)
        good = np.zeros(len(item), bool)
        good[own[starts]] = bound >= bar[item[own[starts]]]
        kept = good[own]
        own, node, weights, value = (np.cumsum(good) - 1)[own[kept]], node[kept], weights[kept], value[kept]
        item, lo, hi = item[good], lo[good], hi[good]
        if not len(own):
            break
        starts = np.flatnonzero(np.diff(own, prepend=-1))
        top = np.flatnonzero(value == np.maximum.reduceat(value, starts)[own])
        top = top[np.flatnonzero(np.diff(own[top], prepend=-1))]
        split = treaps.doc[node[top]]
        at = split[own]
        three = treaps.descend(np.concatenate((node, node, node)), np.concatenate((lo[own], at, at + 1)), np.concatenate((at, at + 1, hi[own])))
        before, here, after = np.split(three, 3)
        score = np.add.reduceat(np.where(here >= 0, weights * treaps.impact[here], 0), starts)
        for i in np.unique(item).tolist():
            mine = (item == i) & (score >= bar[i])
            if mine.any():
                found[i][0].append(split[mine])
                found[i][1].append(score[mine])
                best[i] = np.sort(np.concatenate((best[i], score[mine])))[::-1][:k]
                if len(best[i]) == k:
                    bar[i] = max(1, int(best[i][-1]))
        own = np.concatenate((2 * own[before >= 0], 2 * own[after >= 0] + 1))
        node, weights = np.concatenate((before[before >= 0], after[after >= 0])), np.concatenate((weights[before >= 0], weights[after >= 0]))
        item, lo, hi = np.repeat(item, 2), np.stack((lo, split + 1), 1).ravel(), np.stack((split, hi), 1).ravel()
        order = np.argsort(own, kind="stable")
        own, node, weights = own[order], node[order], weights[order]
    none = np.zeros(0, np.int64)
    return [(np.concatenate([*d, none]), np.concatenate([*s, none])) for d, s in found]


def impacts(counts: np.ndarray, lengths: np.ndarray, n_docs: int, total: int) -> np.ndarray:
    """What a term of weight 1 adds to the score of a document that holds it so many times."""
    m = 100 - 25 + (25 * lengths.astype(np.int64) * n_docs) // total
    tf = counts.astype(np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def _search(asked, k: int):
    """asked: broadcast (number of each term, weights, items as (term, weight) pairs, documents, words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, items, n_docs, total = asked.value
        best: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, bool), np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in items]
        for group in group_stream(batches, lambda b: b.column("block").to_numpy()):
            ids = lengths = nulls = None
            docs, values = [np.zeros(0, np.int32)] * len(numbers), [np.zeros(0, np.int64)] * len(numbers)
            for b in group:  # sorted by term: the header comes first
                for t, none, d, c in zip(*(b.column(n).to_pylist() for n in ("term", "nulls", "docs", "counts"))):
                    if t == b"":
                        ids, lengths, nulls = np.frombuffer(d, np.int64), np.frombuffer(c, np.int32), none
                    else:
                        own = np.frombuffer(d, np.int32)
                        docs[numbers[t]], values[numbers[t]] = own, impacts(np.frombuffer(c, np.int32), lengths[own], n_docs, total)
            treaps = Treaps(docs, values)
            for lo in range(0, len(items), TOGETHER):
                got = traverse(treaps, len(ids), items[lo : lo + TOGETHER], k, [s for _, _, s in best[lo : lo + TOGETHER]])
                for i, (d, s) in enumerate(got, lo):
                    if len(d):
                        none, doc, score = (np.concatenate(x) for x in zip(best[i], (d >= len(ids) - nulls, ids[d], s)))
                        first = np.lexsort((doc, none, -score))[:k]
                        best[i] = none[first], doc[first], score[first]
        for i, (none, doc, score) in enumerate(best):
            if len(doc):
                yield pa.record_batch([pa.array(np.full(len(doc), i, np.int32)), pa.array(doc, mask=none), pa.array(score)], ["item", "doc_id", "score"])

    return run


class RankedIndex:
    """An index in the shared folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @classmethod
    def build(cls, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, block_bytes: int = BLOCK_BYTES, block_docs: int = BLOCK_DOCS) -> RankedIndex:
        """Of every row of docs. Without a path it goes when the driver ends."""
        spark = docs.sparkSession
        if path is None:
            path = f"{shared_dir(spark)}/lodestack/ranked-index-{uuid.uuid4().hex}"
            fs, p = filesystem(spark, path)
            fs.deleteOnExit(p)
        base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("body"))
        arrow_map(base, _index(block_bytes, block_docs), _INDEX).write.option("compression", "zstd").parquet(path)
        return cls(spark, path)

    @property
    def rows(self) -> DataFrame:
        """block, term, df (documents of the block that hold it), docs and counts (int32); the empty term is a block's header: df documents with terms, total words, ids (int64) and lengths."""
        return self.spark.read.schema(_INDEX).parquet(self.path)

    def search(self, items: DataFrame, k: int = K, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
        """item_id, rank, doc_id, score: the k documents of the highest scores above 0 of each row of items, ties by ascending doc_id."""
        if k < 1:
            raise ValueError("k must be at least 1")
        spark = self.spark
        own = items.select(F.col(id_col).alias("item_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("body")).withColumn("key", F.sha2("body", 256))
        texts = own.groupBy("key").agg(F.any_value("body").alias("body"))
        size = texts.agg(F.coalesce(F.sum(F.octet_length("body") + 100), F.lit(0))).first()[0]
        parts = max(1, -(-size // ITEM_BYTES))
        found = None
        for part in range(parts):  # bounded blocks of items, by the digest of the text
            mine = texts.where(F.pmod(F.xxhash64("key"), F.lit(parts)) == part).collect()
            hits = self._best([(r["key"], bytes(r["body"])) for r in mine], k)
            found = hits if found is None else found.unionByName(hits)
        order = Window.partitionBy("key").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        return own.select("item_id", "key").join(ranked, "key").select("item_id", "rank", "doc_id", "score")

    def _best(self, texts: list[tuple[str, bytes]], k: int) -> DataFrame:
        """(key, doc_id, score), of which none of the best k of a key is missing."""
        spark = self.spark
        counted = [Counter(terms_of(t)) for _, t in texts]
        numbers = {t: i for i, t in enumerate(sorted(set().union(*counted)))}
        terms = F.broadcast(spark.createDataFrame([(t,) for t in (b"", *numbers)], "term binary"))
        rows = self.rows.join(terms, "term", "left_semi")
        stats = rows.groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"), F.sum(F.octet_length("docs").cast("long")).alias("bytes")).collect()
        df = {bytes(r["term"]): r["df"] for r in stats}
        n_docs, total = df.get(b"", 0), sum(r["total"] or 0 for r in stats)
        weights = {t: weight(n, n_docs) for t, n in df.items() if t}
        pairs = [[(numbers[t], weights[t] * c) for t, c in sorted(ts.items()) if weights.get(t, 0) > 0] for ts in counted]
        asked = spark.sparkContext.broadcast((numbers, pairs, n_docs, total))
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-2 * sum(r["bytes"] for r in stats) // TASK_BYTES))
        place = F.pmod(F.shiftright("block", 24) + F.col("block").bitwiseAND((1 << 24) - 1), F.lit(tasks)).cast("int")
        dealt = rows.select("block", "term", "nulls", "docs", "counts", place.alias("place")).repartitionById(tasks, F.col("place")).sortWithinPartitions("block", "term")
        best = arrow_map(dealt.drop("place"), _search(asked, k), "item int, doc_id long, score long")
        keys = F.broadcast(spark.createDataFrame([(i, key) for i, (key, _) in enumerate(texts)], "item int, key string"))
        return best.join(keys, "item").select("key", "doc_id", "score")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return RankedIndex.build(table(spark, sf_dir, "documents")).search(table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, text FROM documents
), t AS (
  SELECT r, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), p AS (
  SELECT r, any_value(doc_id) AS doc_id, term, count(*) AS tf FROM t GROUP BY r, term
), n AS (
  SELECT r, sum(tf)::BIGINT AS n FROM p GROUP BY r
), s AS (
  SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM n
), w AS (
  SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, s GROUP BY term
), q AS (
  SELECT item_id, term, count(*) AS c FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY item_id, term
), scored AS (
  SELECT q.item_id, p.r, any_value(p.doc_id) AS doc_id,
         sum(q.c * w.w * ((1000000000 * p.tf) // (1000 * p.tf + 12 * (100 - 25 + (25 * n.n * s.docs) // s.words))))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN p USING (term) JOIN n ON n.r = p.r, s GROUP BY q.item_id, p.r
)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 20
"""
