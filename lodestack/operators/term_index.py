"""Inverted index of a corpus in a folder: positional postings in segments, with tombstones and merges.

A segment holds the postings of some documents (term, key, tokens of the document, a count and the positions by field), made batch by
batch where the documents are read and sorted by term, so that a query reads the row groups of its terms alone, and one row for each of its documents. An update writes a
segment of the changed documents and a tombstone (key, upto) for each key that it replaces or removes; a tombstone hides its key in
all segments numbered below it. What an index consists of is a state of `Versions`: readers see the segments of one state, writers publish the
next one when all its files are there, and a writer that is lost leaves the index as it was. Numbers of documents and tokens
are kept by state, less those that tombstones hide, so statistics are those of the live documents.

`merge` rewrites the smallest segments as one when there are more than `fan`, without what is hidden, and the tombstones as one
table; `compact` does so with all segments. Files of earlier states go with `vacuum`.

Keys are unique and not null; rows that share a key within an update count as documents of their own until it is replaced.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.functions import text as T
from lodestack.shared import arrow_limits, dropped, filesystem, spread, written
from lodestack.shipping import ship
from lodestack.versions import Versions

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Segments beyond which merge() rewrites the smallest.
FAN = 8


def _postings(n_fields: int):
    """Postings of the documents of each Arrow batch, whose tokens come as lists, and a row without a term for each document: nothing has to meet beyond one."""
    names = ["term", "key", "len", *(f"f{f}" for f in range(n_fields)), *(f"p{f}" for f in range(n_fields))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            void = lambda t: pa.nulls(b.num_rows, t)  # noqa: B023, E731
            yield pa.record_batch([void(pa.string()), b.column("key"), b.column("len"), *(void(pa.int32()) for _ in range(n_fields)), *(void(pa.list_(pa.int32())) for _ in range(n_fields))], names)
            flat, docs, at, fields = [], [], [], []
            for f in range(n_fields):
                col = b.column(f"t{f}")
                sizes = pc.list_value_length(col).to_numpy(zero_copy_only=False).astype(np.int64)
                flat.append(col.flatten())
                docs.append(np.repeat(np.arange(b.num_rows), sizes))
                at.append(np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes))
                fields.append(np.full(int(sizes.sum()), f))
            words = pa.concat_arrays(flat).dictionary_encode()
            if not len(words):
                continue
            code, doc, at, field = words.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate(docs), np.concatenate(at), np.concatenate(fields)
            key = doc * len(words.dictionary) + code
            order = np.argsort(key, kind="stable")  # by document and term; fields and places stay in order
            starts = np.flatnonzero(np.diff(key[order], prepend=-1))
            first = order[starts]
            own = pa.array(doc[first])
            counts, places = [], []
            for f in range(n_fields):
                mine = field[order] == f
                n = np.add.reduceat(mine.astype(np.int32), starts)
                counts.append(pa.array(n.astype(np.int32)))
                places.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), pa.array(at[order][mine].astype(np.int32))))
            yield pa.record_batch([words.dictionary.take(pa.array(code[first])), b.column("key").take(own), b.column("len").take(own), *counts, *places], names)

    return run


def _shifted(j: int):
    return lambda at: at - j


def _taken(starts: Column, words: int) -> Column:
    """How many of the places (ascending) a scan from the left finds that goes on behind each match."""
    step = lambda acc, s: F.when(s >= acc["free"], F.struct((s + words).alias("free"), (acc["n"] + 1).alias("n"))).otherwise(acc)
    return F.aggregate(starts, F.struct(F.lit(0).alias("free"), F.lit(0).alias("n")), step, lambda acc: acc["n"])


class TermIndex:
    """An index in a folder: `versions` (its states), `segments`, each with `postings` and `docs`, and `tombs`."""

    def __init__(self, spark: SparkSession, folder: str, fields: list[str]):
        self.spark, self.folder, self.fields = spark, folder.rstrip("/"), fields
        self.versions = Versions(spark, f"{self.folder}/versions")

    @classmethod
    def build(cls, docs: DataFrame, key: str, fields: list[str], folder: str) -> TermIndex:
        """A new state with one segment, whatever the folder held before."""
        out = cls(docs.sparkSession, folder, fields)
        number, _ = out.versions.latest()
        segment = out._segment(docs, key, number + 1)
        out.versions.publish(number + 1, {"segments": [segment], "tombs": [], "docs": segment["docs"], "tokens": segment["tokens"]})
        return out

    def _path(self, kind: str, seq: int) -> str:
        return f"{self.folder}/{kind}/{seq:012d}-{uuid.uuid4().hex[:12]}"

    def _segment(self, docs: DataFrame, key: str, seq: int) -> dict:
        """Writes a segment; its row of the state."""
        path = self._path("segments", seq)
        k = range(len(self.fields))
        rows = spread(docs).where(F.col(key).isNotNull()).select(F.col(key).alias("key"), *(T.tokens(F.coalesce(F.col(f).cast("string"), F.lit(""))).alias(f"t{i}") for i, f in enumerate(self.fields)))
        rows = rows.withColumn("len", sum((F.size(f"t{i}") for i in k), F.lit(0)))
        arrow_limits(self.spark)
        ship(self.spark)
        kind = dict(rows.dtypes)["key"]
        post = rows.mapInArrow(_postings(len(self.fields)), f"term string, key {kind}, len int, " + ", ".join([*(f"f{i} int" for i in k), *(f"p{i} array<int>" for i in k)]))
        staged = written(post, "postings")  # texts are cut into tokens once, although ranges are sampled before they are cut
        staged.where("term IS NULL").select("key", "len").write.parquet(f"{path}/docs")
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        staged.where("term IS NOT NULL").repartitionByRange(n, "term", "key").sortWithinPartitions("term", "key").write.parquet(f"{path}/postings")
        dropped(staged)
        return {"seq": seq, "path": path, **self._size(self.spark.read.parquet(f"{path}/docs"))}

    @staticmethod
    def _size(docs: DataFrame) -> dict:
        n, tokens = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum("len"), F.lit(0))).first()
        return {"docs": n, "tokens": tokens}

    def state(self) -> dict:
        number, state = self.versions.latest()
        if state is None:
            raise FileNotFoundError(f"no index in {self.folder}")
        return state | {"number": number}

    def _live(self, state: dict, table: str, segments: list[dict] | None = None, where=None) -> DataFrame:
        """Rows of `postings` or `docs` that no tombstone hides, with their segment's number."""
        segments = state["segments"] if segments is None else segments
        where = where or (lambda df: df)
        rows = reduce(DataFrame.unionByName, (where(self.spark.read.parquet(f"{s['path']}/{table}")).withColumn("seq", F.lit(s["seq"]).cast("long")) for s in segments))
        if not state["tombs"]:
            return rows
        return rows.join(self._hidden(state), "key", "left").where("upto IS NULL OR seq >= upto").drop("upto")

    def _hidden(self, state: dict) -> DataFrame:
        """key, upto: the latest tombstone of each key."""
        return self.spark.read.parquet(*state["tombs"]).groupBy("key").agg(F.max("upto").alias("upto"))

    def update(self, changed: DataFrame, key: str, removed: DataFrame | None = None) -> None:
        """Documents of changed replace those of their keys or come new; those of removed (key) go. Writes what changed, no more."""
        state = self.state()
        seq = state["number"] + 1
        segment = self._segment(changed, key, seq)
        keys = self.spark.read.parquet(f"{segment['path']}/docs").select("key")
        if removed is not None:
            keys = keys.unionByName(removed.select(F.col(key).alias("key")).where("key IS NOT NULL"))
        keys = keys.distinct()
        hides = self._live(state, "docs").join(keys, "key", "left_semi")
        tombs = self._path("tombs", seq)
        hides.select("key").distinct().withColumn("upto", F.lit(seq).cast("long")).write.parquet(tombs)  # only for keys that an earlier segment has
        lost = self._size(hides)
        self.versions.publish(seq, {"segments": [*state["segments"], segment], "tombs": [*state["tombs"], tombs], "docs": state["docs"] + segment["docs"] - lost["docs"], "tokens": state["tokens"] + segment["tokens"] - lost["tokens"]})

    def merge(self, fan: int = FAN) -> bool:
        """Rewrites the smaller half of the segments as one where there are more than `fan`; whether it did."""
        state = self.state()
        if len(state["segments"]) <= max(1, fan):
            return False
        by_size = sorted(state["segments"], key=lambda s: (s["docs"], s["seq"]))
        self._merged(state, by_size[: max(2, len(by_size) // 2)])
        return True

    def compact(self) -> None:
        """All segments as one, without tombstones."""
        state = self.state()
        self._merged(state, state["segments"])

    def _merged(self, state: dict, chosen: list[dict]) -> None:
        """The new segment has the last number: all tombstones have been applied to it. Those that no older segment needs go."""
        seq = state["number"] + 1
        path = self._path("segments", seq)
        self._live(state, "docs", chosen).drop("seq").write.parquet(f"{path}/docs")
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self._live(state, "postings", chosen).drop("seq").repartitionByRange(n, "term", "key").sortWithinPartitions("term", "key").write.parquet(f"{path}/postings")
        rest, tombs = [s for s in state["segments"] if s not in chosen], []
        if rest and state["tombs"]:
            tombs = [self._path("tombs", seq)]
            self._hidden(state).where(F.col("upto") > min(s["seq"] for s in rest)).write.parquet(tombs[0])
        merged = {"seq": seq, "path": path, **self._size(self.spark.read.parquet(f"{path}/docs"))}
        self.versions.publish(seq, state | {"segments": [*rest, merged], "tombs": tombs})

    def vacuum(self) -> int:
        """Deletes files and states that the current state does not have; how many folders. Only where nobody reads an earlier state."""
        state, n = self.state(), 0
        used = {p.rsplit("/", 1)[-1] for p in [*(s["path"] for s in state["segments"]), *state["tombs"]]}
        for kind in ("segments", "tombs"):
            fs, root = filesystem(self.spark, f"{self.folder}/{kind}")
            for f in fs.listStatus(root) if fs.exists(root) else []:
                if f.getPath().getName() not in used:
                    fs.delete(f.getPath(), True)
                    n += 1
        self.versions.prune(1)
        return n

    def search(self, terms: list[str], weights: list[float], prefix: bool = False, every: bool = False) -> DataFrame:
        """key, score: as search.bm25, phrases (terms with slashes or dashes) included.

        Counts are enough for single words; only the words of phrases read positions. A phrase's words are intersected on
        positions moved by their place in it, field by field; overlapping places count as a scan from the left finds them.
        """
        state = self.state()
        words = [[w for w in re.split("[/-]+", t) if w] for t in terms]
        if not any(words):
            return self._live(state, "docs").select("key", F.lit(0.0).alias("score")).limit(0)
        fields = range(len(self.fields))
        test = lambda w, last: F.col("term").startswith(w) if prefix and last else F.col("term") == w
        slots = [(i, j, test(w, j == len(ws) - 1)) for i, ws in enumerate(words) for j, w in enumerate(ws)]
        hit = reduce(Column.__or__, (m for _, _, m in slots))
        own = self._live(state, "postings", where=lambda df: df.where(hit))
        sums, arrays = [], []
        for i, j, m in slots:
            for f in fields:
                if len(words[i]) == 1:
                    sums.append(F.coalesce(F.sum(F.when(m, F.col(f"f{f}"))), F.lit(0)).alias(f"n_{i}_{f}"))
                else:
                    arrays.append(F.array_sort(F.flatten(F.collect_list(F.when(m, F.col(f"p{f}"))))).alias(f"a_{i}_{j}_{f}"))
        by = own.groupBy("key", "seq", "len").agg(*sums, *arrays)

        def count(i: int, f: int) -> Column:
            if not words[i]:
                return F.lit(0)
            if len(words[i]) == 1:
                return F.col(f"n_{i}_{f}")
            at = F.col(f"a_{i}_0_{f}")
            for j in range(1, len(words[i])):
                at = F.array_intersect(at, F.transform(f"a_{i}_{j}_{f}", _shifted(j)))
            return _taken(at, len(words[i]))

        k = range(len(terms))
        by = by.select("key", "len", *(count(i, f).alias(f"c_{i}_{f}") for i in k for f in fields))
        hits = lambda i: sum((F.col(f"c_{i}_{f}") for f in fields), F.lit(0))
        by = by.where(reduce(Column.__or__, (hits(i) > 0 for i in k)))
        df = by.agg(*(F.count_if(hits(i) > 0).alias(f"df_{i}") for i in k))
        scored = by.join(F.broadcast(df), F.lit(True))  # one row
        mean = state["tokens"] / state["docs"] if state["tokens"] else 1.0
        total = F.lit(0.0)
        for i in k:
            tf = sum((F.col(f"c_{i}_{f}") * w for f, w in enumerate(weights)), F.lit(0.0))
            idf = F.greatest(F.log((F.lit(state["docs"]) - F.col(f"df_{i}") + 0.5) / (F.col(f"df_{i}") + 0.5)), F.lit(LEAST_IDF))
            total = total + idf * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * F.col("len") / mean))
        if every:
            for i in k:
                scored = scored.where(hits(i) > 0)
        return scored.select("key", total.alias("score"))
