"""Exact deduplication by an extendible-hash index on shared files.

Keys are 64-bit hashes of the whole text. The directory starts with as many slots as buckets that are half full
would need; a bucket that holds more distinct keys than its capacity is split by the next bit, level by level, in
Spark, until none is overfull or its keys have no more bits. Directory and index are tables in the shared folder.

Owner tasks process ranges of keys. The ranges are cut so that owners get about equal bytes: distinct texts count
as often as they will arrive. Each input task first folds its own repeats into one entry (a hot text costs a task
one row each time that it has gathered FOLD_BYTES), entries travel with their text to their owner, and owners walk keys in
order, chain the texts of one key and compare bytes as they arrive: an owner holds one text for each member of the chain
at hand and one Arrow batch, however many copies come. Documents find their group again by entry, a join without hot keys.

Defined cases: null text counts as empty; null ids sort below all others; of equal rows with equal ids
one stays; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm._spark import arrow_map, table
from lodestack.shared import dropped, filesystem, shared_dir, written

#: Distinct keys that a bucket may hold, bits by which ranges are measured, bytes that an owner should get, bytes of text a task folds at once.
BUCKET_KEYS, RANGE_BITS, OWNER_BYTES, FOLD_BYTES = 4096, 16, 64 << 20, 64 << 20
#: Rows and bytes of text of an output batch. Bytes that an entry takes in a task besides its text (measured: dictionary, list, numbers).
OUT_ROWS, OUT_BYTES, ENTRY_BYTES = 2000, 4 << 20, 400

_ENTRY = "entry long, id long, row long, key long, owner int, sha string, n long, body binary, kind int"
_CHAIN = "kind int, entry long, id long, row long, sha string, slot long, key long, chain int, keep_id long, keep_row long, n long"

_ROWS = "doc_id long, keep_id long, n long, kept boolean, sha string, slot long, key long, chain int"
_DIRECTORY = "slot long, prefix long, depth int, n long"


def prefix(key: Column, depth: int) -> Column:
    """The first bits of a key, as a number."""
    return F.shiftrightunsigned(key, 64 - depth) if depth else F.lit(0).cast("long")


def directory(keys: DataFrame, capacity: int, start: int, bits: int = 64) -> tuple[DataFrame, list[DataFrame]]:
    """(slot, prefix, depth, n) of every bucket, and the tables it is read from. keys: distinct `key`s; slot: the first `start` bits.

    A level counts the keys of each prefix; prefixes at or below the capacity are buckets, the keys of the others
    go on to the next level. Levels after the first see the keys of overfull buckets alone.
    """
    out, files, rest = [], [], keys
    for depth in range(start, bits + 1):
        level = rest.groupBy(prefix(F.col("key"), depth).alias("prefix")).agg(F.count(F.lit(1)).alias("n")).withColumn("full", (F.col("n") > capacity) & F.lit(depth < bits))
        level = written(level, "exact-level")
        files.append(level)
        slot = F.shiftright("prefix", depth - start) if depth > start else F.col("prefix")
        out.append(level.where("not full").select(slot.alias("slot"), "prefix", F.lit(depth).alias("depth"), "n"))
        if level.where("full").isEmpty():
            break
        rest = rest.join(level.where("full").select("prefix"), prefix(F.col("key"), depth) == F.col("prefix"), "left_semi")
    every = out[0]
    for more in out[1:]:
        every = every.unionByName(more)
    return every, files


@dataclass
class Ranges:
    """Owners by key: cells are prefixes of RANGE_BITS bits; a cell has its first owner, and several when it is heavy."""

    first: np.ndarray
    parts: np.ndarray
    owners: int

    @classmethod
    def cut(cls, weights: dict[int, int], target: float) -> Ranges:
        n = 1 << RANGE_BITS
        first, parts = np.zeros(n, np.int64), np.ones(n, np.int64)
        owner, held = 0, 0.0
        for cell in range(n):
            w = weights.get(cell, 0)
            if held and held + w > target:
                owner, held = owner + 1, 0.0
            first[cell] = owner
            if w > target:
                parts[cell] = math.ceil(w / target)
                owner, held = owner + int(parts[cell]), 0.0
            else:
                held += w
        return cls(first, parts, owner + 1)

    def of(self, keys: np.ndarray) -> np.ndarray:
        k = keys.view(np.uint64)
        cell = (k >> np.uint64(64 - RANGE_BITS)).astype(np.int64)
        within = ((k >> np.uint64(64 - RANGE_BITS - 32)) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        return self.first[cell] + (within * self.parts[cell] >> 32)


def _folder(ranges: Ranges):
    """Folds a task's equal texts: a member row per document, an entry row with the text per distinct text."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36
        known: dict[bytes, list] = {}
        size = 0

        def entries() -> Iterator[pa.RecordBatch]:
            """The entries so far, which are forgotten as they go out."""
            while known:
                held, some = 0, []
                while known and len(some) < OUT_ROWS and held < OUT_BYTES:
                    t, v = known.popitem()
                    some.append((t, *v))
                    held += len(t)
                body, entry, key, ident, row, n = (list(c) for c in zip(*some))
                keys = np.array(key, np.int64)
                yield pa.record_batch(
                    [pa.array(entry, pa.int64()), pa.array(ident, pa.int64()), pa.array(row, pa.int64()), pa.array(keys), pa.array(ranges.of(keys).astype(np.int32)), pa.nulls(len(some), pa.string()), pa.array(n, pa.int64()), pa.array(body, pa.binary()), pa.array(np.ones(len(some), np.int32))],
                    ["entry", "id", "row", "key", "owner", "sha", "n", "body", "kind"],
                )

        for b in batches:
            ids, keys, texts = (b.column(n).to_pylist() for n in ("id", "key", "body"))
            entry_of, rows = [], []
            for i, k, t in zip(ids, keys, texts):
                serial += 1
                e = known.get(t)
                if e is None:
                    e = known[t] = [serial, k, i, serial, 0]
                    size += len(t) + ENTRY_BYTES
                elif i is not None and (e[2] is None or i >= e[2]) or e[2] is None:
                    e[2], e[3] = i, serial
                e[4] += 1
                entry_of.append(e[0])
                rows.append(serial)
            n = len(ids)
            entry_arr = np.array(entry_of, np.int64)
            yield pa.record_batch(
                [pa.array(entry_arr), b.column("id"), pa.array(np.array(rows, np.int64)), pa.nulls(n, pa.int64()), pa.array(((entry_arr ^ (entry_arr >> 36)) % ranges.owners).astype(np.int32)), b.column("sha"), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.array(np.zeros(n, np.int32))],
                ["entry", "id", "row", "key", "owner", "sha", "n", "body", "kind"],
            )
            if size > FOLD_BYTES:
                yield from entries()
                size = 0
        yield from entries()

    return fold


def _owners(start: int):
    names = ["kind", "entry", "id", "row", "sha", "slot", "key", "chain", "keep_id", "keep_row", "n"]

    def members(b: pa.RecordBatch) -> pa.RecordBatch:
        void = lambda t: pa.nulls(b.num_rows, t)
        return pa.record_batch([b.column("kind"), b.column("entry"), b.column("id"), b.column("row"), b.column("sha"), void(pa.int64()), void(pa.int64()), void(pa.int32()), void(pa.int64()), void(pa.int64()), void(pa.int64())], names)

    def chained(rows: list[tuple]) -> pa.RecordBatch:
        n, cols = len(rows), list(zip(*rows))
        void = lambda t: pa.nulls(n, t)
        return pa.record_batch([pa.array(np.ones(n, np.int32)), pa.array(cols[0], pa.int64()), void(pa.int64()), void(pa.int64()), void(pa.string()), *(pa.array(c, t) for c, t in zip(cols[1:], (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())))], names)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted, members first and then entries by key: chains the texts of each key by comparing bytes.

        Of the texts of a key one is held for each member of the chain; a copy is compared as it arrives and let go.
        """
        key: int | None = None
        chain: list[list] = []  # text, largest id, its row, count
        seen: list[tuple[int, int]] = []  # entry, place in the chain
        out: list[tuple] = []

        def ended() -> Iterator[pa.RecordBatch]:
            nonlocal out
            if seen:
                slot = (key & 0xFFFFFFFFFFFFFFFF) >> (64 - start) if start else 0
                out += [(e, slot, key, at, *chain[at][1:]) for e, at in seen]
                chain.clear()
                seen.clear()
            while len(out) >= OUT_ROWS:
                yield chained(out[:OUT_ROWS])
                out = out[OUT_ROWS:]

        for b in batches:
            lo = int((b.column("kind").to_numpy() == 0).sum())
            if lo:
                yield members(b.slice(0, lo))
                b = b.slice(lo)
            bodies = b.column("body")
            for k, e, i, r, n, body in zip(*(b.column(c).to_pylist() for c in ("key", "entry", "id", "row", "n")), bodies):
                if k != key:
                    yield from ended()
                    key = k
                t = body.as_py()
                for at, c in enumerate(chain):
                    if c[0] == t:
                        break
                else:
                    at, c = len(chain), [t, None, -1, 0]
                    chain.append(c)
                c[3] += n
                if (i is not None, i or 0, r) > (c[1] is not None, c[1] or 0, c[2]):
                    c[1], c[2] = i, r
                seen.append((e, at))
        yield from ended()
        if out:
            yield chained(out)

    return walk


class ExactIndex:
    """The index in the shared folder: `directory` (slot, prefix, depth, n), and `rows`, of which `chains` has one for each distinct text."""

    def __init__(self, spark: SparkSession, path: str, start: int):
        self.spark, self.path, self.start = spark, path, start

    @property
    def directory(self) -> DataFrame:
        return self.spark.read.schema(_DIRECTORY).parquet(f"{self.path}/directory")

    @property
    def rows(self) -> DataFrame:
        """doc_id, keep_id, n, kept, sha, slot, key, chain of every document."""
        return self.spark.read.schema(_ROWS).parquet(f"{self.path}/rows")

    @property
    def chains(self) -> DataFrame:
        """The rows that stay: slot, key, chain, keep_id, n, sha of each distinct text."""
        return self.rows.where("kept").select("slot", "key", "chain", "keep_id", "n", "sha")

    def find(self, texts: DataFrame, text_col: str = "text") -> DataFrame:
        """texts with keep_id and group_size of the indexed group whose text is equal (null where there is none); other columns of these names are replaced."""
        body = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
        asked = texts.select(F.struct("*").alias("row"), F.xxhash64(body).alias("key"), F.sha2(body, 256).alias("sha"))
        held = self.chains.select("key", "sha", F.col("keep_id").alias("k"), F.col("n").alias("n"))
        found = asked.join(held, ["key", "sha"], "left")
        return found.select(*(F.col("row")[c].alias(c) for c in texts.columns if c not in ("keep_id", "group_size")), F.col("k").alias("keep_id"), F.col("n").alias("group_size"))


def _settled(docs: DataFrame) -> DataFrame:
    """docs, written first where its plan has an exchange: entries are named by place, and a task that runs again behind an exchange may see its rows in another order."""
    plan = docs._jdf.queryExecution().executedPlan().toString()
    return written(docs, "exact-docs") if "Exchange" in plan or "Window" in plan else docs


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_keys: int = BUCKET_KEYS, key_bits: int = 64, owner_bytes: int = OWNER_BYTES, index_path: str | None = None) -> tuple[ExactIndex, DataFrame]:
    """The index of docs, and the table that ties documents to its entries (kind 0: documents, kind 1: entries).

    Without an index_path the index lies in the shared folder and goes when the driver ends.
    """
    spark, given = docs.sparkSession, docs
    docs = _settled(given)
    body = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    hashed = F.xxhash64(F.col("body"))
    if key_bits < 64:
        hashed = F.shiftleft(F.shiftrightunsigned(hashed, 64 - key_bits), 64 - key_bits)
    base = docs.select(F.col(id_col).cast("long").alias("id"), body.alias("body"))
    tasks = max(1, base.select(F.spark_partition_id().alias("p")).distinct().count())
    keys = written(base.select(hashed.alias("key"), F.octet_length("body").alias("size")).groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.max("size").alias("size")), "exact-keys")
    weight = ((F.col("size") + 100) * F.least("c", F.lit(tasks))).cast("double")
    n, total = keys.agg(F.count(F.lit(1)), F.coalesce(F.sum(weight), F.lit(0.0))).first()
    start = min(key_bits, 62, max(0, math.ceil(math.log2(max(1, 2 * n / bucket_keys)))))
    buckets, levels = directory(keys, bucket_keys, start, key_bits)
    owners = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / owner_bytes))
    cells = keys.groupBy(prefix(F.col("key"), RANGE_BITS).alias("cell")).agg(F.sum(weight).alias("w")).collect()  # at most 2**RANGE_BITS rows
    ranges = Ranges.cut({r["cell"]: r["w"] for r in cells}, max(1.0, total / owners))
    path = index_path
    if path is None:
        path = f"{shared_dir(spark)}/lodestack/exact-index-{uuid.uuid4().hex}"
        fs, p = filesystem(spark, path)
        fs.deleteOnExit(p)
    buckets.write.parquet(f"{path}/directory")
    dropped(keys, *levels)
    entries = arrow_map(base.select("id", hashed.alias("key"), F.sha2("body", 256).alias("sha"), "body"), _folder(ranges), _ENTRY)
    dealt = entries.repartitionById(ranges.owners, F.col("owner")).sortWithinPartitions("kind", F.col("key"))
    walked = written(arrow_map(dealt, _owners(start), _CHAIN), "exact-walked")
    if docs is not given:
        dropped(docs)
    return ExactIndex(spark, path, start), walked


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256. Options: those of build(); key_bits < 64 forces collisions in tests."""
    return indexed(docs, id_col, text_col, **options)[1]


def indexed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> tuple[ExactIndex, DataFrame]:
    """The index, complete on the shared files, and the rows of exact_dedup."""
    index, walked = build(docs, id_col, text_col, **options)
    members = walked.where("kind = 0").select("entry", "id", "row", "sha")
    chains = walked.where("kind = 1").select("entry", "slot", "key", "chain", "keep_id", "keep_row", "n")
    both = members.join(chains, "entry")
    both.select(F.col("id").alias("doc_id"), "keep_id", "n", (F.col("row") == F.col("keep_row")).alias("kept"), "sha", "slot", "key", "chain").write.parquet(f"{index.path}/rows")
    dropped(walked)
    return index, index.rows.select("doc_id", "keep_id", F.col("n").alias("group_size"), "kept", F.col("sha").alias("text_sha256"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of docs without those that have a kept equal; columns unchanged, whatever their names.

    Dropped rows are named by id and digest of the text. Where equal rows also have equal ids, the ids alone cannot
    tell them apart: of these the one whose columns have the least hash stays.
    """
    found = exact_dedup(docs, id_col, text_col)
    gone = found.where(F.col("group_size") > 1).groupBy("doc_id", "text_sha256").agg(F.max("kept").alias("stays"), F.count(F.lit(1)).alias("rows"))
    sha = F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)
    whole = docs.select(F.struct("*").alias("r"), F.col(id_col).cast("long").alias("i"), sha.alias("h"))
    same = F.col("i").eqNullSafe(F.col("doc_id")) & (F.col("h") == F.col("text_sha256"))
    out = whole.join(gone.where("not stays"), same, "left_anti")
    twins = gone.where("stays and rows > 1")
    if not twins.isEmpty():
        single = out.join(twins, same, "left_semi").groupBy("i", "h").agg(F.min_by("r", F.xxhash64("r")).alias("r")).select("r", "i", "h")
        out = out.join(twins, same, "left_anti").unionByName(single)
    return out.select(*(F.col("r")[c].alias(c) for c in docs.columns))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
