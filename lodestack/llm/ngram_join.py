"""N-gram Jaccard join: MinHash banding with verification on full n-gram sets.

Texts are sequences of lower-cased words; a text's set is that of its five-word shingles (a shorter
text that has words is one shingle). Texts of equal words form one class, so copies never meet each
other. Band and row counts follow from the threshold and the target recall. Classes that share a band
hash form a bucket and are candidates of each other.

Buckets that have the same least class (their lead) are verified at one place, the lead's home: in a group of near
copies most bands name the same lead, so a class travels to few homes instead of to a bucket for each band. A home
larger than a block is dealt out to pairs of blocks. A task compares the full sets of its classes by matrix products
over the shingles that two of them share, and counts a pair only where it belongs: at the least lead of the bands
that both have in common. It gives, by class, the number of links and one edge to the least class it reaches:
linear output, no list of pairs. Classes that only a chain of others ties together never meet.

Defined cases: null and empty texts, and texts without words, form one class without links; null ids
sort after all others and give a null class_id only to a class of null ids; rows with equal ids and
texts share their fate; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm._graph import components
from lodestack.llm._spark import arrow_map, dropped, table, written
from lodestack.llm._tokens import group_stream, mix, shingles, words

WORDS, THRESHOLD, RECALL, MOST_HASHES = 5, 0.8, 0.999, 220
#: Classes and bytes of sets in a block; two blocks at most are compared at once. Bytes of sets that a task should get.
BLOCK, BLOCK_BYTES, TASK_BYTES = 256, 32 << 20, 64 << 20
#: Shingles that are compared at a time.
SLICE = 1 << 20
_COLUMNS = 8192


def bands_for(threshold: float, recall: float, most_hashes: int) -> tuple[int, int]:
    """(bands, rows): the most rows, so the fewest false candidates, whose bands reach the recall within most_hashes."""
    best = None
    for rows in range(1, most_hashes + 1):
        hit = threshold**rows
        bands = 1 if hit >= 1 else max(1, math.ceil(math.log(1 - recall) / math.log1p(-hit)))
        if bands * rows <= most_hashes:
            best = bands, rows
    return best or (most_hashes, 1)


class MinHash:
    def __init__(self, bands: int, rows: int, seed: int = 17):
        rng = np.random.default_rng(seed)
        self.bands, self.rows, k = bands, rows, bands * rows
        self.a = (rng.integers(0, 1 << 31, k, np.uint32) << np.uint32(1)) | np.uint32(1)
        self.b = rng.integers(0, 1 << 32, k, np.uint64).astype(np.uint32)

    def band_hashes(self, s: np.ndarray) -> np.ndarray:
        """A 64-bit hash for each band of a set of 64-bit shingle hashes."""
        x = (s >> np.uint64(32)).astype(np.uint32)
        low = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        for at in range(0, len(x), 1024):
            part = x[at : at + 1024]
            low = np.minimum(low, (self.a[:, None] * part + self.b[:, None]).min(1))
        m = low.reshape(self.bands, self.rows).astype(np.uint64)
        h = np.arange(1, self.bands + 1, dtype=np.uint64)
        for j in range(self.rows):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + m[:, j])
        return h.view(np.int64)


def shingle_sets(texts: list[str], n: int) -> Iterator[tuple[bytes, np.ndarray]]:
    """(digest of the words, sorted distinct shingle hashes) of each text."""
    h, cuts = words(texts)
    for i in range(len(texts)):
        w = h[cuts[i] : cuts[i + 1]]
        yield hashlib.blake2b(w.tobytes(), digest_size=16).digest(), np.unique(shingles(w, n))


def _signatures(minhash: MinHash, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests, bands, sizes = [], [], []
            for d, s in shingle_sets(b.column("body").to_pylist(), n):
                digests.append(d)
                sizes.append(len(s))
                bands.append(minhash.band_hashes(s) if len(s) else np.zeros(0, np.int64))
            flat = pa.array(np.concatenate(bands) if bands else np.zeros(0, np.int64))
            offsets = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in bands]))).astype(np.int32))
            yield pa.record_batch([b.column("id"), b.column("th"), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(offsets, flat)], ["id", "th", "cls", "size", "bands"])

    return run


def _sets(n: int):
    names = ["none", "id", "th", "homes", "leads"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [s.tobytes() for _, s in shingle_sets(b.column("body").to_pylist(), n)]
            yield pa.record_batch([*(b.column(c) for c in names), pa.array(sets, pa.binary())], [*names, "shingles"])

    return run


def linked(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Boolean matrix of pairs at or above the threshold; the diagonal is false. sets: sorted, distinct.

    The hashes are taken in ranges of about SLICE of all sets together, so what is needed besides the sets is bounded.
    """
    m = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    both = np.zeros((m, m), np.float64)
    parts = max(1, -(-int(sizes.sum()) // SLICE))
    bounds = np.array([(k << 64) // parts for k in range(1, parts)], np.uint64)
    cuts = [np.concatenate(([0], np.searchsorted(s, bounds), [len(s)])) for s in sets]
    for k in range(parts):
        _shared([s[c[k] : c[k + 1]] for s, c in zip(sets, cuts)], both)
    union = sizes[:, None] + sizes[None, :] - both
    out = (both >= threshold * union - 1e-9) & (union > 0)
    np.fill_diagonal(out, False)
    return out


def _shared(sets: list[np.ndarray], both: np.ndarray) -> None:
    """Adds the number of shingles that each two sets share."""
    m = len(sets)
    own = np.repeat(np.arange(m), [len(s) for s in sets])
    _, at, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = df > 1
    column = np.cumsum(shared) - 1
    keep = shared[at]
    own, at = own[keep], column[at[keep]]
    order = np.argsort(at, kind="stable")
    own, at = own[order], at[order]
    for lo in range(0, int(shared.sum()), _COLUMNS):
        a, b = np.searchsorted(at, (lo, lo + _COLUMNS))
        x = np.zeros((m, _COLUMNS), np.float32)
        x[own[a:b], at[a:b] - lo] = 1
        both += x @ x.T


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in group_stream(batches, lambda b: b.column("deal").to_numpy()):
            # the sort key is a hash; groups whose hashes agree are told apart here
            inner: dict[tuple, dict[tuple, tuple]] = {}
            for b in group:
                for home, i, j, block, none, ident, th, leads, s in zip(*(b.column(n).to_pylist() for n in ("home", "i", "j", "block", "none", "id", "th", "leads", "shingles"))):
                    inner.setdefault((home, i, j), {})[none, ident or 0, th] = block, leads, np.frombuffer(s, np.uint64)
            for (home, i, j), members in inner.items():
                if len(members) < 2:
                    continue
                node = sorted(members)
                block = np.array([members[c][0] for c in node])
                leads = np.array([members[c][1] for c in node], np.int64)
                x, y = np.nonzero(np.triu(linked([members[c][2] for c in node], threshold)))
                if i != j:
                    x, y = x[block[x] != block[y]], y[block[x] != block[y]]
                counted = np.zeros(len(x), bool)
                for lo in range(0, len(x), 1 << 16):  # the bands that both share, and the least lead of them
                    p, q = leads[x[lo : lo + (1 << 16)]], leads[y[lo : lo + (1 << 16)]]
                    least = np.where((p == q) & (p != NO_LEAD), p, NO_LEAD).min(1)
                    counted[lo : lo + (1 << 16)] = (least == home) & (home != NO_LEAD)
                x, y = x[counted], y[counted]
                links = np.bincount(x, minlength=len(node)) + np.bincount(y, minlength=len(node))
                label = np.arange(len(node))
                while True:
                    new = label.copy()
                    np.minimum.at(new, x, label[y])
                    np.minimum.at(new, y, label[x])
                    new = new[new]
                    if (new == label).all():
                        break
                    label = new
                own = np.flatnonzero(links)
                if len(own):
                    side = lambda at: pa.StructArray.from_arrays([pa.array([node[k][0] for k in at], pa.bool_()), pa.array([None if node[k][0] else node[k][1] for k in at], pa.int64()), pa.array([node[k][2] for k in at], pa.int64())], ["none", "id", "th"])
                    yield pa.record_batch([side(own), side(label[own]), pa.array(links[own].astype(np.int64))], ["u", "v", "links"])

    return run


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL, most_hashes: int = MOST_HASHES, block: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of docs: doc_id, text_hash, class_id, n_links, copies, kept.

    class_id is the least id of all documents reached over links and copies, n_links the number of
    different texts linked directly, copies the rows whose words are equal; kept marks the one text of
    each class that stays.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(body).alias("th"), body.alias("body"))
    minhash = MinHash(*bands_for(threshold, recall, most_hashes))
    sig = written(arrow_map(base, _signatures(minhash, n), "id long, th long, cls binary, size long, bands array<long>"), "signatures")
    rep = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th")).alias("rep")
    classes = written(sig.groupBy("cls").agg(rep, F.count(F.lit(1)).alias("copies"), F.any_value("bands").alias("bands"), F.max("size").alias("size")), "classes")
    met = written(_homes(classes, minhash.bands, block, block_bytes), "homes")
    moved = met.agg(F.coalesce(F.sum(F.aggregate("homes", F.lit(0).cast("long"), lambda acc, h: acc + h["blocks"]) * (F.col("size") * 8 + 300)), F.lit(0))).first()[0]
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-moved // TASK_BYTES))
    sets = arrow_map(_texts(base, met), _sets(n), f"none boolean, id long, th long, homes {_HOMES}, leads array<long>, shingles binary")
    at = sets.select("none", "id", "th", "leads", "shingles", F.explode("homes").alias("h")).select("none", "id", "th", "leads", "shingles", F.col("h.home").alias("home"), F.col("h.blocks").alias("blocks"), F.col("h.block").alias("block"))
    dealt = at.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("i", F.greatest("block", "other")).withColumn("j", F.least("block", "other"))
    pair = F.shiftright(F.col("i").cast("long") * (F.col("i") + 1), 1) + F.col("j")
    place = F.pmod(F.pmod(F.xxhash64("home"), F.lit(tasks)) + pair, F.lit(tasks)).cast("int")  # pairs of blocks of one home go to one task after another
    dealt = dealt.select("home", "i", "j", "block", "none", "id", "th", "leads", "shingles", F.xxhash64("home", "i", "j").alias("deal"), place.alias("place")).repartitionById(tasks, F.col("place")).sortWithinPartitions("deal")
    links = written(arrow_map(dealt, _verify(threshold), f"u {_NODE}, v {_NODE}, links long"), "links")
    groups = components(links)
    own = links.groupBy(F.col("u").alias("rep")).agg(F.sum("links").alias("links")).join(groups.select(F.col("node").alias("rep"), "root"), "rep", "full_outer")
    member = classes.join(own, "rep", "left").where("copies > 1 or root is not null").select("cls", "copies", "links", F.coalesce("root", "rep").alias("first"))
    out = sig.select("id", "th", "cls").join(member, "cls", "left").select(
        F.col("id").alias("doc_id"),
        F.col("th").alias("text_hash"),
        F.when(F.col("first").isNull(), F.col("id")).otherwise(F.col("first.id")).alias("class_id"),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("copies"),
        (F.col("first").isNull() | (F.col("first.id").eqNullSafe(F.col("id")) & (F.col("first.th") == F.col("th")))).alias("kept"),
    )
    out = written(out, "jaccard-rows")
    dropped(sig, classes, met, links, groups)
    return out


def _texts(base: DataFrame, met: DataFrame) -> DataFrame:
    """The text of each class that met, once, however many rows have the id and text of its representative.

    Equal rows fold in their input task; what is left goes by its key to the join, which needs no exchange beyond that one. A merge
    join at every size: what has to be met grows with the documents.
    """
    key = [F.col("id").isNull().alias("none"), F.coalesce("id", F.lit(0)).alias("i"), "th"]
    single = base.select(*key, "body").dropDuplicates(["none", "i", "th"])
    where = met.select(F.col("rep.none").alias("none"), F.coalesce("rep.id", F.lit(0)).alias("i"), F.col("rep.th").alias("th"), "homes", "leads").hint("merge")
    return single.join(where, ["none", "i", "th"]).select("none", F.when(~F.col("none"), F.col("i")).alias("id"), "th", "homes", "leads", "body")


_NODE, _HOMES = "struct<none:boolean,id:long,th:long>", "array<struct<home:long,blocks:int,block:int>>"
#: Stands for a band in which a class is alone, and sorts after all leads.
NO_LEAD = (1 << 63) - 1


def _homes(classes: DataFrame, bands: int, block: int, block_bytes: int) -> DataFrame:
    """(rep, size, leads, homes) of each class that shares a bucket: its lead in each band, and where it has to go.

    Leads are aggregates with map-side combine and meet the bands in a join on a unique key; both sides of it are
    plain exchanges, so adaptive execution splits what a bucket with many classes makes large.
    """
    rows = classes.select("rep", "size", F.posexplode("bands").alias("k", "band"))
    lead = F.xxhash64(F.min("rep"))
    leads = rows.groupBy("band").agg(lead.alias("home"), F.count(F.lit(1)).alias("m")).where("m > 1").select("band", F.when(F.col("home") == NO_LEAD, 0).otherwise(F.col("home")).alias("home")).hint("rebalance")
    led = rows.join(leads, "band").groupBy("rep").agg(F.max("size").alias("size"), F.map_from_entries(F.collect_list(F.struct("k", "home"))).alias("m"))
    led = led.select("rep", "size", F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(NO_LEAD))).alias("leads"))
    led = led.select("rep", "size", "leads", F.explode(F.array_distinct(F.filter("leads", lambda x: x != NO_LEAD))).alias("home"))
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(block)), F.ceil(F.sum("size") * 8 / F.lit(block_bytes)))
    sizes = led.groupBy("home").agg(blocks.cast("int").alias("blocks")).hint("rebalance")
    mine = F.pmod(F.xxhash64("rep", "home"), F.col("blocks")).cast("int").alias("block")
    return led.join(sizes, "home").groupBy("rep").agg(F.max("size").alias("size"), F.any_value("leads").alias("leads"), F.collect_list(F.struct("home", "blocks", mine)).alias("homes")).select("rep", "size", "leads", "homes")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Rows of docs without those that have a kept near copy; columns unchanged, whatever their names."""
    gone = jaccard_join(docs, id_col, text_col, **options).where(~F.col("kept")).select("doc_id", "text_hash").distinct()
    whole = docs.select(F.struct("*").alias("r"), F.col(id_col).cast("long").alias("i"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("h"))
    kept = whole.join(gone, F.col("i").eqNullSafe(F.col("doc_id")) & (F.col("h") == F.col("text_hash")), "left_anti")
    return kept.select(*(F.col("r")[c].alias(c) for c in docs.columns))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents")).drop("text_hash")
