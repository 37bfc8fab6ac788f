"""Operators 6 and 8 against brute force."""

import hashlib
import os
import random
import subprocess
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack.llm import exact_dedup, sharding


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, entry string, row int, `key` int, n int").repartition(3)


ROWS = [(i, "x" * (i % 7) if i % 5 else None, "e", 1, 2, 3) for i in range(120)] + [(3, "xxx", "e", 1, 2, 3)] * 2 + [(None, "xx", "e", 1, 2, 3), (None, None, "e", 1, 2, 3), (500, "é", "", 0, 0, 0), (501, "é", "", 0, 0, 0), (502, "long " * 40000, "", 0, 0, 0)]


@pytest.mark.parametrize("bits", [64, 3, 1])
def test_exact_dedup(spark, bits):
    got = exact_dedup.exact_dedup(frame(spark, ROWS), bucket_keys=2, key_bits=bits).collect()
    groups = defaultdict(list)
    for r in ROWS:
        groups[r[1] or ""].append(r[0])
    assert len(got) == len(ROWS)
    want = Counter()
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for i in ids:
            want[(i, keep, len(ids), hashlib.sha256(t.encode()).hexdigest())] += 1
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len(groups) and all(r["doc_id"] == r["keep_id"] for r in kept)


def test_exact_dedup_empty(spark):
    assert exact_dedup.exact_dedup(frame(spark, ROWS).limit(0)).count() == 0


def test_directory_splits_what_is_overfull(spark):
    """Against splitting on the driver; every key lies in one bucket, none holds more than its capacity unless its bits end."""
    r = random.Random(4)
    keys = [r.randrange(1 << 64) for _ in range(300)] + [5 << 55 | k for k in range(40)]
    signed = [(k - (1 << 64) if k >> 63 else k,) for k in keys]
    buckets, _ = exact_dedup.directory(spark.createDataFrame(signed, "key long"), 8, 3, 14)
    want = set()

    def split(prefix, depth):
        n = sum(k >> (64 - depth) == prefix for k in keys)
        if n > 8 and depth < 14:
            split(prefix << 1, depth + 1), split(prefix << 1 | 1, depth + 1)
        elif n:
            want.add((prefix >> (depth - 3), prefix, depth, n))

    for p in range(8):
        split(p, 3)
    assert {tuple(r) for r in buckets.collect()} == want and max(d for _, _, d, _ in want) == 14


def test_ranges_have_equal_weights():
    w = {0: 5.0, 1: 5.0, 2: 100.0, 9: 1.0, 65535: 8.0}
    ranges = exact_dedup.Ranges.cut(w, 10.0)
    key = lambda cell, low=0: cell << 48 | low
    of = lambda *keys: ranges.of(np.array(keys, np.uint64).view(np.int64)).tolist()
    assert of(key(0), key(1), key(2), key(2, (1 << 48) - 1), key(9), key(65535)) == [0, 0, 1, 10, 11, 11] and ranges.owners == 12


def test_index_is_on_shared_files_and_can_be_asked(spark):
    index, rows = exact_dedup.indexed(frame(spark, ROWS), bucket_keys=3)
    texts = {r[1] or "" for r in ROWS}
    assert index.chains.count() == len(texts) and index.directory.agg({"n": "sum"}).first()[0] == len(texts)
    asked = spark.createDataFrame([("xx", 9), ("never seen", 9), (None, 9)], "text string, keep_id int")
    got = {r["text"]: (r["keep_id"], r["group_size"]) for r in index.find(asked).collect()}
    known = {r["text_sha256"]: (r["keep_id"], r["group_size"]) for r in rows.collect()}
    assert got == {"xx": known[hashlib.sha256(b"xx").hexdigest()], "never seen": (None, None), None: known[hashlib.sha256(b"").hexdigest()]}


def test_clashing_names_and_equal_ids(spark):
    rows = [(1, "a", "s", 1, 2), (1, "a", "s", 7, 2), (2, "b", "s", 1, 2), (3, "b", "s", 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _sha string, _gone_id int, stays int")
    got = [tuple(r) for r in exact_dedup.keep_one_of_each(docs).collect()]
    assert len(got) == 2 and (3, "b", "s", 1, 2) in got
    again = [tuple(r) for r in exact_dedup.keep_one_of_each(docs.orderBy(F.desc("_gone_id")).repartition(3)).collect()]
    assert sorted(again) == sorted(got)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 17, 120, 1001])
def test_permutation(spark, n):
    image = [sharding.permuted(i, n, 3) for i in range(n)]
    assert sorted(image) == list(range(n))
    from pyspark.sql import functions as F

    got = [r[0] for r in spark.range(n).orderBy("id").select(sharding.permutation(F.col("id"), max(1, n), 3)).collect()]
    assert got == image


def test_shards(spark):
    got = sharding.shard_rows(frame(spark, ROWS), n_shards=5).collect()
    assert len(got) == len(ROWS)
    want = Counter((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in ROWS)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    by = defaultdict(list)
    for r in got:
        assert r["law"] == "rows" and r["grown_shard"] is None
        by[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    again = sharding.shard_rows(frame(spark, ROWS[::-1]).repartition(7), n_shards=5).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))
    few = Counter(map(tuple, sharding.shard_rows(frame(spark, ROWS), n_shards=5, bucket_rows=1).collect()))
    assert sum(few.values()) == len(ROWS) and sharding.shard_rows(frame(spark, ROWS).limit(0)).count() == 0


def test_one_row_many_times(spark, monkeypatch):
    monkeypatch.setattr(sharding, "STEP", 70)
    docs = spark.range(1000).selectExpr("1L doc_id", "'hot' text").union(spark.createDataFrame([(2, "x")], "doc_id long, text string"))
    got = sharding.shard_rows(docs, n_shards=3).collect()
    assert sorted((r["shard"] + 3 * r["slot"]) for r in got) == list(range(1001))


def peak_mb(code):
    """MB by which a process of its own grows while `code` runs after the imports."""
    head = "import resource, numpy as np, pyarrow as pa\nfrom lodestack.llm import exact_dedup as E\nE.arrow_map\nbefore = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss\n"
    tail = "\nprint((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024)"
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    return float(subprocess.run([sys.executable, "-c", head + code + tail], cwd=root, capture_output=True, text=True, check=True).stdout.split()[-1])


def test_owner_holds_one_text_of_many_copies():
    """800 copies of a text of 1 MB, each from another input task."""
    code = """
def batches():
    for i in range(800):
        one = lambda v, t: pa.array([v], t)
        yield pa.record_batch([one(1, pa.int32()), one(i, pa.int64()), one(i, pa.int64()), one(i, pa.int64()), one(5, pa.int64()), one(1, pa.int64()), one(b"x" * 1_000_000, pa.binary()), one(None, pa.string())], ["kind", "entry", "id", "row", "key", "n", "body", "sha"])
rows = [r for b in E._owners(3)(batches()) for r in b.to_pylist()]
assert len(rows) == 800 and {(r["keep_id"], r["n"], r["chain"]) for r in rows} == {(799, 800, 0)}
"""
    assert peak_mb(code) < 50


def test_a_task_of_many_short_texts_stays_small():
    """3.6 million distinct texts of 20 bytes in one input task."""
    code = """
def batches():
    for lo in range(0, 3_600_000, 400):
        ids = np.arange(lo, lo + 400)
        yield pa.record_batch([pa.array(ids), pa.array(ids * 7919), pa.array(["s"] * 400), pa.array([b"%020d" % i for i in ids.tolist()], pa.binary())], ["id", "key", "sha", "body"])
n = sum(b.num_rows for b in E._folder(E.Ranges.cut({}, 1.0))(batches()))
assert n == 7_200_000
"""
    assert peak_mb(code) < 200


def test_rows_behind_an_exchange_are_written_first(spark):
    docs = frame(spark, ROWS)
    assert exact_dedup._settled(docs) is not docs
    path = docs.sparkSession.createDataFrame(ROWS[:3], docs.schema)
    assert exact_dedup._settled(path) is path
