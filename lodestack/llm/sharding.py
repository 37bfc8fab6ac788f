"""Sharding by a Feistel permutation with cycle walking over global row numbers, in DataFrame expressions only.

Rows get dense global numbers in an order that depends only on their content (hash bucket, id, crc,
size). A Feistel network over the smallest near-square grid that holds all numbers permutes the grid;
walking its cycle until it is back inside gives a permutation of the numbers themselves. Position p
then lies in shard p mod n at slot p div n: counts are at most one apart, slots have no gaps, and both
can be computed, or inverted, without looking at any other row. Law: `rows`.

Defined cases: null text has no bytes; null ids and repeated rows are kept; equal rows are
interchangeable and share out consecutive numbers; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestack.llm._spark import table, written

PRIME, ROUNDS, SHARDS = 2_147_483_647, 6, 24
#: Rows of a bucket of the numbering, on average, the most buckets, and copies of one row unfolded at once.
BUCKET_ROWS, MOST_BUCKETS, STEP = 20_000, 1 << 18, 10_000
#: Further walks allowed; beyond a thousand rows one walk fails with a chance under 1 in 15, so 64 never do.
WALKS = 64


def keys(seed: int) -> list[tuple[int, int, int]]:
    """Three numbers below 2**30 for each round."""
    out = []
    for r in range(ROUNDS):
        h = hashlib.sha256(f"feistel:{seed}:{r}".encode()).digest()
        out.append(tuple(int.from_bytes(h[i : i + 4], "big") >> 2 for i in (0, 4, 8)))
    return out


def grid(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def permuted(x: int, n: int, seed: int) -> int:
    """The same permutation on the driver."""
    a, b = grid(n)
    while True:
        left, right = divmod(x, b)
        for r, (p, q, c) in enumerate(keys(seed)):
            v = left if r % 2 else right
            f = ((v * v % PRIME) * p + v * q + c) % PRIME
            left, right = (left, (right + f) % b) if r % 2 else ((left + f) % a, right)
        x = left * b + right
        if x < n:
            return x


def _feistel(x: Column, n: int, seed: int) -> Column:
    a, b = grid(n)
    rounds = F.array(*(F.struct(F.lit(p).cast("long").alias("p"), F.lit(q).cast("long").alias("q"), F.lit(c).cast("long").alias("c"), F.lit(r % 2 == 1).alias("odd")) for r, (p, q, c) in enumerate(keys(seed))))

    def step(s: Column, r: Column) -> Column:
        v = F.when(r["odd"], s["l"]).otherwise(s["r"])
        f = ((v * v % PRIME) * r["p"] + v * r["q"] + r["c"]) % PRIME
        return F.struct(F.when(r["odd"], s["l"]).otherwise((s["l"] + f) % a).alias("l"), F.when(r["odd"], (s["r"] + f) % b).otherwise(s["r"]).alias("r"))

    start = F.struct(F.floor(x / F.lit(b)).alias("l"), (x % b).alias("r")) if n < 1 << 50 else F.struct(((x - x % b) / b).cast("long").alias("l"), (x % b).alias("r"))
    return F.aggregate(rounds, start, step, lambda s: s["l"] * b + s["r"])


def permutation(x: Column, n: int, seed: int) -> Column:
    """Image of row number x in 0..n-1; fails loudly should a walk not come back inside."""
    a, b = grid(n)
    walks = min(WALKS, a * b - n + 1) if n > 1000 else a * b - n + 1
    once = _feistel(x, n, seed)
    if a * b == n:
        return once
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(max(1, walks))), once, lambda acc, _: F.when(acc < n, acc).otherwise(_feistel(acc, n, seed)))
    return F.when(walked < n, walked).otherwise(F.raise_error(F.lit("cycle walking did not end")).cast("long"))


def shard_rows(docs: DataFrame, n_shards: int = SHARDS, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    spark = docs.sparkSession
    body = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    # equal rows fold into one with a count, so that no repeated row makes a bucket large
    folded = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("copies"))
    folded = written(folded, "shard-rows")
    buckets = max(64, min(MOST_BUCKETS, -(-folded.count() // bucket_rows)))
    folded = folded.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(buckets)).cast("int"))
    sums = sorted((r["bucket"], r["n"]) for r in folded.groupBy("bucket").agg(F.sum("copies").alias("n")).collect())  # at most `buckets` rows
    first, total = [], 0
    for bucket, n in sums:
        first.append((bucket, total))
        total += n
    starts = spark.createDataFrame(first, "bucket int, start long")  # at most MOST_BUCKETS rows of two numbers
    folded = folded.join(F.broadcast(starts), "bucket")
    before = Window.partitionBy("bucket").orderBy("doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    numbered = folded.withColumn("row", F.col("start") + F.coalesce(F.sum("copies").over(before), F.lit(0)))
    # copies unfold in steps: first to stretches of bounded length, which are dealt out where there are many, then to rows
    stretch = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / F.lit(STEP)))).alias("k")
    numbered = numbered.select("doc_id", "size", "text_crc32", "row", "copies", stretch)
    last = F.least(F.col("copies"), (F.col("k") + 1) * STEP) - 1
    numbered = numbered.select("doc_id", "size", "text_crc32", F.explode(F.sequence(F.col("row") + F.col("k") * STEP, F.col("row") + last)).alias("row"))
    placed = numbered.withColumn("at", permutation(F.col("row"), max(1, total), seed))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), (F.col("at") % n_shards).cast("int").alias("shard"), F.floor(F.col("at") / F.lit(n_shards)).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents"))
