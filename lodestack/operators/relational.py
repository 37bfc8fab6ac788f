"""Relational operators: deduplication, paging, top-k, budgets, set operations, roll-ups, range and prefix joins."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestack.functions import paths
from lodestack.shared import written


def first_of(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in order. Nulls of a key are equal."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def latest(df: DataFrame, key: list[str], seq: str) -> DataFrame:
    """Upsert: the row with the largest sequence number of each key, as an aggregate with map-side combine."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("_r")).select(*key, *(F.col(f"_r.{c}").alias(c) for c in rest))


def distinct_edges(edges: DataFrame, key: list[str], nullable_ints: list[str], id_col: str) -> DataFrame:
    """Edges without repeats: equal keys, null ranges being equal, leave the least id."""
    rest = [c for c in edges.columns if c not in key + nullable_ints]
    keyed = edges.select("*", *(F.coalesce(F.col(c), F.lit(-1)).alias(f"_k_{c}") for c in nullable_ints))
    out = keyed.groupBy(*key, *(f"_k_{c}" for c in nullable_ints)).agg(F.min_by(F.struct(*nullable_ints, *rest), F.col(id_col)).alias("_r"))
    return out.select(*(F.col(c) if c in key else F.col(f"_r.{c}").alias(c) for c in edges.columns))


def after_key(df: DataFrame, order: str, after, n: int) -> DataFrame:
    """Keyset page: the n rows that follow a key."""
    return (df if after is None else df.where(F.col(order) > F.lit(after))).orderBy(order).limit(n)


def offset_page(df: DataFrame, order: list[Column], start: int, n: int) -> DataFrame:
    """Offset page with the flag `more`: n + 1 rows are read, n are given."""
    w = Window.orderBy(*order)
    page = df.orderBy(*order).offset(start).limit(n + 1)  # top-k first: the window below sees n + 1 rows
    page = page.withColumn("_n", F.row_number().over(w))
    return page.withColumn("more", (F.max("_n").over(Window.partitionBy()) > n)).where(F.col("_n") <= n).withColumn("rank", (F.col("_n") + start).cast("long")).drop("_n")


def within_cap(df: DataFrame, order: list[Column], cap: int) -> DataFrame:
    """Rows when there are at most `cap`; none, and one row of counts alone, when there are more.

    Adds `overflow` and `seen`, the count up to cap + 1.
    """
    top = df.orderBy(*order).limit(cap + 1)
    n = top.agg(F.count(F.lit(1)).alias("seen"))
    both = n.join(top, F.lit(True), "left")
    first = Window.partitionBy().orderBy(*order)
    marked = both.withColumn("_n", F.row_number().over(first)).withColumn("overflow", F.col("seen") > cap)
    none = [F.when(~F.col("overflow"), F.col(c)).alias(c) for c in df.columns]
    return marked.where(~F.col("overflow") | (F.col("_n") == 1)).select(*none, "seen", "overflow")


def numbered(df: DataFrame, order: list[Column]) -> DataFrame:
    """df with `rank` from 1 over all its rows, order total: ranges are sorted and numbered each by itself, and start after the rows of the ranges before."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the upper bits are the range's number, the lower 33 the row's place in it; written once, so that both stay as they are
    rows = written(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()), "numbered")
    rows = rows.withColumn("_range", F.shiftright("_m", 33))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # over one row a range
    starts = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return rows.join(F.broadcast(starts), "_range").withColumn("rank", F.col("_start") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_m", "_range", "_start")


#: Rows that one task may rank.
ALONE = 10_000


def ranked(df: DataFrame, order: list[Column], k: int | None) -> DataFrame:
    """Top k (None: all rows) with `rank` from 1, order total. A small top is ranked by one task, a larger one in ranges of the order."""
    if k is None:
        return numbered(df, order)
    if k > ALONE:
        return numbered(df, order).where(F.col("rank") <= k)
    top = df.orderBy(*order).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))


def two_stage(df: DataFrame, cheap: list[Column], costly: list[Column], k: int, factor: int = 4) -> DataFrame:
    """Shortlist of factor * k by the cheap order, then k by the costly one."""
    return ranked(df.orderBy(*cheap).limit(factor * k), costly, k)


def covering(df: DataFrame, scope: str, order: list[Column], k: int) -> DataFrame:
    """Top k in which the best row of each scope comes first; per-scope leaders are found before the global order."""
    marked = df.withColumn("_lead", F.row_number().over(Window.partitionBy(scope).orderBy(*order)) == 1)
    total = [F.when(F.col("_lead") & F.col(scope).isNotNull(), 0).otherwise(1), *order]
    return ranked(marked, total, k).drop("_lead")


def by_bucket(df: DataFrame, bucket: Column, order: list[Column], k: int) -> DataFrame:
    """Buckets one after the other, each in order, cut at k."""
    return ranked(df.withColumn("bucket", bucket), [F.col("bucket"), *order], k)


def budgeted(df: DataFrame, order: str, size: str, most_rows: int, most_bytes: int) -> DataFrame:
    """Rows in order while neither budget is used up; adds running sums and, on every row, why the scan stopped.

    At most most_rows + 1 rows reach the running sum: the row budget is a top-k.
    """
    top = df.select(F.struct(*df.columns).alias("_r"), F.col(order).alias("_o"), F.col(size).alias("_s")).orderBy("_o").limit(most_rows + 1)
    w = Window.orderBy("_o")
    run = top.withColumn("n", F.row_number().over(w).cast("long")).withColumn("bytes", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    every = Window.partitionBy()
    run = run.withColumn("stop", F.when(F.coalesce(F.min(F.when(F.col("bytes") > most_bytes, F.col("n"))).over(every) <= most_rows, F.lit(False)), "bytes").when(F.max("n").over(every) > most_rows, "rows").otherwise("exhausted"))
    run = run.where((F.col("n") <= most_rows) & (F.col("bytes") <= most_bytes))
    return run.select(*(F.col(f"_r.{c}").alias(c) for c in df.columns if c not in ("n", "bytes", "stop")), "n", "bytes", "stop")


def within_time(pages: Iterable, most_ms: float, clock: Callable[[], float]) -> tuple[list, str]:
    """Pages of a budgeted scan while time is left, and why it stopped: "time" or "exhausted". clock: milliseconds.

    The time is looked at before each page, so a page that has begun is finished and the first one always runs.
    """
    began, out = clock(), []
    for page in pages:
        out.append(page)
        if clock() - began >= most_ms:
            return out, "time"
    return out, "exhausted"


def retained(snapshots: DataFrame, repo: list[str], id_col: str, published: Column, fresh: Column, building: Column, n_published: int, n_fresh: int) -> DataFrame:
    """Snapshots to keep: building ones, the latest n published and the latest n fresh of each repository."""
    order = F.col(id_col).desc()
    nth = lambda test: F.when(test, F.row_number().over(Window.partitionBy(*repo, test).orderBy(order)))
    kept = building | F.coalesce(nth(published) <= n_published, F.lit(False)) | F.coalesce(nth(published & fresh) <= n_fresh, F.lit(False))
    return snapshots.withColumn("keep", kept)


def zero_filled(df: DataFrame, col: str, domain: list[str]) -> DataFrame:
    """Count of every value of a closed domain, zero where there is none."""
    spark = df.sparkSession
    all_of = spark.range(1, numPartitions=1).select(F.explode(F.array(*map(F.lit, domain))).alias(col))
    return F.broadcast(all_of).join(df.groupBy(col).count(), col, "left").select(col, F.coalesce("count", F.lit(0)).alias("n"))


def capability_summary(df: DataFrame, keys: list[str], path: str, kind: str, confidence: str, levels: list[str]) -> DataFrame:
    """By key: sorted distinct paths and kinds, the highest confidence. levels: from lowest to highest."""
    rank = F.array_position(F.array(*map(F.lit, levels)), F.col(confidence))
    return df.groupBy(*keys).agg(F.array_sort(F.collect_set(path)).alias("paths"), F.array_sort(F.collect_set(kind)).alias("kinds"), F.element_at(F.array(*map(F.lit, levels)), F.max(rank).cast("int")).alias("confidence"))


def samples_by_reason(df: DataFrame, reason: str, path: str, n: int = 3, deals: int = 64) -> DataFrame:
    """Count per reason with the n least paths. Paths are dealt out and ranked in their deal first, so a reason that most rows share is not one task."""
    deal = F.pmod(F.xxhash64(path), F.lit(deals))
    top = df.select(reason, path).distinct().withColumn("_n", F.row_number().over(Window.partitionBy(reason, deal).orderBy(path))).where(F.col("_n") <= n)
    least = top.groupBy(reason).agg(F.slice(F.array_sort(F.collect_list(path)), 1, n).alias("samples"))
    return df.groupBy(reason).count().join(least, reason)


def longest_prefix(df: DataFrame, path: str, units: DataFrame, prefix: str, key: str) -> DataFrame:
    """df with the unit whose prefix is the longest that holds the path ("." holds all); ties by key.

    Every ancestor of a distinct path meets units in an equi-join, so no theta join is planned.
    """
    up = df.select(F.col(path).alias("_path")).distinct().select("_path", F.explode(paths.ancestors(F.col("_path"))).alias("_p"))
    own = units.select(F.col(prefix).alias("_p"), F.col(key).alias("_unit"))
    best = up.join(own, "_p").groupBy("_path").agg(F.min(F.struct((-F.when(F.col("_p") == ".", 0).otherwise(F.length("_p"))).alias("l"), F.col("_unit").alias("unit"), F.col("_p").alias("prefix"))).alias("_b"))
    return df.join(best, F.col(path).eqNullSafe(F.col("_path")), "left").select(*df.columns, F.col("_b.unit").alias("unit"), F.col("_b.prefix").alias("unit_prefix"))


def within_range(nodes: DataFrame, start: tuple[int, int], end: tuple[int, int]) -> DataFrame:
    """Nodes whose range lies inside another, by (line, column)."""
    at = lambda l, c: F.struct(F.lit(l).alias("l"), F.lit(c).alias("c"))
    return nodes.where((F.struct(F.col("start_line").alias("l"), F.col("start_column").alias("c")) >= at(*start)) & (F.struct(F.col("end_line").alias("l"), F.col("end_column").alias("c")) <= at(*end)))


def replace_rows(current: DataFrame, changed: DataFrame, key: list[str]) -> DataFrame:
    """current without the rows of changed keys, and changed."""
    return current.join(changed.select(*key).distinct(), key, "left_anti").unionByName(changed)
