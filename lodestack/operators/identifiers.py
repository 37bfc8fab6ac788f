"""Identifier index: where each identifier stands, and bounded scans for many names that resume where they stopped.

An identifier is a maximal run of ASCII letters, digits and underscores. The index has a row for each identifier of a file, with
lines (from 1) and columns (from 0, in characters) in order, made where the file is read, without a shuffle; and a row for each file with running
numbers of the files that a scan may read and of their bytes, in path order. A scan is told by arithmetic on these numbers: no
file is read for it, however many names are asked for.

A scan takes files in path order until its budget of files or bytes would be exceeded or a name has its results; its
receipt says why it stopped and where the next one starts. Files larger than the budget of one file are counted, not scanned.
"""

from __future__ import annotations

import re
from array import array
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestack.shared import arrow_limits, dropped, spread, written
from lodestack.shipping import ship

#: Budgets of a scan: files, bytes, bytes of one file, results of a name.
FILES, BYTES, FILE_BYTES, RESULTS = 100, 1_000_000, 128_000, 50
_WORD, _LINE = re.compile("[A-Za-z0-9_]+"), re.compile("\r?\n")


#: Occurrences gathered before their rows are passed on: a file is not split, so a longer one is passed on alone.
GATHERED = 1 << 18


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of each file, in order of identifier, made where the file is read."""
    idents, paths, sizes, flat = [], [], [], array("i")

    def rows() -> pa.RecordBatch:
        at = np.frombuffer(flat, np.int32).reshape(-1, 2)
        both = pa.StructArray.from_arrays([pa.array(at[:, 0].copy()), pa.array(at[:, 1].copy())], ["line", "col"])
        return pa.record_batch([pa.array(idents, pa.string()), pa.array(paths, pa.string()), pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), both)], ["ident", "path", "places"])

    for b in batches:
        for path, text in zip(b.column("path").to_pylist(), b.column("text")):
            found: dict[str, array] = defaultdict(lambda: array("i"))
            for n, line in enumerate(_LINE.split(text.as_py()), 1):
                for m in _WORD.finditer(line):
                    found[m[0]].extend((n, m.start()))
            for ident in sorted(found):
                idents.append(ident)
                paths.append(path)
                sizes.append(len(found[ident]) // 2)
                flat.extend(found[ident])
            if len(flat) >= 2 * GATHERED:
                yield rows()
                idents, paths, sizes, flat = [], [], [], array("i")
    if idents:
        yield rows()


def identifiers(files: DataFrame) -> DataFrame:
    """ident, path, places (array of line, col in order) of every file. files: path (unique), text. Nothing is shuffled."""
    arrow_limits(files.sparkSession)
    ship(files.sparkSession)
    return spread(files).where("path IS NOT NULL AND text IS NOT NULL").select("path", "text").mapInArrow(_placed, "ident string, path string, places array<struct<line:int,col:int>>")


def running(df: DataFrame, order: str, **sums) -> DataFrame:
    """df with running sums (inclusive) over all rows in an order without ties: each range of it by itself, then moved by the ranges before."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = written(df.repartitionByRange(n, order).withColumn("_r", F.spark_partition_id()), "running")
    own = Window.partitionBy("_r").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    totals = rows.groupBy("_r").agg(*(F.sum(v).alias(f"_t_{k}") for k, v in sums.items()))
    before = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)  # over one row a range
    starts = totals.select("_r", *(F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_s_{k}") for k in sums))
    out = rows.select("*", *(F.sum(v).over(own).alias(f"_o_{k}") for k, v in sums.items())).join(F.broadcast(starts), "_r")
    return out.select(*df.columns, *((F.col(f"_o_{k}") + F.col(f"_s_{k}")).cast("long").alias(k) for k in sums))


@dataclass
class Page:
    """hits: name, ordinal (in its file, from 1), path, line, col; receipts: name, hits, stop (result, file, byte or catalog_exhausted), files, bytes, oversized, complete, next_path, next_ordinal."""

    hits: DataFrame
    receipts: DataFrame


class IdentifierIndex:
    """`places` (ident, path, places), the rows of a file together, and `files` (path, bytes, nth, total, skipped) in a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    @classmethod
    def build(cls, files: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> IdentifierIndex:
        """files: path (unique), text. A file of more than file_bytes takes no part in scans; `places` has it all the same."""
        out = cls(files.sparkSession, folder)
        identifiers(files).write.mode("overwrite").option("compression", "zstd").parquet(f"{out.folder}/places")
        size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
        base = files.where("path IS NOT NULL").select("path", size.alias("bytes"))
        fits = F.col("bytes") <= file_bytes
        listed = running(base, "path", nth=fits.cast("long"), total=F.when(fits, F.col("bytes")).otherwise(0), skipped=(~fits).cast("long"))
        listed.write.mode("overwrite").parquet(f"{out.folder}/files")
        out._file_bytes(file_bytes)
        return out

    def _file_bytes(self, value: int) -> None:
        self.spark.range(1).select(F.lit(value).cast("long").alias("file_bytes")).write.mode("overwrite").parquet(f"{self.folder}/limits")

    def places(self, names: DataFrame) -> DataFrame:
        """name, path, places of all files, for each of many names."""
        asked = names.select(F.col("name").alias("ident")).where("ident IS NOT NULL").distinct()
        return self._places().join(asked, "ident").withColumnRenamed("ident", "name")

    def _places(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/places")

    def page(self, names: DataFrame, max_results: int = RESULTS, max_files: int = FILES, max_bytes: int = BYTES) -> Page:
        """The next page of each name. names: name and, to go on, next_path and next_ordinal of its last receipt (null: from the start).

        next_ordinal 0: behind that file; else behind that occurrence in it, and the file counts against the budget again. A
        next_path that is no file of the index gives no page.
        """
        if min(max_results, max_files, max_bytes) < 1:
            raise ValueError("budgets must be positive")
        files, limit = self.spark.read.parquet(f"{self.folder}/files"), self.spark.read.parquet(f"{self.folder}/limits").first()[0]
        fits = F.col("bytes") <= limit
        resumed = "next_path" in names.columns
        asked = names.where("name IS NOT NULL").select("name", *([F.col("next_path").alias("at"), F.coalesce("next_ordinal", F.lit(0)).alias("seen")] if resumed else [F.lit(None).cast("string").alias("at"), F.lit(0).alias("seen")])).distinct()
        here = files.select(F.col("path").alias("at"), F.col("bytes").alias("_b"), F.col("nth").alias("_n"), F.col("total").alias("_t"), F.col("skipped").alias("_k"))
        again = F.col("seen") > 0  # the file of the last hit is read once more
        starts = asked.join(here, "at", "left").where("at IS NULL OR _n IS NOT NULL")
        starts = starts.select("name", "at", "seen", F.coalesce(F.col("_n") - F.when(again, 1).otherwise(0), F.lit(0)).alias("n0"), F.coalesce(F.col("_t") - F.when(again, F.col("_b")).otherwise(0), F.lit(0)).alias("t0"), F.coalesce("_k", F.lit(0)).alias("k0"))
        starts = written(starts, "scan-starts")
        # the files of each distinct start: numbers n0 + 1 to n0 + max_files, and the one behind them that tells whether there is more
        spots = starts.select("n0", "t0").distinct().select("n0", "t0", F.explode(F.sequence(F.lit(1), F.lit(max_files + 1))).alias("i")).withColumn("nth", F.col("n0") + F.col("i"))
        window = spots.join(files.where(fits), "nth").withColumn("inside", (F.col("i") <= max_files) & (F.col("total") - F.col("t0") <= max_bytes))
        window = written(window.select("n0", "t0", "i", "path", "total", "skipped", "inside"), "scan-files")
        last = F.max(F.when(F.col("inside"), F.struct("i", "path", "total", "skipped")))
        ends = window.groupBy("n0", "t0").agg(last.alias("end"), F.bool_or(~F.col("inside")).alias("more"))
        # the files that any name may read are few beside the index: what lies in others is left out before anything is joined by name
        read = written(window.where("inside").select("path").distinct(), "scan-paths")
        held = self._places().join(read, "path", "left_semi").withColumnRenamed("ident", "name").join(starts, "name")
        hits = held.join(window.where("inside").select("n0", "t0", "path"), ["n0", "t0", "path"])
        hits = hits.select("name", "at", "seen", "path", F.posexplode("places").alias("k", "x")).select("name", "at", "seen", "path", (F.col("k") + 1).alias("ordinal"), "x.line", "x.col")
        hits = hits.where("at IS NULL OR path <> at OR ordinal > seen")
        nth = F.row_number().over(Window.partitionBy("name").orderBy("path", "ordinal"))
        page = written(hits.withColumn("nth", nth).where(F.col("nth") <= max_results), "scan-hits")
        dropped(read)
        found = page.groupBy("name").agg(F.count(F.lit(1)).alias("hits"), F.max(F.struct("nth", "path", "ordinal")).alias("last"))
        every = files.agg(F.coalesce(F.max("skipped"), F.lit(0)).alias("all_skipped"))
        r = starts.join(ends, ["n0", "t0"], "left").join(found, "name", "left").crossJoin(F.broadcast(every))  # one row
        full = F.coalesce(F.col("hits"), F.lit(0)) >= max_results
        more = F.coalesce("more", F.lit(False))
        stop = F.when(full, "result").when(~more, "catalog_exhausted").when(F.coalesce(F.col("end.i"), F.lit(0)) >= max_files, "file").otherwise("byte")
        receipts = r.select(
            "name", F.coalesce("hits", F.lit(0)).alias("hits"), stop.alias("stop"), F.coalesce("end.i", F.lit(0)).cast("long").alias("files"), F.coalesce(F.col("end.total") - F.col("t0"), F.lit(0)).alias("bytes"),
            (F.when(more, F.coalesce("end.skipped", "k0")).otherwise(F.col("all_skipped")) - F.col("k0")).alias("oversized"), (~full & ~more & (F.col("all_skipped") == 0)).alias("complete"),
            F.when(full, F.col("last.path")).when(more, F.coalesce("end.path", "at")).alias("next_path"), F.when(full, F.col("last.ordinal")).when(more, F.lit(0)).cast("int").alias("next_ordinal"),
        )
        return Page(page.select("name", "ordinal", "path", "line", "col"), receipts)
