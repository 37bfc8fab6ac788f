"""Shared Spark plumbing of the operators: Arrow batches, tidy workers, tables, held-out rows."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.shared import dropped, shared_dir, spread, written  # noqa: F401
from lodestack.shipping import ship

#: Rows and bytes of an Arrow batch handed to Python: a batch of long texts stays small.
ARROW_ROWS, ARROW_BYTES = 400, 8 << 20


def prepare(spark: SparkSession) -> None:
    """Makes this package importable on executors, and lowers the session's Arrow batch limits to ours where they are higher.

    The limits stay: DataFrames are lazy, and a plan takes them when it runs.
    """
    for key, most in (("maxRecordsPerBatch", ARROW_ROWS), ("maxBytesPerBatch", ARROW_BYTES)):
        now = str(spark.conf.get(f"spark.sql.execution.arrow.{key}"))
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(most))
    ship(spark)


def tidy() -> None:
    """Gives freed memory of this Python worker back to the system: workers are used again by later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


#: What a Python worker keeps between tasks, by name: how to forget it.
WARM: dict[str, Callable[[], None]] = {}


def arrow_map(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema, warm: str = "") -> DataFrame:
    """df.mapInArrow(run, schema); each task leaves its worker tidy, and forgets what others than `warm` have kept there."""
    prepare(df.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, forget in WARM.items():
            if name != warm:
                forget()
        try:
            yield from run(batches)
        finally:
            tidy()

    return df.mapInArrow(task, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; one of a few MB that lies in a single file is dealt out over the cores."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def crc_mod(id_col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null ids give null."""
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(n))
