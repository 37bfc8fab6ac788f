"""The change queue of each repository: sessions of events, folded by path, given out after a quiet period.

The batch form (`queue_drains`) and the streaming one (`stateful_drains`) give the same rows. A session of a repository ends
where its next event comes a debounce or more later; its events are folded by path as `changes.coalesced` does; more distinct
paths than the budget make it one overflow row, which asks for a rescan. In the stream, pending paths are state: a session
may lie in any number of micro-batches and outlive a restart. Events of a repository have to arrive in order of time from one
micro-batch to the next (within one they may come in any order); the watermark's delay keeps those of equal times.

`process` runs a stream of drains through a ledger of batches, so that a batch that Spark repeats after a failure changes nothing.

Defined cases: renames are split before; rows without a path, time or repository are left out; of events with equal times the
sequence number decides; an empty stream gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from lodestack.shared import filesystem
from lodestack.shipping import ship
from lodestack.streaming.changes import DEBOUNCE_MS, MOST_PENDING, coalesced

#: Drained rows; at and session (its first event) are times of events.
DRAINS = "repository string, session timestamp, status string, path string, kind string, at timestamp"
#: Width of the time buckets by which long histories are cut into sessions.
BUCKET_S = 3600
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _clean(events: DataFrame) -> DataFrame:
    return events.where("repository IS NOT NULL AND path IS NOT NULL AND at IS NOT NULL")


def with_sessions(events: DataFrame, gap_ms: int = DEBOUNCE_MS, bucket_s: int = BUCKET_S) -> DataFrame:
    """events (repository, at, seq, ...) with `session`, the time of the first event of its session.

    Windows are partitioned by repository and time bucket; what a bucket hands to the next one is a row: so a
    repository with a third of all events is many partitions, not one.
    """
    micros = F.unix_micros(F.col("at").cast("timestamp"))
    cut = events.withColumn("_b", F.floor(micros / F.lit(bucket_s * 1_000_000)))
    order = Window.partitionBy("repository", "_b").orderBy("at", "seq")
    buckets = Window.partitionBy("repository").orderBy("_b")
    ends = cut.groupBy("repository", "_b").agg(F.max("at").alias("_end")).withColumn("_before", F.lag("_end").over(buckets)).drop("_end")
    before = F.coalesce(F.lag("at").over(order), F.col("_before"))
    begins = F.when(before.isNull() | (micros - F.unix_micros(before.cast("timestamp")) >= gap_ms * 1000), F.col("at"))
    begun = cut.join(ends, ["repository", "_b"]).withColumn("_begins", begins)
    carried = begun.groupBy("repository", "_b").agg(F.max("_begins").alias("_last")).withColumn("_carry", F.last("_last", ignorenulls=True).over(buckets.rowsBetween(Window.unboundedPreceding, -1))).drop("_last")
    own = F.last("_begins", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return begun.withColumn("_own", own).join(carried, ["repository", "_b"]).withColumn("session", F.coalesce("_own", "_carry")).drop("_b", "_before", "_begins", "_own", "_carry")


def queue_drains(events: DataFrame, gap_ms: int = DEBOUNCE_MS, most: int = MOST_PENDING, bucket_s: int = BUCKET_S) -> DataFrame:
    """What the queue of each repository gives out over all events (repository, seq, at, kind, path; renames split)."""
    key = ["repository", "session"]
    cut = with_sessions(_clean(events), gap_ms, bucket_s)
    folded = coalesced(cut, [*key, "path"])
    sizes = folded.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most)
    last = cut.groupBy(*key).agg(F.max("at").alias("at"))
    some = folded.join(sizes, key, "left_anti").select(*key, F.lit("drained").alias("status"), "path", "kind", "at")
    over = sizes.join(last, key).select(*key, F.lit("overflow").alias("status"), F.lit(".").alias("path"), F.lit("modified").alias("kind"), "at")
    return some.unionByName(over)


class _Queue(StatefulProcessor):
    """State of a repository: times of the first and the last event, whether it overflowed, and the pending paths with kind and time (microseconds)."""

    def __init__(self, gap_ms: int, most: int, by_event: bool):
        self.gap_ms, self.most, self.by_event = gap_ms, most, by_event

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("queue", "first long, last long, over boolean, timer long, paths array<string>, kinds array<string>, times array<long>")

    def _load(self) -> None:
        s = self.state.get() if self.state.exists() else None
        self.first, self.last, self.over, self.timer = (s[0], s[1], s[2], s[3]) if s else (None, None, False, None)
        self.pending = dict(zip(s[4], zip(s[5], s[6]))) if s else {}

    def _apply(self, at: int, kind: str, path: str) -> None:
        self.first = at if self.first is None else self.first
        self.last = at
        if self.over:
            return
        if path not in self.pending and len(self.pending) >= self.most:
            self.pending, self.over = {}, True
            return
        before = self.pending.get(path)
        if kind == "modified" and before and before[0] == "created":
            kind, at = before
        elif kind == "created" and before and before[0] == "deleted":
            kind = "modified"
        self.pending[path] = kind, at

    def _drained(self, repository: str, out: list[tuple]) -> None:
        if self.over:
            out.append((repository, self.first, "overflow", ".", "modified", self.last))
        else:
            out += [(repository, self.first, "drained", p, k, at) for p, (k, at) in self.pending.items()]
        self.first, self.last, self.over, self.pending = None, None, False, {}

    def _keep(self, now_ms: int) -> None:
        if self.timer is not None:
            self.handle.deleteTimer(self.timer)
        if self.first is None:
            self.state.clear()
            return
        self.timer = (-(-self.last // 1000) if self.by_event else now_ms) + self.gap_ms
        self.handle.registerTimer(self.timer)
        self.state.update((self.first, self.last, self.over, self.timer, list(self.pending), [k for k, _ in self.pending.values()], [at for _, at in self.pending.values()]))

    def _rows(self, out: list[tuple]) -> Iterator[pd.DataFrame]:
        if out:
            df = pd.DataFrame(out, columns=["repository", "session", "status", "path", "kind", "at"])
            for c in ("session", "at"):
                df[c] = pd.to_datetime(df[c], unit="us", utc=True)
            yield df

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        self._load()
        out: list[tuple] = []
        events = sorted(e for b in rows for e in zip(b["micros"].tolist(), b["seq"].tolist(), b["kind"].tolist(), b["path"].tolist()))
        for at, _, kind, path in events:
            if self.by_event and self.last is not None and at - self.last >= self.gap_ms * 1000:
                self._drained(key[0], out)
            self._apply(at, kind, path)
        self._keep(timerValues.getCurrentProcessingTimeInMs() if not self.by_event else 0)
        yield from self._rows(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._load()
        out: list[tuple] = []
        if self.timer == expiredTimerInfo.getExpiryTimeInMs():
            self.timer = None  # it is gone by itself
            self._drained(key[0], out)
            self.state.clear()
        yield from self._rows(out)


def stateful_drains(stream: DataFrame, gap_ms: int = DEBOUNCE_MS, most: int = MOST_PENDING, time: str = "event", delay: str = "1 second") -> DataFrame:
    """DRAINS of a stream of events (repository, seq, at, kind, path; renames split).

    time "event": quiet is told by the times of events, as queue_drains tells it, and a session is given out once the watermark
    (the latest event less the delay) has passed its end. time "processing": a session ends when nothing has arrived
    for the debounce by the clock of the executors. Sets the session's state store to RocksDB, which this state needs.
    """
    if time not in ("event", "processing"):
        raise ValueError("time is event or processing")
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    ship(spark)
    own = _clean(stream)
    if time == "event":
        own = own.withWatermark("at", delay)
    own = own.select("repository", "at", "seq", "kind", "path", F.unix_micros("at").alias("micros"))
    processor = _Queue(gap_ms, most, time == "event")
    return own.groupBy("repository").transformWithStateInPandas(processor, DRAINS, "append", "EventTime" if time == "event" else "ProcessingTime")


class Ledger:
    """Batches that are done, as files of a shared folder named by their number: the record is made after the batch's effects and is there once.

    What a batch is, is told by the hash of its rows: a number that comes again with other rows is an error, not a repetition.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _file(self, batch: int):
        return filesystem(self.spark, f"{self.folder}/{batch:020d}")

    def identity(self, batch: int) -> str | None:
        """The hash of a batch that is done, None for another one."""
        fs, p = self._file(batch)
        if not fs.exists(p):
            return None
        with_stream = fs.open(p)
        try:
            return bytes(with_stream.readAllBytes()).decode()
        finally:
            with_stream.close()

    def record(self, batch: int, identity: str) -> None:
        fs, p = self._file(batch)
        _, beside = filesystem(self.spark, f"{self.folder}/.{batch:020d}.{identity[:16]}")
        out = fs.create(beside, True)
        try:
            out.write(bytearray(identity.encode()))
        finally:
            out.close()
        if not fs.rename(beside, p) and self.identity(batch) != identity:  # whole or not at all
            raise RuntimeError(f"batch {batch} cannot be recorded in {self.folder}")

    def once(self, batch: int, identity: str, effects: Callable[[], None]) -> bool:
        """Runs the effects of a batch that is not done yet; whether it did."""
        known = self.identity(batch)
        if known is not None:
            if known != identity:
                raise RuntimeError(f"batch {batch} was done with other rows")
            return False
        effects()
        self.record(batch, identity)
        return True


def drain_identity(drains: DataFrame) -> str:
    """A hash of drained rows, the same however they are ordered or dealt."""
    row = F.xxhash64("repository", "session", "status", "path", "kind", "at").cast("decimal(38,0)")
    n, total = drains.agg(F.count(F.lit(1)), F.coalesce(F.sum(row), F.lit(0))).first()
    return f"{n}-{total}"


def process(drains: DataFrame, refresh: Callable[[DataFrame, int], None], rescan: Callable[[list[str], int], None], ledger: Ledger, checkpoint: str, available_now: bool = True, interval: str = "250 milliseconds"):
    """Starts the refresh loop over a stream of drains: each micro-batch once, by the ledger.

    refresh gets the drained rows of a batch, rescan the repositories that overflowed (a session's row each). A batch that
    failed after its effects and before its record runs again with the same number: effects are to replace, not to add.
    """

    def one(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            identity = drain_identity(batch)
            if identity.startswith("0-"):
                return

            def effects() -> None:
                over = [r[0] for r in batch.where("status = 'overflow'").select("repository").distinct().orderBy("repository").toLocalIterator()]
                if over:
                    rescan(over, number)
                some = batch.where("status = 'drained'")
                if not some.isEmpty():
                    refresh(some, number)

            ledger.once(number, identity, effects)
        finally:
            batch.unpersist()

    w = drains.writeStream.foreachBatch(one).outputMode("append").option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime=interval)).start()
