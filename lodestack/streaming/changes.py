"""Change feeds: normalised file events, coalescing, debounce, overflow; batch and streaming forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DEBOUNCE_MS, MOST_PENDING = 250, 1000
KINDS = ["created", "modified", "deleted", "renamed"]


def normalised(raw: DataFrame) -> DataFrame:
    """change to modified; rename to created or deleted by existence. raw: seq, at, event, path, old_path, exists."""
    kind = F.when(F.col("event") == "change", "modified").when((F.col("event") == "rename") & F.col("exists"), "created").when(F.col("event") == "rename", "deleted").otherwise(F.col("event"))
    return raw.withColumn("kind", kind)


def split_renames(events: DataFrame) -> DataFrame:
    """A rename is the deletion of the old path and then the modification of the new one. events: seq, at, kind, path, old_path."""
    two = F.array(F.struct((F.col("seq") * 2).alias("seq"), F.lit("deleted").alias("kind"), F.col("old_path").alias("path")), F.struct((F.col("seq") * 2 + 1).alias("seq"), F.lit("modified").alias("kind"), F.col("path")))
    one = F.array(F.struct((F.col("seq") * 2).alias("seq"), "kind", "path"))
    return events.select("at", F.explode(F.when(F.col("kind") == "renamed", two).otherwise(one)).alias("e")).select("e.seq", "at", "e.kind", "e.path").where("path IS NOT NULL")


def coalesced(events: DataFrame, key: list[str] = ["path"]) -> DataFrame:  # noqa: B006
    """One event for each path (or each key): the last wins, but created then modified stays created (with its time), deleted then created is modified.

    Only the events since the last deletion matter, and of those the first: so the fold is an aggregate with
    map-side combine instead of a sorted list of a path's events. A later deletion wins; after a deletion,
    creation makes modified, and modification keeps its kind.
    """
    at = F.struct("seq", "kind", "at")
    gone = F.max(F.when(F.col("kind") == "deleted", F.col("seq"))).alias("gone")
    marked = events.join(events.groupBy(*key).agg(gone), key)
    since = F.col("gone").isNull() | (F.col("seq") > F.col("gone"))
    g = marked.groupBy(*key).agg(F.max(at).alias("last"), F.min(F.when(since, at)).alias("first"), F.first("gone").alias("gone"), F.max(F.when(since & (F.col("kind") == "created"), at)).alias("made"))
    # a creation after the first event restarts at "created" and holds its time against later modifications
    kind = F.when(F.col("last.kind") == "deleted", "deleted").when(F.col("gone").isNotNull() & (F.col("first.kind") == "created") & (F.col("made.seq") == F.col("first.seq")), "modified").when(F.col("made").isNotNull(), "created").otherwise("modified")
    return g.select(*key, kind.alias("kind"), F.when(kind == "created", F.col("made.at")).otherwise(F.col("last.at")).alias("at"))


def drained(events: DataFrame, most: int = MOST_PENDING) -> DataFrame:
    """Coalesced events in drain order; one overflow row for the whole repository when there are too many paths."""
    c = coalesced(events)
    n = c.agg(F.count(F.lit(1)).alias("n"))
    some = c.join(F.broadcast(n), F.col("n") <= most).select("path", "kind", "at", F.lit("drained").alias("status"))
    over = n.where(F.col("n") > most).select(F.lit(".").alias("path"), F.lit("modified").alias("kind"), F.lit(None).cast("timestamp").alias("at"), F.lit("overflow").alias("status"))
    return some.unionByName(over).orderBy(F.concat_ws(":", "path", "kind"))


def quiet_periods(events: DataFrame, key: list[str], at: str, gap: str) -> DataFrame:
    """Sessions with no pause longer than gap: key, start, end, events. Works on streams with a watermark."""
    s = F.session_window(at, gap)
    return events.groupBy(*key, s).agg(F.count(F.lit(1)).alias("n")).select(*key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def admitted(events: DataFrame, path: str, roots: list[str], policy_reason: Column) -> DataFrame:
    """Events of source paths below an indexed root."""
    from lodestack.functions.paths import under_any

    inside = F.lit(True) if not roots or "." in roots else under_any(F.col(path), roots)
    return events.where(inside & (policy_reason == "source") & ~F.col(path).startswith("/") & ~F.col(path).contains(".."))


def batch_identity(events: DataFrame) -> DataFrame:
    """One row: a hash of the batch's events, the same however they are ordered or dealt."""
    return events.agg(F.sha2(F.concat_ws("|", F.count(F.lit(1)).cast("string"), F.coalesce(F.sum(F.xxhash64("path", "kind", "at").cast("decimal(38,0)")), F.lit(0)).cast("string")), 256).alias("batch_id"), F.count(F.lit(1)).alias("events"))


EVENTS = "seq long, at timestamp, event string, path string, old_path string, exists boolean"
#: Files of changes that a build slice takes.
SLICE_FILES = 250


def change_stream(spark: SparkSession, folder: str, per_trigger: int = SLICE_FILES) -> DataFrame:
    """Events that a watcher leaves as JSON files in a folder, at most so many files a slice; the checkpoint of the query resumes it."""
    return normalised(spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", per_trigger).json(folder))


def hook_signals(signals: DataFrame) -> DataFrame:
    """Edit notifications (seq, at, tool, path, old_path) as events, to be united with those of a watcher."""
    kind = F.when(F.col("tool").isin("write", "create"), "created").when(F.col("tool").isin("delete", "remove"), "deleted").when(F.col("tool").isin("rename", "move"), "renamed").otherwise("modified")
    return signals.where("path IS NOT NULL").select("seq", "at", kind.alias("kind"), "path", "old_path")


def drain_status(pending: int, quiet_ms: int, refreshing: bool, most: int = MOST_PENDING, debounce_ms: int = DEBOUNCE_MS) -> tuple[str, str]:
    """(status, freshness) of a look at the queue: idle while nothing is pending or the quiet period still runs, else drained or overflow."""
    if pending > most:
        return "overflow", "stale"
    if pending and quiet_ms >= debounce_ms:
        return "drained", "stale"
    return "idle", "refreshing" if refreshing else "fresh"


def run(stream: DataFrame, refresh: Callable[[DataFrame, int], None], rescan: Callable[[int], None], checkpoint: str, most: int = MOST_PENDING, available_now: bool = True, interval: str = "250 milliseconds"):
    """Starts a refresh loop that folds each micro-batch alone; too many paths lead to a rescan.

    What is pending does not outlive a micro-batch, and a repeated batch is repeated: `queue` has the loop with state and a ledger.
    """

    def one(batch: DataFrame, batch_id: int) -> None:
        once = coalesced(split_renames(batch)).persist()  # one row a path: renames are split and events folded once for both uses
        try:
            paths = once.limit(most + 1).count()
            if paths > most:
                rescan(batch_id)
            elif paths:
                refresh(once, batch_id)
        finally:
            once.unpersist()

    w = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime=interval)).start()


def numbered(events: DataFrame, order: list[str], key: str) -> DataFrame:
    """Sequence numbers within a key, for sources without one."""
    return events.withColumn("seq", F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long"))
