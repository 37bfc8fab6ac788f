"""The evidence store: joins of its tables, point lookups, counters, and sinks that replace the rows of a snapshot."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.operators.relational import longest_prefix, replace_rows
from lodestack.shared import filesystem
from lodestack.versions import Conflict, Versions

# Joins.


def when_set(df: DataFrame, **values) -> DataFrame:
    """Rows in which each column equals its value; a value of None does not filter."""
    for name, v in values.items():
        if v is not None:
            df = df.where(F.col(name) == F.lit(v))
    return df


def node_files(nodes: DataFrame, files: DataFrame, snapshot=None, path: str | None = None) -> DataFrame:
    """Nodes with path and snapshot_id of their file, of one snapshot and path where these are given."""
    return nodes.join(when_set(files, snapshot_id=snapshot, path=path).select("file_id", "snapshot_id", "path"), "file_id")


def edge_sites(edges: DataFrame, nodes: DataFrame, files: DataFrame, snapshot=None) -> DataFrame:
    """Edges with snapshot_id and path of their source."""
    at = node_files(nodes, files, snapshot).select(F.col("node_id").alias("source_node_id"), "snapshot_id", "path")
    return edges.join(at, "source_node_id")


def edge_ends(edges: DataFrame, nodes: DataFrame, files: DataFrame, snapshot=None) -> DataFrame:
    """Edges both ends of which lie in one snapshot, with source_path and target_path; edges without a target go."""
    at = node_files(nodes, files, snapshot)
    side = lambda k: at.select(F.col("node_id").alias(f"{k}_node_id"), F.col("path").alias(f"{k}_path"), F.col("snapshot_id").alias(f"{k}_snapshot"))
    out = edges.where("target_node_id IS NOT NULL").join(side("source"), "source_node_id").join(side("target"), "target_node_id").where("source_snapshot = target_snapshot")
    return out.drop("target_snapshot").withColumnRenamed("source_snapshot", "snapshot_id")


def unresolved_sites(refs: DataFrame, files: DataFrame, snapshot=None, path: str | None = None) -> DataFrame:
    """Unresolved references with snapshot_id and path of their file."""
    return refs.join(when_set(files, snapshot_id=snapshot, path=path).select("file_id", "snapshot_id", "path"), "file_id")


def latest_with_docs(snapshots: DataFrame, documents: DataFrame, repo: str) -> DataFrame:
    """snapshot_id and docs of the latest snapshot of each repository that has documents."""
    some = documents.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("docs"))
    return snapshots.join(some, "snapshot_id").groupBy(repo).agg(F.max(F.struct("snapshot_id", "docs")).alias("x")).select(repo, "x.snapshot_id", "x.docs")


def with_repository(hits: DataFrame, units: DataFrame, path: str = "path") -> DataFrame:
    """hits with the repository unit of their path: each distinct path is looked up once."""
    paths = hits.select(path).distinct()
    return hits.join(longest_prefix(paths, path, units, "path_prefix", "repository_key"), path, "left")


def file_at(files: DataFrame, snapshot, path: str) -> DataFrame:
    """The file of a snapshot and path: no row or one."""
    return when_set(files, snapshot_id=snapshot, path=path).limit(1)


def node_at(nodes: DataFrame, files: DataFrame, snapshot, node_id) -> DataFrame:
    return node_files(nodes.where(F.col("node_id") == F.lit(node_id)), files, snapshot).limit(1)


# Counters.


def counts_by(df: DataFrame, key, **tests: Column) -> DataFrame:
    """key, n and one count for each named test, in one pass (rows for which the test is true)."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *(F.count_if(t).alias(name) for name, t in tests.items()))


def next_ids(df: DataFrame, key, ident: str) -> DataFrame:
    """key, latest_id and the next id that is free."""
    return df.groupBy(key).agg(F.max(ident).alias("latest_id"), (F.coalesce(F.max(ident), F.lit(0)) + 1).alias("next_id"))


def latest_where(df: DataFrame, snapshot: str, test: Column) -> DataFrame:
    """The latest snapshot that has a row of which the test is true: no row or one."""
    return df.groupBy(F.col(snapshot).alias("snapshot_id")).agg(F.count_if(test).alias("n")).where("n > 0").orderBy(F.desc("snapshot_id")).limit(1).select("snapshot_id")


def with_node_counts(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """files with node_count as it is now."""
    n = nodes.groupBy("file_id").agg(F.count(F.lit(1)).cast("int").alias("_nodes"))
    keep = [c for c in files.columns if c != "node_count"]
    return files.select(*keep).join(n, "file_id", "left").select(*keep, F.coalesce("_nodes", F.lit(0)).alias("node_count"))


def accumulated(slices: DataFrame, key: list[str], counters: list[str], order: str, last: list[str]) -> DataFrame:
    """Sums of the counters over all slices of a build or pages of a scan, and the latest value of the columns `last`."""
    return slices.groupBy(*key).agg(F.count(F.lit(1)).alias("slices"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counters), *(F.max_by(c, order).alias(c) for c in last))


def surface_health(surfaces: DataFrame) -> DataFrame:
    """One row: surfaces by status and the verdict on the whole. surfaces: name, status (healthy, degraded, blocked, unknown)."""
    n = lambda s: F.count_if(F.col("status") == s)
    verdict = F.when(n("blocked") > 0, "blocked").when(n("degraded") > 0, "degraded").when((n("unknown") > 0) | (F.count(F.lit(1)) == 0), "unknown").otherwise("healthy")
    return surfaces.agg(F.count(F.lit(1)).alias("surfaces"), *(n(s).alias(s) for s in ("healthy", "degraded", "blocked", "unknown")), verdict.alias("verdict"))


# Sinks.


class SnapshotTables:
    """Tables of snapshots in a folder. What a snapshot's table consists of is a path in the folder's current state (`versions`).

    A writer puts its rows beside what is there and publishes a state that names them: until then, and if it is lost on the way, readers see
    what they saw. A state covers all tables, so the tables of one call change together. The rows of a frame may come from the very
    table that they replace. Files that no state needs go with `vacuum`.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.versions = Versions(spark, f"{self.folder}/versions")

    def state(self) -> dict[str, dict[str, str]]:
        """The path of each table and snapshot."""
        return (self.versions.latest()[1] or {"tables": {}})["tables"]

    def exists(self, table: str) -> bool:
        return table in self.state()

    def _open(self, path: str, snapshot) -> DataFrame:
        return self.spark.read.parquet(path).withColumn("snapshot_id", F.lit(int(snapshot)).cast("long"))

    def read(self, table: str, snapshot=None) -> DataFrame:
        """Rows with snapshot_id; of a snapshot without rows, none."""
        parts = self.state()[table]
        if snapshot is None:
            return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), (self._open(p, k) for k, p in sorted(parts.items())))
        own = parts.get(str(snapshot))
        return self._open(own, snapshot) if own else self._open(next(iter(parts.values())), snapshot).limit(0)

    def _written(self, table: str, df: DataFrame) -> str:
        path = f"{self.folder}/{table}/{uuid.uuid4().hex}"
        df.drop("snapshot_id").write.parquet(path)
        return path

    def _publish(self, change: Callable[[dict], None], tries: int = 20) -> None:
        """Publishes the current state with a change made to it; where another writer was first, to that one's state."""
        for left in range(tries - 1, -1, -1):
            number, state = self.versions.latest()
            tables = (state or {"tables": {}})["tables"]
            change(tables)
            try:
                return self.versions.publish(number + 1, {"tables": tables})
            except Conflict:
                if not left:
                    raise

    def _put(self, snapshot: int, paths: dict[str, str], base: dict[str, str | None] | None = None) -> None:
        """base: what the tables must still consist of, where the new rows were made from it."""

        def change(tables: dict) -> None:
            for name, path in paths.items():
                own = tables.setdefault(name, {})
                if base is not None and own.get(str(snapshot)) != base.get(name):
                    raise Conflict(f"{name} of snapshot {snapshot} has changed meanwhile")
                own[str(snapshot)] = path

        self._publish(change)

    def replace(self, snapshot: int, **tables: DataFrame) -> None:
        """Puts the given rows in place of what the snapshot had in these tables (documents, headings, concerns and the like), all at once."""
        self._put(snapshot, {name: self._written(name, df) for name, df in tables.items()})

    def _without(self, snapshot: int, paths: DataFrame, tables: dict[str, DataFrame | None]) -> tuple[dict[str, str], dict[str, str | None]]:
        state = self.state()
        gone, out = paths.select("path").distinct(), {}
        for name, new in tables.items():
            kept = self.read(name, snapshot).join(gone, "path", "left_anti")
            out[name] = self._written(name, kept if new is None else kept.drop("snapshot_id").unionByName(new.drop("snapshot_id")))
        return out, {name: state[name].get(str(snapshot)) for name in tables}

    def replace_files(self, snapshot: int, paths: DataFrame, **tables: DataFrame | None) -> None:
        """Extraction of changed files: rows of these paths go from every table, and the given rows come; other files keep theirs.

        Tables carry `path`. A table that is given as None only loses the paths. Raises Conflict when another writer has changed
        one of them meanwhile: its rows are not lost.
        """
        self._put(snapshot, *self._without(snapshot, paths, tables))

    def remove_file(self, snapshot: int, path: str, *tables: str) -> None:
        """Removes an entry from tables; the coverage of the snapshot no longer holds and becomes stale, in the same state."""
        out, base = self._without(snapshot, self.spark.range(1).select(F.lit(path).alias("path")), dict.fromkeys(tables))
        own = self.state().get("coverage", {}).get(str(snapshot))
        if own:
            stale = self._open(own, snapshot).withColumn("state", F.lit("stale")).withColumn("reason", F.lit("catalog_entry_removed"))
            out["coverage"], base["coverage"] = self._written("coverage", stale), own
        self._put(snapshot, out, base)

    def seed(self, source: int, target: int, *tables: str) -> None:
        """The target snapshot starts with the rows of the source one. No row is copied: both name the same files until one is replaced."""

        def change(state: dict) -> None:
            for name in tables:
                if str(source) in state.get(name, {}):
                    state[name][str(target)] = state[name][str(source)]

        self._publish(change)

    def drop_snapshot(self, snapshot: int, *tables: str) -> None:
        """The schema of a table stays, also when its last snapshot goes."""

        def change(state: dict) -> None:
            for name in tables:
                own = state.get(name, {})
                if set(own) == {str(snapshot)}:
                    own[str(snapshot)] = self._written(name, self._open(own[str(snapshot)], snapshot).limit(0))
                else:
                    own.pop(str(snapshot), None)

        self._publish(change)

    def vacuum(self) -> int:
        """Deletes files and states that the current state does not need; how many folders. Only where nobody reads or writes an earlier one."""
        state, n = self.state(), 0
        used = {p.rsplit("/", 1)[-1] for own in state.values() for p in own.values()}
        for name in state:
            fs, root = filesystem(self.spark, f"{self.folder}/{name}")
            for f in fs.listStatus(root) if fs.exists(root) else []:
                if f.getPath().getName() not in used:
                    fs.delete(f.getPath(), True)
                    n += 1
        self.versions.prune(1)
        return n


def upserted(current: DataFrame, changed: DataFrame, key: list[str]) -> DataFrame:
    """current with the rows of changed in place of those of equal keys."""
    return replace_rows(current, changed, key)


# Edits: previewed against the content they were written for. Nothing is written to a workspace here.


def preview_edits(files: DataFrame, edits: DataFrame, reason: str | None = None) -> DataFrame:
    """path, state and token of each edit. files: path, content_hash and, where given, the policy's reason; edits: path, old_hash, new_hash.

    applies: the file is as the edit expects; drifted: it changed; missing: it is gone (an edit without old_hash makes a new
    file, which applies then); refused: the path policy keeps it from being written. The token binds a later application to what
    was previewed: it differs as soon as path, old or new content do.
    """
    live = files.select("path", "content_hash", *([F.col(reason).alias("_reason")] if reason else [F.lit("source").alias("_reason")]), F.lit(True).alias("_there"))
    e = edits.join(live, "path", "left")
    state = F.when(F.coalesce(F.col("_reason"), F.lit("source")) != "source", "refused").when(F.col("_there").isNull(), F.when(F.col("old_hash").isNull(), "applies").otherwise("missing")).when(F.col("content_hash").eqNullSafe(F.col("old_hash")), "applies").otherwise("drifted")
    token = F.sha2(F.to_json(F.array("path", "old_hash", "new_hash")), 256)
    return e.select("path", state.alias("state"), F.when(state == "applies", token).alias("token"))
