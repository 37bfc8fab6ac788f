"""Snapshot tables: versions, publication by compare-and-set, seeds, pruning and validity."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.shared import filesystem


def path_states(expected: DataFrame, live: DataFrame, key: str, compared: list[str]) -> DataFrame:
    """key, state: valid, missing or changed."""
    now = live.select(key, *(F.col(c).alias(f"_live_{c}") for c in compared), F.lit(True).alias("_there"))
    same = F.lit(True)
    for c in compared:
        same = same & F.col(c).eqNullSafe(F.col(f"_live_{c}"))
    return expected.join(now, key, "left").select(key, F.when(F.col("_there").isNull(), "missing").when(~same, "changed").otherwise("valid").alias("state"))


def validity(states: DataFrame, same_composition: bool | None = True, most: int = 2000) -> DataFrame:
    """One row: stale when a path is missing or changed or the composition differs; degraded when it cannot be told."""
    s = states.agg(F.count(F.lit(1)).alias("paths"), F.count_if(F.col("state").isin("missing", "changed")).alias("drifted"), F.count_if(F.col("state") == "inaccessible").alias("lost"))
    known = F.lit(same_composition)
    return s.select("paths", "drifted", F.when((F.col("drifted") > 0) | ~F.coalesce(known, F.lit(True)), "stale").when(known.isNull() | (F.col("paths") > most) | (F.col("lost") > 0), "degraded").otherwise("valid").alias("validity"))


def next_snapshot_id(snapshots: DataFrame, now_ms: int) -> int:
    return max(now_ms, (snapshots.agg(F.max("snapshot_id")).first()[0] or 0) + 1)


def seeded(tables: dict[str, DataFrame], source: int, target: int) -> dict[str, DataFrame]:
    """Rows of a snapshot under a new id; node ids do not carry the snapshot, so nothing is rewritten."""
    return {k: v.where(F.col("snapshot_id") == source).withColumn("snapshot_id", F.lit(target).cast("long")) for k, v in tables.items()}


def pruned(tables: dict[str, DataFrame], kept: DataFrame) -> dict[str, DataFrame]:
    """Tables without the rows of snapshots that are not kept."""
    return {k: v.join(kept.select("snapshot_id"), "snapshot_id", "left_semi") for k, v in tables.items()}


class PublicationConflict(RuntimeError):
    pass


class Publications:
    """States of builds: building, published, superseded, failed. A transition names the state and generations it expects.

    Without a folder the states live in this object. With one, each transition is a file of its own there, numbered by
    its place in the build's history and created only where no such file exists: that is the compare-and-set, it
    holds between processes, and a restarted driver reads all states again.
    """

    def __init__(self, spark: SparkSession | None = None, folder: str | None = None):
        self.spark, self.folder = spark, folder.rstrip("/") if folder else None
        self.log: list[tuple[int, str, str]] = []
        self._rows: dict[int, list[dict]] = {}

    @property
    def rows(self) -> dict[int, dict]:
        """The last state of each build."""
        if self.folder:
            self._rows = {}
            fs, root = filesystem(self.spark, self.folder)
            for build in fs.listStatus(root) if fs.exists(root) else []:
                own = sorted((f.getPath() for f in fs.listStatus(build.getPath())), key=lambda p: p.getName())
                self._rows[int(build.getPath().getName())] = [json.loads(self._text(fs, p)) for p in own if p.getName().endswith(".json")]
        return {k: v[-1] for k, v in self._rows.items() if v}

    @staticmethod
    def _text(fs, path) -> str:
        stream = fs.open(path)
        try:
            return bytes(b & 0xFF for b in stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _put(self, snapshot_id: int, row: dict) -> None:
        history = self._rows.setdefault(snapshot_id, [])
        if self.folder:
            fs, p = filesystem(self.spark, f"{self.folder}/{snapshot_id}/{len(history):06d}.json")
            try:
                stream = fs.create(p, False)  # fails when another process took this step
            except Exception as e:
                if not fs.exists(p):
                    raise  # a full disk is no lost race
                raise PublicationConflict(snapshot_id) from e
            stream.write(bytearray(json.dumps(row).encode()))
            stream.close()
        history.append(row)

    def start(self, snapshot_id: int, controller: int, invalidation: int) -> None:
        if snapshot_id in self.rows:
            raise PublicationConflict(snapshot_id)
        self._put(snapshot_id, {"state": "building", "controller": controller, "invalidation": invalidation})

    def finish(self, snapshot_id: int, controller: int, invalidation: int, to: str = "published") -> str:
        """Publishes when nothing newer arrived; an invalidated build is superseded instead."""
        row = self.rows.get(snapshot_id)
        if row is None or row["state"] != "building" or row["controller"] != controller:
            raise PublicationConflict(snapshot_id)
        state = "superseded" if to == "published" and row["invalidation"] < invalidation else to
        self._put(snapshot_id, row | {"state": state})
        self.log.append((snapshot_id, row["state"], state))
        return state

    def recover(self, controller: int) -> list[int]:
        """Builds of earlier controllers fail."""
        lost = [i for i, r in self.rows.items() if r["state"] == "building" and r["controller"] < controller]
        for i in lost:
            self._put(i, self._rows[i][-1] | {"state": "failed"})
            self.log.append((i, "building", "failed"))
        return lost

    def current(self) -> int | None:
        return max((i for i, r in self.rows.items() if r["state"] == "published"), default=None)


@dataclass
class Admission:
    """Refresh admission: one build at a time. A request while one runs reuses it and asks for a later generation; as it ends, one
    catch-up pass follows when more was asked for than it began with."""

    requested: int = 0
    started: int = 0
    active: bool = False

    def ask(self) -> str:
        """"start" or "reuse"."""
        self.requested += 1
        if self.active:
            return "reuse"
        self.active, self.started = True, self.requested
        return "start"

    def done(self) -> bool:
        """Whether a catch-up pass starts now."""
        if not self.active:
            raise RuntimeError("no build is active")
        self.active = self.requested > self.started
        self.started = self.requested
        return self.active


def composition_claims(units: DataFrame, key: str) -> DataFrame:
    """key, units, cleanliness, pinned, fingerprint of each composition of repositories (twenty units at most each).

    units: key, unit, available (boolean), clean and pinned (boolean or null where it cannot be told), revision. Cleanliness: blocked over
    dirty over clean; pinned revisions: blocked over mismatch over complete. The fingerprint changes with any unit's name, revision
    or availability, and not with their order.
    """
    blocked = lambda c: F.coalesce(F.bool_or(~F.col("available") | F.col(c).isNull()), F.lit(False))
    some = lambda c: F.coalesce(F.bool_or(~F.col(c)), F.lit(False))
    rows = F.array_sort(F.collect_list(F.struct("unit", "revision", "available")))
    return units.groupBy(key).agg(
        F.count(F.lit(1)).alias("units"), F.when(blocked("clean"), "blocked").when(some("clean"), "dirty").otherwise("clean").alias("cleanliness"),
        F.when(blocked("pinned"), "blocked").when(some("pinned"), "mismatch").otherwise("complete").alias("pinned"), F.sha2(F.to_json(rows), 256).alias("fingerprint"),
    )
