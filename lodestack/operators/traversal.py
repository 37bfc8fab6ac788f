"""Bounded traversal of many starts at once, over edges stored by their ends.

`Adjacency` keeps every edge twice in a folder, once by its source and once by its target, in buckets of the node's hash and
sorted by node and place. An edge's place is its number among the edges of its node; a traversal that may take m nodes never
looks at an edge beyond place m, so no hub is read whole. A level of a traversal reads the buckets of its frontier alone.

`traverse_many` gives each query (a set of start nodes with a budget of its own) what the first-in-first-out traversal `graph.walk` gives
for it: nodes are numbered as a queue would take them, by aggregates and windows within a query, level by level for all
queries together. Nothing comes to the driver but the numbers of the buckets that a level needs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestack.shared import dropped, written

#: Buckets, and places of a node's edges that are kept: max_nodes of a traversal must not be larger.
BUCKETS, MOST = 64, 200


def _bucket(node: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(node), F.lit(buckets)).cast("int")


class Adjacency:
    """Tables in a folder: `out` and `in` (bucket, node, far, known, place, edge_id, carried columns) and `nodes` (bucket, node).

    known tells whether the far end is a node. Outgoing edges are placed by edge_id, incoming ones by source and edge_id.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int, most: int):
        self.spark, self.folder, self.buckets, self.most = spark, folder.rstrip("/"), buckets, most

    @classmethod
    def build(cls, nodes: DataFrame, edges: DataFrame, folder: str, buckets: int = BUCKETS, most: int = MOST) -> Adjacency:
        """nodes: node; edges: edge_id, source, target and columns to be carried along. Edges without a source or target are left out there."""
        out = cls(edges.sparkSession, folder, buckets, most)
        carried = [c for c in edges.columns if c not in ("edge_id", "source", "target")]
        own = nodes.select("node").where("node IS NOT NULL").distinct()
        there = own.select(F.col("node").alias("far"), F.lit(True).alias("known"))
        out._write("nodes", own, ["node"])
        for name, near, far, order in (("out", "source", "target", ["edge_id"]), ("in", "target", "source", ["far", "edge_id"])):
            e = edges.where(F.col(near).isNotNull()).select(F.col(near).alias("node"), F.col(far).alias("far"), "edge_id", *carried)
            e = e.withColumn("place", F.row_number().over(Window.partitionBy("node").orderBy(*order))).where(F.col("place") <= most)  # hubs are cut before they are shuffled
            e = e.join(there, "far", "left").withColumn("known", F.coalesce("known", F.lit(False)))
            out._write(name, e, ["node", "place"])
        return out

    def _write(self, name: str, df: DataFrame, order: list[str]) -> None:
        placed = df.withColumn("bucket", _bucket(F.col("node"), self.buckets))
        placed.repartition(self.buckets, "bucket").sortWithinPartitions("bucket", *order).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/{name}")

    def read(self, name: str, near: DataFrame) -> DataFrame:
        """Rows of the buckets in which a node of `near` may lie: other files are not opened."""
        held = [r[0] for r in near.select(_bucket(F.col("node"), self.buckets).alias("b")).distinct().collect()]  # at most as many as there are buckets
        df = self.spark.read.parquet(f"{self.folder}/{name}")
        return df.where(F.col("bucket").isin(held) if held else F.lit(False)).drop("bucket")


class Traversals:
    """nodes: query, node, depth, rank; edges: query, edge_id, source, target, rank, carried columns; ends: query, reached_depth, truncated. Tables of the shared folder."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, ends: DataFrame, kept: list[DataFrame]):
        self.nodes, self.edges, self.ends, self._kept = nodes, edges, ends, kept

    def drop(self) -> None:
        dropped(*self._kept)


def _all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def traverse_many(adjacency: Adjacency, starts: DataFrame, max_depth: int = 2, max_nodes: int = 50, direction: str = "outgoing", mode: str = "expand") -> Traversals:
    """The traversal of each query. starts: query, node; the start nodes of a query are taken in their order, those that are no nodes are skipped.

    As a node of rank r is taken, max(1, max_nodes - r) of its edges count in each direction, outgoing ones first. mode
    "expand" goes on to the sources of incoming edges, "strict" lists these edges without going there. A query without
    any node has no rows. truncated: something was still queued when the last node that the budget allows was taken.
    """
    if max_nodes > adjacency.most or max_nodes < 1:
        raise ValueError(f"max_nodes must be 1 to {adjacency.most}, the places that are kept")
    if direction not in ("outgoing", "incoming", "both") or mode not in ("expand", "strict"):
        raise ValueError("direction: outgoing, incoming or both; mode: expand or strict")
    routes = [(r, name) for r, name, on in ((0, "out", direction != "incoming"), (1, "in", direction != "outgoing")) if on]
    entry = F.struct(F.col("parent"), F.col("route"), F.col("place"))
    none = F.lit(0)
    asked = starts.where("query IS NOT NULL").select("query", "node").distinct()
    first = asked.join(adjacency.read("nodes", asked), "node", "left_semi").withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("node")))
    queued = written(first.select("query", "node", "rank", F.struct(none.alias("parent"), none.alias("route"), F.col("rank").alias("place")).alias("entry")), "walk-starts")
    kept, levels, entries = [queued], [queued.where(F.col("rank") <= max_nodes).withColumn("depth", F.lit(0))], []
    waiting = [queued.groupBy("query").agg(F.max("entry").alias("last"))]
    for depth in range(max_depth):
        here = levels[-1].select("query", "node", F.col("rank").alias("parent"))
        if here.isEmpty():
            break
        found = [here.join(adjacency.read(name, here), "node").where(F.col("place") <= F.greatest(F.lit(1), F.lit(max_nodes) - F.col("parent"))).withColumn("route", F.lit(r)) for r, name in routes]
        level = written(_all(found), "walk-entries")
        kept.append(level)
        entries.append(level)
        taken = _all(levels).select("query", F.col("node").alias("far"), F.col("rank").alias("before"))
        going = level.where("known") if mode == "expand" else level.where("known AND route = 0")
        going = going.join(taken, ["query", "far"], "left").where("before IS NULL OR before > parent").select("query", F.col("far").alias("node"), "before", entry.alias("entry"))
        waiting.append(going.groupBy("query").agg(F.max("entry").alias("last")))
        new = going.where("before IS NULL").groupBy("query", "node").agg(F.min("entry").alias("entry"))
        so_far = _all(levels).groupBy("query").agg(F.max("rank").alias("n"))
        numbered = new.withColumn("nth", F.row_number().over(Window.partitionBy("query").orderBy("entry"))).join(so_far, "query").withColumn("rank", F.col("n") + F.col("nth"))
        after = written(numbered.where(F.col("rank") <= max_nodes).select("query", "node", "rank", "entry", F.lit(depth + 1).alias("depth")), "walk-level")
        kept.append(after)
        levels.append(after)
    nodes = _all(levels)
    last = _all(waiting).groupBy("query").agg(F.max("last").alias("last"))
    ends = nodes.groupBy("query").agg(F.max("depth").alias("reached_depth"), F.max(F.struct("rank", "entry")).alias("end")).join(last, "query")
    ends = ends.select("query", "reached_depth", ((F.col("end.rank") == max_nodes) & (F.col("last") > F.col("end.entry"))).alias("truncated"))
    return Traversals(nodes.select("query", "node", "depth", F.col("rank").cast("long").alias("rank")), _edges(entries, starts, adjacency), ends, kept)


def _edges(entries: list[DataFrame], starts: DataFrame, adjacency: Adjacency) -> DataFrame:
    """Each edge of a query once, numbered by its first place."""
    every = _all(entries) if entries else adjacency.read("out", starts.where(F.lit(False))).join(starts.where(F.lit(False)).select("query", "node"), "node").withColumns({"parent": F.lit(0), "route": F.lit(0)})
    ends = {"source": F.when(F.col("route") == 0, F.col("node")).otherwise(F.col("far")), "target": F.when(F.col("route") == 0, F.col("far")).otherwise(F.col("node"))}
    carried = [c for c in every.columns if c not in ("query", "node", "far", "known", "place", "edge_id", "parent", "route")]
    row = F.struct("parent", "route", "place", *(v.alias(k) for k, v in ends.items()), *carried)
    once = every.groupBy("query", "edge_id").agg(F.min(row).alias("e"))
    nth = F.row_number().over(Window.partitionBy("query").orderBy("e.parent", "e.route", "e.place")).cast("long")
    return once.withColumn("rank", nth).select("query", "edge_id", "e.source", "e.target", "rank", *(F.col(f"e.{c}").alias(c) for c in carried))


def impact_of_changed(adjacency: Adjacency, nodes: DataFrame, changed: DataFrame, max_depth: int = 2, max_nodes: int = 50, direction: str = "both", mode: str = "expand", missing: DataFrame | None = None) -> DataFrame:
    """What a change to each of many nodes may reach: a row of graph.impact for each start that is a node.

    nodes: node, path, evidence_kinds (array); changed: node (or query, node where several nodes make one change); the
    adjacency carries provenance and confidence. missing: paths that are gone; a start whose traversal touches
    one has an empty row with confidence low/empty and stale true.
    """
    starts = changed if "query" in changed.columns else changed.select(F.col("node").alias("query"), "node")
    walked = traverse_many(adjacency, starts, max_depth, max_nodes, direction, mode)
    gone = F.lit(False)
    own = walked.nodes.select("query", "node").join(nodes.select("node", "path", "evidence_kinds"), "node")
    if missing is not None:
        own = own.join(missing.select("path", F.lit(True).alias("_gone")).distinct(), "path", "left")
        gone = F.coalesce(F.bool_or("_gone"), F.lit(False))
    kinds = own.groupBy("query").agg(F.count(F.lit(1)).alias("symbols"), F.array_sort(F.collect_set("path")).alias("files"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence_kinds")))).alias("evidence_kinds"), gone.alias("stale"))
    used = walked.edges.groupBy("query").agg(F.count(F.lit(1)).alias("edges"), F.coalesce(F.bool_or(F.col("provenance").contains("cloudformation")), F.lit(False)).alias("cf"), F.coalesce(F.bool_or(F.col("confidence") < 0.7), F.lit(False)).alias("low"))
    both = kinds.join(walked.ends, "query").join(used, "query", "left").fillna({"edges": 0, "cf": False, "low": False})
    stale, local = F.col("stale"), F.size("files") <= 1
    level = F.when(stale | (F.col("edges") == 0), "low/empty").when(local, "low/local_only").when(F.col("cf") | F.col("low"), "low/graph").when(F.col("truncated"), "medium/graph").otherwise("high/graph")
    shown = F.when((F.col("edges") > 0) & ~local & F.col("cf"), F.array(F.lit("config"), F.lit("infra_parser"))).otherwise(F.col("evidence_kinds"))
    void = F.array().cast("array<string>")
    zero = lambda c: F.when(stale, F.lit(0)).otherwise(F.col(c))
    out = both.select(
        F.col("query").alias("start"), zero("symbols").cast("long").alias("symbols"), F.when(stale, void).otherwise(F.col("files")).alias("files"), zero("edges").cast("long").alias("edges"),
        zero("reached_depth").cast("int").alias("reached_depth"), "truncated", level.alias("confidence"), F.when(stale, void).otherwise(shown).alias("evidence_kinds"), "stale",
    )
    return out
