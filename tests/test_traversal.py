"""Traversals of many starts at once against a queue for each, and what a level reads."""

import random

import pytest
from pyspark.sql import functions as F

from lodestack.operators import graph as G
from lodestack.operators import traversal as TR
from tests.test_surfaces import brute_walk


def random_graph(seed, n_nodes=14, n_edges=40):
    r = random.Random(seed)
    nodes = [f"n{k:02d}" for k in range(n_nodes)]
    edges = [(k, r.choice(nodes), r.choice([*nodes, "gone", None])) for k in range(n_edges)]
    edges += [(n_edges + k, "n00", r.choice(nodes)) for k in range(12)] + [(n_edges + 20, "n01", "n01"), (n_edges + 21, "n01", "n02"), (n_edges + 22, "n01", "n02")]
    return nodes, edges


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    nodes, edges = random_graph(11)
    n = spark.createDataFrame([(x,) for x in nodes], "node string")
    e = spark.createDataFrame(edges, "edge_id long, source string, target string").repartition(3)
    return nodes, edges, TR.Adjacency.build(n, e, f"file://{tmp_path_factory.mktemp('adj')}", buckets=5, most=60)


CASES = [(2, 50, "both", "expand"), (3, 6, "outgoing", "expand"), (2, 9, "incoming", "expand"), (2, 9, "incoming", "strict"), (2, 1, "both", "expand"), (3, 14, "both", "strict")]


@pytest.mark.parametrize("depth,most,direction,mode", CASES)
def test_many_starts_against_a_queue_for_each(spark, built, depth, most, direction, mode):
    nodes, edges, adjacency = built
    starts = {x: [x] for x in nodes} | {"pair": ["n03", "n05"], "crowd": nodes[:8], "none": ["gone"], "some": ["gone", "n07"]}
    t = TR.traverse_many(adjacency, spark.createDataFrame([(q, x) for q, xs in starts.items() for x in xs] + [("pair", "n03")], "query string, node string"), depth, most, direction, mode)
    taken, followed = {}, {}
    for r in t.nodes.orderBy("query", "rank").collect():
        taken.setdefault(r["query"], []).append((r["node"], r["depth"]))
    for r in t.edges.orderBy("query", "rank").collect():
        followed.setdefault(r["query"], []).append((r["edge_id"], r["source"], r["target"]))
    ends = {r["query"]: (r["reached_depth"], r["truncated"]) for r in t.ends.collect()}
    for q, xs in starts.items():
        own = sorted(x for x in xs if x in nodes)
        want = brute_walk(set(nodes), [e for e in edges if e[1]], own, depth, most, direction, mode == "expand") if own else ([], [], False)
        assert (taken.get(q, []), followed.get(q, [])) == want[:2], q
        assert ends.get(q, (0, False)) == (max((d for _, d in want[0]), default=0), want[2]), q
    t.drop()


def test_one_start_is_walk(spark, built):
    nodes, edges, adjacency = built
    n = spark.createDataFrame([(x,) for x in nodes], "node string")
    e = spark.createDataFrame(edges, "edge_id long, source string, target string")
    for start in ("n01",):
        t = G.walk(n, e, [start], 2, 7, "both")
        many = TR.traverse_many(adjacency, spark.createDataFrame([("q", start)], "query string, node string"), 2, 7, "both")
        assert [(r["node"], r["depth"]) for r in many.nodes.orderBy("rank").collect()] == t.nodes
        assert many.ends.first()["truncated"] == t.truncated and many.ends.first()["reached_depth"] == t.reached_depth


def test_a_level_reads_the_buckets_of_its_frontier(spark, built):
    _, _, adjacency = built
    one = spark.createDataFrame([("n03",)], "node string")
    files = lambda df: {f.split("/")[-2] for f in df.select(F.input_file_name().alias("f")).distinct().toPandas()["f"]}
    assert len(files(adjacency.read("out", one))) == 1 and "PartitionFilters: [isnotnull(bucket" in adjacency.read("out", one)._jdf.queryExecution().toString()
    assert adjacency.read("out", one.where("false")).count() == 0


def test_hubs_are_cut_where_they_are_stored(spark, tmp_path):
    """A node with 3,000 edges keeps the places that a traversal may look at, in order."""
    e = spark.range(3000).select(F.col("id").alias("edge_id"), F.lit("hub").alias("source"), F.concat(F.lit("x"), F.col("id").cast("string")).alias("target"))
    n = e.select(F.explode(F.array("source", "target")).alias("node"))
    adjacency = TR.Adjacency.build(n, e, f"file://{tmp_path}/a", buckets=3, most=50)
    kept = spark.read.parquet(f"file://{tmp_path}/a/out").orderBy("place").collect()
    assert [r["edge_id"] for r in kept] == list(range(50)) and spark.read.parquet(f"file://{tmp_path}/a/in").count() == 3000
    with pytest.raises(ValueError):
        TR.traverse_many(adjacency, n.limit(0).withColumn("query", F.lit("q")), max_nodes=51)


def test_no_starts(spark, built):
    _, _, adjacency = built
    t = TR.traverse_many(adjacency, spark.createDataFrame([], "query string, node string"), 2, 5, "both")
    assert t.nodes.count() == t.edges.count() == t.ends.count() == 0
    t = TR.traverse_many(adjacency, spark.createDataFrame([("q", "n03")], "query string, node string"), 0, 5, "both")
    assert t.nodes.count() == 1 and t.edges.count() == 0


def test_impact_of_many_is_impact_of_each(spark, tmp_path):
    nodes, edges = random_graph(5)
    n = spark.createDataFrame([(x, f"f{k % 6}", ["parser"] if k % 3 else ["config", "heuristic"]) for k, x in enumerate(nodes)], "node string, path string, evidence_kinds array<string>")
    e = spark.createDataFrame([(i, s, t, "cloudformation-route" if i % 17 == 0 else "parser", 0.5 if i % 13 == 0 else 0.9) for i, s, t in edges if t and i < 34], "edge_id long, source string, target string, provenance string, confidence double")
    adjacency = TR.Adjacency.build(n, e, f"file://{tmp_path}/a", buckets=4)
    gone = spark.createDataFrame([("f5",)], "path string")
    for missing, most in ((None, 4), (gone, 50)):
        got = {r["start"]: r for r in TR.impact_of_changed(adjacency, n, n.select("node"), max_depth=1, max_nodes=most, missing=missing).collect()}
        assert set(got) == set(nodes)
        for x in nodes[::6]:
            assert got[x] == G.impact(n, e, x, max_depth=1, max_nodes=most, missing=missing).first(), x
