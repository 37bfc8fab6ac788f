"""Operators over more rows than any bound they once had."""

from collections import Counter

import __spark_entry__
from lodestack.operators import graph as G


def test_handler_groups_number_every_row(spark):
    hits = [(f"h{k}", f"t{k % 3}", f"l{k % 50}", k % 4) for k in range(2500)]
    anchors = [(f"f{k}", f"h{k * 7 % 2600}") for k in range(600)] + [("f0", "h9"), ("h5", "h6")]
    at = {i: (t, c, r, i) for i, t, c, r in hits}
    first = {i: (key, 0) for i, key in at.items()}
    for i, b in anchors:
        if b in at:
            first[i] = min(first.get(i, (at[b], 1)), (at[b], 1))
    want = {i: n for n, (_, i) in enumerate(sorted((v, i) for i, v in first.items()), 1)}
    h = spark.createDataFrame(hits, "node_id string, template string, logical_id string, kind_rank int")
    a = spark.createDataFrame(anchors, "node_id string, binding string")
    got = G.handler_groups(h, a).collect()
    assert len(got) == len(want) > 3000 and {r["node_id"]: r["rank"] for r in got} == want
    assert G.handler_groups(h.limit(0), a).count() == 0


def test_every_customer_is_resolved(spark):
    d = "/root/testdata/sf0.01"
    rows = lambda table, *cols: [tuple(r) for r in spark.read.parquet(f"{d}/{table}.parquet").select(*cols).collect()]
    customers = [(f"c{i}", n) for i, n in rows("customer", "c_custkey", "c_name")]
    nodes = [(f"p{i}", n) for i, n in rows("part", "p_partkey", "p_name")] + customers
    refs = [(f"s{i}", f"Supplier#{i}" if i % 3 else "red widget") for (i,) in rows("supplier", "s_suppkey")] + customers
    n, one = Counter(x.lower() for _, x in nodes), {x.lower(): i for i, x in nodes}
    want = {i: (one[x.lower()] if n[x.lower()] == 1 else None, n[x.lower()]) for i, x in refs}
    got = __spark_entry__.queries()["resolve_every_name"](spark, d).collect()
    assert len(got) == len(want) == len(refs) > len(customers) > 200 and {r["ref_id"]: (r["target"], r["candidate_count"]) for r in got} == want
