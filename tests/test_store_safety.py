"""Snapshot tables: a writer that stops between any two steps loses nothing; writers that meet."""

import pytest
from pyspark.sql import functions as F

from lodestack.operators import store as ST
from lodestack.versions import Conflict, Versions

SCHEMA = "path string, name string"


@pytest.fixture()
def tables(spark, tmp_path):
    st = ST.SnapshotTables(spark, f"file://{tmp_path}/t")
    rows = lambda *xs: spark.createDataFrame(list(xs), SCHEMA)
    st.replace(1, nodes=rows(("a", "x"), ("a", "y"), ("b", "z")), edges=rows(("a", "e")), coverage=spark.createDataFrame([("graph", "complete", None)], "evidence_class string, state string, reason string"))
    st.replace(2, nodes=rows(("q", "q")))
    return st, rows


def got(st, table="nodes", snapshot=1):
    return sorted((r["path"], r["name"]) for r in st.read(table, snapshot).collect())


OLD = [("a", "x"), ("a", "y"), ("b", "z")]


def test_a_write_that_raises_leaves_what_was_there(spark, tables):
    st, rows = tables
    bad = rows(("a", "x")).select("path", F.raise_error(F.lit("no")).cast("string").alias("name"))
    with pytest.raises(Exception, match="no"):
        st.replace(1, edges=rows(("new", "new")), nodes=bad)
    assert got(st) == OLD and got(st, "edges") == [("a", "e")]
    with pytest.raises(Exception, match="no"):
        st.replace_files(1, rows(("a", "-")), nodes=bad)
    assert got(st) == OLD


@pytest.mark.parametrize("step", range(6))
def test_a_stop_between_any_two_steps(spark, tables, monkeypatch, step):
    """Every call of a step counts; the writer is killed at the one with this number. Either all of the change is there or nothing."""
    st, rows = tables
    calls = [0]

    def killed(f):
        def g(*a, **k):
            calls[0] += 1
            if calls[0] == step + 1:
                raise KeyboardInterrupt
            return f(*a, **k)

        return g

    with monkeypatch.context() as m:
        m.setattr(ST.SnapshotTables, "_written", killed(ST.SnapshotTables._written))
        m.setattr(Versions, "publish", killed(Versions.publish))
        m.setattr(Versions, "latest", killed(Versions.latest))
        try:
            st.remove_file(1, "a", "nodes", "edges")
            done = True
        except KeyboardInterrupt:
            done = False
    state = (got(st), got(st, "edges"), st.read("coverage", 1).first()["state"])
    assert state == (([("b", "z")], [], "stale") if done else (OLD, [("a", "e")], "complete"))
    st.remove_file(1, "a", "nodes", "edges")  # and the next one goes on
    assert got(st) == [("b", "z")] and got(st, "edges") == []


def test_rows_that_come_from_what_they_replace(spark, tables):
    st, rows = tables
    st.replace(1, nodes=st.read("nodes", 1).where("name <> 'y'").withColumn("name", F.upper("name")))
    assert got(st) == [("a", "X"), ("b", "Z")]
    st.replace_files(1, rows(("a", "-")), nodes=st.read("nodes", 1).where("path = 'a'").withColumn("name", F.lit("again")))
    assert got(st) == [("a", "again"), ("b", "Z")] and got(st, snapshot=2) == [("q", "q")]


def test_two_writers(spark, tables, monkeypatch):
    """Of two changes to other tables both stay; a change made from rows that another writer has replaced is refused."""
    st, rows = tables
    other = ST.SnapshotTables(spark, st.folder)
    publish, first = Versions.publish, [True]

    def late(self, number, state):
        if first.pop() if first else False:
            other.replace(2, edges=rows(("o", "o")))
        return publish(self, number, state)

    with monkeypatch.context() as m:
        m.setattr(Versions, "publish", late)
        st.replace(1, nodes=rows(("mine", "mine")))
    assert got(st) == [("mine", "mine")] and got(st, "edges", 2) == [("o", "o")] and got(st, "edges") == [("a", "e")]

    def meanwhile(self, snapshot, paths, tables):
        out = without(self, snapshot, paths, tables)
        other.replace(1, nodes=rows(("theirs", "t")))
        return out

    without = ST.SnapshotTables._without
    with monkeypatch.context() as m:
        m.setattr(ST.SnapshotTables, "_without", meanwhile)
        with pytest.raises(Conflict):
            st.replace_files(1, rows(("a", "-")), nodes=None)
    assert got(st) == [("theirs", "t")]


def test_seed_drop_and_vacuum(spark, tables):
    st, rows = tables
    st.seed(1, 3, "nodes", "edges", "none")
    assert got(st, snapshot=3) == OLD and st.state()["nodes"]["3"] == st.state()["nodes"]["1"] and st.read("nodes", 3).first()["snapshot_id"] == 3
    st.replace_files(3, rows(("a", "-")), nodes=rows(("a", "new")))
    assert got(st) == OLD and got(st, snapshot=3) == [("a", "new"), ("b", "z")]
    assert sorted(r["snapshot_id"] for r in st.read("nodes").select("snapshot_id").distinct().collect()) == [1, 2, 3]
    st.drop_snapshot(1, "nodes", "edges")
    assert got(st) == [] and got(st, "edges", 3) == [("a", "e")]
    st.drop_snapshot(3, "edges")
    assert got(st, "edges", 3) == [] and st.exists("edges") and not st.exists("none")
    assert st.vacuum() > 0 and got(st, snapshot=3) == [("a", "new"), ("b", "z")] and st.read("edges").count() == 0
