"""The segmented positional index: phrases as bm25 finds them, updates and merges as a rebuilt index, lost writers."""

import random

import pytest
from pyspark.sql import functions as F

from lodestack.operators import search as S
from lodestack.versions import Conflict, Versions

WORDS = ["alpha", "beta", "al", "gamma_x", "Delta", "how", "to", "src", "core"]
SCHEMA = "id long, body string, title string"
WEIGHTS = [1.0, 3.0]
ASKED = [(["alpha", "beta"], False, False), (["al", "gam"], True, True), (["nothing"], False, False), (["src/core", "alpha"], False, False), (["src/core", "alpha"], False, True), (["how-to-al"], True, False), (["al-al"], False, False), (["al-a"], True, False), (["--", "beta"], False, False), (["how-to-src-core"], True, False)]


def rows(n, seed, first=0):
    r = random.Random(seed)
    text = lambda m: r.choice([" ", " - ", "/"]).join(r.choice(WORDS) for _ in range(r.randint(0, m)))
    return [(first + k, text(14), r.choice([None, "beta", "How-to src/core", "al al al al al"])) for k in range(n)]


def asked(index, terms, prefix, every):
    return {x["key"]: round(x["score"], 9) for x in index.search(terms, WEIGHTS, prefix, every).collect()}


def by_scan(df, terms, prefix, every):
    return {x["id"]: round(x["score"], 9) for x in S.bm25(df, {"body": 1.0, "title": 3.0}, terms, prefix, every).collect()}


def test_phrases_are_those_of_the_scan(spark, tmp_path):
    df = spark.createDataFrame(rows(80, 5), SCHEMA).repartition(3)
    index = S.TermIndex.build(df, "id", ["body", "title"], f"file://{tmp_path}/ix")
    for terms, prefix, every in ASKED:
        a, b = by_scan(df, terms, prefix, every), asked(index, terms, prefix, every)
        assert a == b, (terms, prefix, every)
        assert bool(a) == (terms != ["nothing"]) or every
    docs = spark.createDataFrame([(1, "How-To guide"), (2, "how to"), (3, "how not to"), (4, "src core"), (5, "--"), (None, "how to")], "id long, body string")
    index = S.TermIndex.build(docs, "id", ["body"], f"file://{tmp_path}/iy")
    assert {r["key"] for r in index.search(["how-to", "src/core"], [1.0]).collect()} == {1, 2, 4}


def test_updates_equal_a_rebuilt_index(spark, tmp_path):
    """Documents replaced, removed and added again; segments merged, compacted and swept: always as if built anew."""
    truth = {r[0]: r for r in rows(120, 1)}
    frame = lambda rs: spark.createDataFrame(list(rs), SCHEMA)
    index = S.TermIndex.build(frame(truth.values()), "id", ["body", "title"], f"file://{tmp_path}/ix")
    r = random.Random(9)

    def same():
        new = S.TermIndex.build(frame(truth.values()), "id", ["body", "title"], f"file://{tmp_path}/new{r.random()}")
        for terms, prefix, every in ASKED[1:2] + ASKED[4:5]:
            assert asked(index, terms, prefix, every) == asked(new, terms, prefix, every)
        old, fresh = index.state(), new.state()
        assert (old["docs"], old["tokens"]) == (fresh["docs"], fresh["tokens"])

    for step in range(5):
        changed = rows(r.randrange(1, 6), 50 + step, first=r.choice([0, 40, 118, 300]))
        removed = r.sample(sorted(truth), 3)
        index.update(frame(changed), "id", spark.createDataFrame([(x,) for x in [*removed, 9999, None]], "id long") if step % 2 else None)
        if step % 2:
            for x in removed:
                truth.pop(x, None)
        truth |= {c[0]: c for c in changed}
        if step in (1, 4):
            same()
    assert len(index.state()["segments"]) == 6 and not index.merge(8) and index.merge(3)
    assert len(index.state()["segments"]) == 4
    same()
    index.update(frame([]), "id", spark.createDataFrame([(300,), (41,)], "id long"))
    truth.pop(300, None), truth.pop(41, None)
    index.compact()
    assert len(index.state()["segments"]) == 1 and index.state()["tombs"] == []
    same()
    assert index.vacuum() > 5
    same()


def test_an_update_writes_what_changed(spark, tmp_path):
    every = rows(1000, 2)
    index = S.TermIndex.build(spark.createDataFrame(every, SCHEMA), "id", ["body", "title"], f"file://{tmp_path}/ix")
    index.update(spark.createDataFrame([(i, "beta again", None) for i in range(10)], SCHEMA), "id")
    first, second = index.state()["segments"]
    count = lambda s: spark.read.parquet(f"{s['path']}/postings").count()
    assert count(second) == 20 and count(second) < 0.01 * count(first)
    assert spark.read.parquet(*index.state()["tombs"]).count() == 10 and index.state()["docs"] == 1000


def test_a_lost_writer_changes_nothing(spark, tmp_path, monkeypatch):
    """A stop after each step of an update leaves the index as it was, and the next update goes on."""
    df = spark.createDataFrame(rows(30, 3), SCHEMA)
    index = S.TermIndex.build(df, "id", ["body", "title"], f"file://{tmp_path}/ix")
    before = asked(index, ["alpha"], False, False)
    new = spark.createDataFrame([(1, "alpha alpha", None)], SCHEMA)

    def lost(*_):
        raise OSError("gone")

    for step in ("_segment", "_size", "_path"):
        with monkeypatch.context() as m:
            m.setattr(S.TermIndex, step, lost)
            with pytest.raises(OSError):
                index.update(new, "id")
        assert asked(index, ["alpha"], False, False) == before
    with monkeypatch.context() as m:
        m.setattr(Versions, "publish", lost)
        with pytest.raises(OSError):
            index.update(new, "id")
    assert asked(index, ["alpha"], False, False) == before
    number = index.state()["number"]
    (tmp_path / "ix" / "versions" / f"{number + 1:012d}.json").write_text('{"segments": [')  # a writer that was lost as it wrote
    assert asked(index, ["alpha"], False, False) == before
    index.update(new, "id")
    assert asked(index, ["alpha"], False, False) == by_scan(df.where("id <> 1").unionByName(new), ["alpha"], False, False)


def test_versions(spark, tmp_path):
    v = Versions(spark, f"file://{tmp_path}/v")
    assert v.latest() == (0, None)
    v.publish(1, {"a": "é"})
    with pytest.raises(Conflict):
        v.publish(1, {"a": 2})
    (tmp_path / "v" / "000000000002.json").write_text("{")
    assert v.latest() == (2, {"a": "é"})
    v.publish(3, {"b": 1})
    v.prune(1)
    assert v.numbers() == [3] and v.latest() == (3, {"b": 1})
    assert spark.range(1).select(F.lit(1)).count() == 1
