"""Shapes, composition, intent, drift."""

from pyspark.sql import functions as F

from lodestack.plans import shapes as SH


def test_shapes(spark):
    f = spark.createDataFrame([("Gemfile",), ("app/models/a.rb",), ("app/models/b.rb",), ("web/package.json",), ("web/src/x.test.ts",), (".devcontainer/devcontainer.json",), ("Dockerfile",)], "path string")
    got = {(r["shape"], r["role"], r["root"]): r["files"] for r in SH.shapes(f).collect()}
    assert got[("rails", "model", ".")] == 2 and got[("rails", "manifest", ".")] == 1 and got[("js_ts", "manifest", "web")] == 1 and ("environment", "container", ".") in got
    b = SH.host_blocked(f.withColumn("text", F.lit("")), F.col("text")).first()
    assert b["environment"] and not b["blocked"]


def test_composition():
    tree = {"a": [("libs/b", "b"), ("../x", "x")], "b": [("c", "c")], "c": [("a", "a")]}
    units = SH.composition("a", lambda k: tree.get(k, []))
    assert [(u["repository_key"], u["path_prefix"], u["claim_blockers"]) for u in units] == [("a", ".", ["unsafe_path"]), ("b", "libs/b", []), ("c", "libs/b/c", ["cycle"])]
    assert SH.fingerprint(units) == SH.fingerprint(units[::-1]) != SH.fingerprint(units[:2])
    assert len(SH.composition("r", lambda k: [(f"s{i}", f"{k}{i}") for i in range(9)])) == 20


def test_intent_and_drift():
    assert SH.intent("Fix the parser")["intent"] == "edit" and SH.intent("explain it, do not change anything") == {"intent": "read_only", "conflict": False, "needs_references": False}
    assert SH.intent("explain and fix")["conflict"] and SH.intent("who are the callers")["needs_references"] and SH.intent("ship the release")["intent"] == "closure"
    schema = {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer"}, "b": {"type": "array", "items": {"enum": ["x"]}}}}
    assert SH.drift(schema, {"a": 1, "b": ["x"]}) == [] and SH.drift(schema, {"b": ["y"], "c": 1}) == ["$.a: missing", "$.c: unknown", "$.b[0]: not in enum"] and SH.drift(schema, {"a": True}) == ["$.a: not integer"]
