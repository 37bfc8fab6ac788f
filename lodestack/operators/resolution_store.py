"""Resolution of references kept up to date: after an edit only references that the edit can touch are resolved again.

A reference depends on nodes by tokens: the last part of its name, the paths that a handler may lie in, the file that a
require names. A node has the tokens of its name, its path and, as a Ruby module, of every suffix of its path. What changed
nodes had and have are the touched tokens; the references that carry one, and the changed ones, are resolved against
the nodes that carry one of theirs. That is what full resolution gives for them, since a reference's candidates are
counted by these tokens alone.

Nodes and references are stored once for each of their tokens, results by reference, all in buckets of the token's hash. A
state of `Versions` names the files of each bucket: an update reads the buckets of its tokens, writes new files for those that it
changes, and publishes. A lost writer leaves what was there.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestack.functions import paths as P
from lodestack.operators.graph import resolve_references
from lodestack.shared import dropped, filesystem, written
from lodestack.versions import Versions

BUCKETS = 64
#: Kinds of token: an id, a name, a path, a required file.
ID, NAME, PATH, FILE = "i", "n", "p", "f"


def _token(kind: str, value: Column) -> Column:
    return F.concat(F.lit(kind + ":"), value.cast("string"))


def _present(*tokens: Column) -> Column:
    return F.array_distinct(F.array_compact(F.array(*tokens)))


def node_tokens(nodes: DataFrame) -> Column:
    """Tokens that references may mean a node by."""
    stem = F.split(F.regexp_replace(F.lower("path"), r"\.rb$", ""), "/")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(stem)), lambda i: _token(FILE, F.array_join(F.slice(stem, i, F.size(stem)), "/")))
    none = F.array().cast("array<string>")
    ruby = F.when(((F.col("language") == "ruby") & (F.col("kind") == "module") & F.col("path").isNotNull()), suffixes).otherwise(none)
    return F.array_union(_present(_token(NAME, F.lower("name")), _token(PATH, F.col("path"))), F.coalesce(ruby, none))


def ref_tokens(refs: DataFrame) -> Column:
    """Tokens of the nodes that a reference depends on."""
    name = F.element_at(F.split(F.replace(F.lower("name"), F.lit("::"), F.lit(".")), r"\."), -1)
    own_dir = P.dirname(F.lower("source_path")) if "source_path" in refs.columns else F.lit("")
    asked = F.regexp_replace(F.lower("name"), r"\.rb$", "")
    file = F.when(F.col("kind") == "require", asked).when(F.col("kind") == "require_relative", P.canonical(F.concat_ws("/", F.nullif(own_dir, F.lit("")), asked)))
    none = F.array().cast("array<string>")
    places = F.when(F.col("kind") == "lambda_handler_file", F.transform("paths", lambda p: _token(PATH, p))).otherwise(none)
    return F.array_union(_present(_token(NAME, name), _token(FILE, file)), F.array_compact(F.coalesce(places, none)))


class Resolutions:
    """Tables in a folder: `nodes` and `refs` by token (token, id, row), `results` by reference (token, id, row)."""

    TABLES = ("nodes", "refs", "results")

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets
        self.versions = Versions(spark, f"{self.folder}/versions")

    @classmethod
    def build(cls, refs: DataFrame, nodes: DataFrame, folder: str, buckets: int = BUCKETS) -> Resolutions:
        out = cls(refs.sparkSession, folder, buckets)
        number, _ = out.versions.latest()
        tables = {"nodes": out._nodes(nodes), "refs": out._refs(refs), "results": out._results(resolve_references(refs, nodes))}
        state = {"buckets": buckets, "schemas": {name: df.schema.json() for name, df in tables.items()}} | {name: out._write(name, df) for name, df in tables.items()}
        out.versions.publish(number + 1, state)
        return out

    @staticmethod
    def _keyed(df: DataFrame, ident: str, tokens: Column | None) -> DataFrame:
        own = F.array(_token(ID, F.col(ident))) if tokens is None else F.array_union(F.array(_token(ID, F.col(ident))), tokens)
        return df.where(F.col(ident).isNotNull()).select(F.explode(own).alias("token"), F.col(ident).alias("id"), F.struct("*").alias("row"))

    def _nodes(self, nodes: DataFrame) -> DataFrame:
        return self._keyed(nodes, "node_id", node_tokens(nodes))

    def _refs(self, refs: DataFrame) -> DataFrame:
        return self._keyed(refs, "ref_id", ref_tokens(refs))

    def _results(self, done: DataFrame) -> DataFrame:
        return self._keyed(done, "ref_id", None)

    def _bucket(self, token: Column) -> Column:
        return F.pmod(F.xxhash64(token), F.lit(self.buckets)).cast("int")

    def _write(self, name: str, rows: DataFrame) -> dict[str, str]:
        """The path of each bucket that has rows. Rows of one token, however many, are dealt out by id as well."""
        path = f"{self.folder}/{name}/{uuid.uuid4().hex}"
        rows.withColumn("bucket", self._bucket(F.col("token"))).hint("rebalance", "bucket").sortWithinPartitions("bucket", "token").write.partitionBy("bucket").parquet(path)
        fs, root = filesystem(self.spark, path)
        names = [f.getPath().getName() for f in fs.listStatus(root)]
        return {n.removeprefix("bucket="): f"{path}/{n}" for n in names if n.startswith("bucket=")}

    def _state(self) -> tuple[int, dict]:
        number, state = self.versions.latest()
        if state is None:
            raise FileNotFoundError(f"nothing is resolved in {self.folder}")
        self.buckets = state["buckets"]
        return number, state

    def _held(self, tokens: DataFrame) -> list[str]:
        return [str(r[0]) for r in tokens.select(self._bucket(F.col("token"))).distinct().collect()]  # at most as many as there are buckets

    def _read(self, state: dict, name: str, buckets: list[str] | None = None) -> DataFrame:
        """Rows of some buckets: files of others are not opened."""
        paths = [p for k, p in state[name].items() if buckets is None or k in buckets]
        schema = StructType.fromJson(json.loads(state["schemas"][name]))
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def results(self) -> DataFrame:
        """ref_id, source, target, kind, candidate_count, resolution of every reference."""
        return self._read(self._state()[1], "results").select("row.*")

    def _with(self, state: dict, name: str, tokens: DataFrame) -> DataFrame:
        """(id, row) of those that carry one of the tokens, each once. tokens: token, distinct."""
        found = self._read(state, name, self._held(tokens)).join(tokens, "token", "left_semi")
        return found.groupBy("id").agg(F.any_value("row").alias("row"))

    def update(self, nodes: DataFrame | None = None, gone_nodes: DataFrame | None = None, refs: DataFrame | None = None, gone_refs: DataFrame | None = None) -> int:
        """New or changed nodes and references (by node_id and ref_id) and ids of those that went; how many references were resolved again."""
        number, state = self._state()
        empty = lambda name: self._read(state, name, []).select("row.*")
        nodes, refs = (empty("nodes") if nodes is None else nodes), (empty("refs") if refs is None else refs)
        ids = lambda df, gone, key: (df.select(key) if gone is None else df.select(key).unionByName(gone.select(key))).where(F.col(key).isNotNull()).select(F.col(key).alias("id")).distinct()
        node_ids, ref_ids = written(ids(nodes, gone_nodes, "node_id"), "delta-nodes"), written(ids(refs, gone_refs, "ref_id"), "delta-refs")
        named = lambda df: df.select(_token(ID, F.col("id")).alias("token"))
        old_nodes = self._with(state, "nodes", named(node_ids)).select("row.*")
        old_refs = self._with(state, "refs", named(ref_ids)).select("row.*")
        # tokens that the changed nodes had or have, and the references that carry one
        touched = written(old_nodes.select(F.explode(node_tokens(old_nodes)).alias("token")).unionByName(nodes.select(F.explode(node_tokens(nodes)).alias("token"))).distinct(), "delta-tokens")
        again = self._with(state, "refs", touched).join(ref_ids, "id", "left_anti").select("row.*").unionByName(refs)
        again = written(again, "delta-again")
        asked = again.select(F.explode(ref_tokens(again)).alias("token")).distinct()
        pool = self._with(state, "nodes", asked).join(node_ids, "id", "left_anti").select("row.*").unionByName(nodes)
        done = written(resolve_references(again, pool), "delta-done")
        new = dict(state)
        for name, rows, had, gone in (("nodes", self._nodes(nodes), self._nodes(old_nodes), node_ids), ("refs", self._refs(refs), self._refs(old_refs), ref_ids)):
            new[name] = self._replaced(state, name, rows, had.select("token"), gone)
        changed = again.select(F.col("ref_id").alias("id")).unionByName(ref_ids).distinct()
        new["results"] = self._replaced(state, "results", self._results(done), named(changed), changed)
        n = done.count()
        self.versions.publish(number + 1, new)
        dropped(node_ids, ref_ids, touched, again, done)
        return n

    def _replaced(self, state: dict, name: str, rows: DataFrame, had: DataFrame, gone: DataFrame) -> dict[str, str]:
        """The buckets of a table after its rows of some ids gave way to new ones; only buckets of their tokens are written."""
        held = self._held(rows.select("token").unionByName(had))
        if not held:
            return state[name]
        kept = self._read(state, name, held).join(gone, "id", "left_anti").select("token", "id", "row")
        fresh = self._write(name, kept.unionByName(rows))
        return {k: p for k, p in state[name].items() if k not in held} | fresh

    def vacuum(self) -> int:
        """Deletes files that the current state does not name; how many folders. Only where nobody reads an earlier state."""
        _, state = self._state()
        n = 0
        for name in self.TABLES:
            used = {p.rsplit("/", 2)[-2] for p in state[name].values()}
            fs, root = filesystem(self.spark, f"{self.folder}/{name}")
            for f in fs.listStatus(root) if fs.exists(root) else []:
                if f.getPath().getName() not in used:
                    fs.delete(f.getPath(), True)
                    n += 1
        self.versions.prune(1)
        return n
