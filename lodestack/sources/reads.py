"""Reads of requested paths: where a path leads, whether it may be read or written, and its stat, prefix, text or bytes.

A request names a path below a root, or an absolute one. It is made canonical, symbolic links above or at it are followed (a table of
links, each met by an equi-join on the ancestors of the path, a bounded number of times), and it is refused when it then lies
outside the root. What may be written is told by the path policy. Many requests are answered by joins with the tree; content is
read for the requests that ask for it alone.

Defined cases: null and empty paths are refused; a path that does not exist is allowed, with exists false; a text that is not UTF-8
has no text but bytes; of repeated requests each is answered.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.functions import paths as P
from lodestack.functions import text as T
from lodestack.shared import dropped, written

#: Links that are followed for one request; one that leads through more is refused.
MOST_LINKS = 8
OUTSIDE, READ_ONLY = "path_refused", "write_refused"


def below(path: Column, root: str) -> Column:
    """A requested path as a canonical one below the root ("" for the root itself), null when it is outside."""
    base = root.rstrip("/")
    absolute = F.when(path == base, F.lit("")).when(path.startswith(base + "/"), F.substring(path, F.lit(len(base) + 2), F.char_length(path)))
    return P.canonical(F.when(path.startswith("/"), absolute).otherwise(path))


def _prefixes(path: Column) -> Column:
    """The path and every folder above it, the root left out."""
    parts = F.split(path, "/")
    return F.when(path == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/")))


def followed(requests: DataFrame, links: DataFrame, root: str, most: int = MOST_LINKS) -> DataFrame:
    """requests with `relative` after links: the shortest link at or above a path is replaced by its target, and again. links: path, target.

    A relative target starts at the link's folder. A path that still leads through a link after so many steps is outside (null).
    """
    jumps = links.select(F.col("path").alias("_link"), F.col("target").alias("_target")).dropDuplicates(["_link"])
    # the distinct paths and where each has led so far, written at every step: steps do not pile up in one plan
    now = written(requests.select(F.col("relative").alias("_from"), F.col("relative").alias("_to")).where("_from IS NOT NULL").distinct(), "links-followed")
    rest = F.substring(F.col("_to"), F.char_length("_j._link") + 1, F.char_length("_to"))
    folder = P.dirname(F.col("_j._link"))
    target = F.when(F.col("_j._target").startswith("/"), F.concat("_j._target", rest)).otherwise(F.concat(F.when(folder == "", "").otherwise(F.concat(folder, F.lit("/"))), "_j._target", rest))
    for step in range(most + 1):
        ways = now.select("_to").where("_to IS NOT NULL").distinct().select("_to", F.explode(_prefixes(F.col("_to"))).alias("_link")).join(jumps, "_link")
        first = written(ways.groupBy("_to").agg(F.min_by(F.struct("_link", "_target"), F.char_length("_link")).alias("_j")), "links-met")
        if first.isEmpty():
            dropped(first)
            break
        leads = below(target, root) if step < most else F.lit(None).cast("string")
        after = written(now.join(first, "_to", "left").select("_from", F.when(F.col("_j").isNull(), F.col("_to")).otherwise(leads).alias("_to")), "links-followed")
        dropped(now, first)
        now = after
    return requests.join(now, F.col("relative") == F.col("_from"), "left").withColumn("relative", F.col("_to")).drop("_from", "_to")


def resolved(requests: DataFrame, root: str, links: DataFrame | None = None, skipped: Iterable[str] = (), ignored: Column | None = None, allow_generated: bool = False) -> DataFrame:
    """requests (path, mode: text, prefix, binary, stat or write) with relative, allowed, read_only and reason (null where allowed).

    A write to what the policy keeps is refused; allow_generated lets writes to generated, vendored and skipped paths through.
    """
    own = requests.withColumn("relative", F.when(F.col("path") != "", below(F.col("path"), root)))
    own = own if links is None else followed(own, links, root)
    kept = P.policy(F.col("relative"), skipped=skipped, ignored=ignored)
    read_only = kept["write"] == "refuse"
    free = kept["category"].isin("generated", "vendor", "configured_skip") & F.lit(allow_generated)
    reason = F.when(F.col("relative").isNull(), OUTSIDE).when((F.col("mode") == "write") & read_only & ~free, READ_ONLY)
    return own.withColumn("read_only", F.when(F.col("relative").isNotNull(), read_only)).withColumn("reason", reason).withColumn("allowed", F.col("reason").isNull())


def answers(decided: DataFrame, tree: DataFrame, most_bytes: int = 4000) -> DataFrame:
    """Rows of resolved() with exists, size_bytes, mtime_ms and, as the mode asks, text or content. tree: path, size_bytes, mtime_ms, content.

    prefix: the longest part of at most so many bytes that splits no character. Refused requests get nothing.
    """
    if most_bytes < 1:
        raise ValueError("most_bytes must be positive")
    facts = tree.select(F.col("path").alias("relative"), F.lit(True).alias("exists"), "size_bytes", "mtime_ms", "content")
    reads = F.col("mode").isin("text", "prefix", "binary")
    met = decided.where("allowed").join(facts.drop("content"), "relative", "left")
    content = decided.where(F.col("allowed") & reads).select("relative").distinct().join(facts.select("relative", "content"), "relative")
    met = met.join(content, "relative", "left")
    refused = decided.where("NOT allowed").select("*", *(F.lit(None).cast(t).alias(c) for c, t in (("exists", "boolean"), ("size_bytes", "long"), ("mtime_ms", "long"), ("content", "binary"))))
    every = met.unionByName(refused)
    text = F.try_validate_utf8(F.col("content"))
    body = F.when(F.col("mode") == "text", text).when(F.col("mode") == "prefix", T.utf8_prefix(text, most_bytes))
    return every.select(
        *decided.columns, F.when(F.col("allowed"), F.coalesce("exists", F.lit(False))).alias("exists"), F.when(F.col("allowed"), F.coalesce("size_bytes", F.lit(0))).alias("size_bytes"),
        F.when(F.col("allowed"), F.coalesce("mtime_ms", F.lit(0))).alias("mtime_ms"), body.alias("text"), F.when(F.col("mode") == "binary", F.col("content")).alias("content"),
    )
