"""File sources: scanning a tree into a catalog, prefix reads, JSON syntax, coverage of a scan."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestack.functions import paths as P
from lodestack.operators.relational import samples_by_reason
from lodestack.shipping import ship
from lodestack.sources.hidden import HiddenFiles

MOST_TEXT, MOST_DOC = 2_000_000, 120_000
SHAPE_FILES = r"(^|/)(package\.json|pyproject\.toml|go\.mod|Cargo\.toml|CMakeLists\.txt|Gemfile|[^/]+\.(sln|csproj))$"


def read_tree(spark: SparkSession, root: str, hidden: bool = True) -> DataFrame:
    """path (below root), size_bytes, mtime_ms, content of every file below a folder.

    Spark lists and reads the files; those whose names, or a folder's, begin with a dot or an underscore it leaves out,
    and a data source adds them (content of at most two million bytes; larger ones have none). hidden=False does without them.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").split("://", 1)[-1].removeprefix("file:")
    path = F.regexp_replace(F.regexp_replace("path", "^[a-z0-9]+:/*", "/"), "^" + _quoted("/" + base.lstrip("/") + "/"), "")
    seen = raw.select(path.alias("path"), F.col("length").alias("size_bytes"), F.unix_millis("modificationTime").alias("mtime_ms"), "content")
    if not hidden:
        return seen
    ship(spark)
    spark.dataSource.register(HiddenFiles)
    return seen.unionByName(spark.read.format(HiddenFiles.name()).option("path", root).load())


def _quoted(s: str) -> str:
    return "\\Q" + s + "\\E"


def traversal_priority(path: Column) -> Column:
    """Shape files, then sources, then the rest."""
    return F.when(path.rlike(SHAPE_FILES), 0).when(P.language(path).isin("text", "json", "yaml", "config", "toml"), 2).otherwise(1)


def scan(tree: DataFrame, max_files: int = 2000, after_path: str | None = None, priority_paths: Iterable[str] = (), priority_patterns: Iterable[str] = (), roots: Iterable[str] = (), skipped: Iterable[str] = (), ignored: Column | None = None) -> dict[str, DataFrame]:
    """Catalog page: files in scan order with `position`, skipped population, and one row of totals with the continuation.

    Order: named priority paths as given, then those that match a pattern, then by traversal priority and path;
    without priorities by path. A page starts after after_path in that order.
    """
    p = F.col("path")
    policy = P.policy(p, skipped=skipped, ignored=ignored)
    inside = P.under_any(p, roots) if list(roots) and "." not in roots else F.lit(True)
    all_of = tree.where(inside).withColumn("_c", policy)
    names, patterns = list(priority_paths), list(priority_patterns)
    first = F.when(p.isin(names), F.array_position(F.array(*map(F.lit, names)), p)) if names else F.lit(None).cast("long")
    matched = F.lit(False)
    for g in patterns:
        matched = matched | p.rlike(glob(g))
    kept = all_of.where("_c.reason = 'source'")
    key = F.struct(F.coalesce(first, F.lit(1 << 40)).alias("a"), F.when(matched, 0).otherwise(1).alias("b"), (traversal_priority(p) if names or patterns else F.lit(0)).alias("c"), p.alias("p"))
    kept = kept.withColumn("_k", key)
    if after_path is not None:
        cursor = kept.where(p == after_path).agg(F.count(F.lit(1)).alias("_found"), F.max("_k").alias("_after"))
        known = cursor.first()
        if not known["_found"]:
            raise ValueError(f"unknown cursor {after_path}")
        kept = kept.join(F.broadcast(cursor), F.col("_k") > F.col("_after")).drop("_found", "_after")
    top = kept.orderBy("_k").limit(max_files + 1).withColumn("position", F.row_number().over(Window.orderBy("_k")))
    page = top.where(F.col("position") <= max_files)
    cols = [c for c in tree.columns]
    totals = top.agg((F.count(F.lit(1)) > max_files).alias("truncated"), F.max_by("path", F.when(F.col("position") <= max_files, F.col("position"))).alias("last"))
    return {
        "files": page.select(*cols, P.language(p).alias("language"), "position"),
        "skipped": samples_by_reason(all_of.where("_c.reason <> 'source'").select("path", F.col("_c.reason").alias("reason")), "reason", "path"),
        "totals": totals.select("truncated", F.when(F.col("truncated"), F.col("last")).alias("continuation")),
    }


def glob(pattern: str) -> str:
    """Regular expression of a glob in which ** crosses directories."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif pattern[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif pattern[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + (pattern[i] if pattern[i].isalnum() or pattern[i] in "/_" else "\\" + pattern[i]), i + 1
    return f"^{out}$"


def identified(tree: DataFrame) -> DataFrame:
    """Text, hash and language of files; binary content gives no text; oversized files carry an error."""
    text = F.try_validate_utf8("content")
    limit = F.when(P.language(F.col("path")) == "markdown", MOST_DOC).otherwise(MOST_TEXT)
    return tree.select("path", P.language(F.col("path")).alias("language"), F.sha2("content", 256).alias("content_hash"), "size_bytes", "mtime_ms", F.when(F.col("size_bytes") > limit, "file_too_large_for_text_extraction").when(text.isNull(), "not_text").alias("indexing_error"), text.alias("text"))


def coverage(files: DataFrame, evidence_class: str, eligible: Column, admitted: Column, extracted: Column, truncated: bool) -> DataFrame:
    """One row: counters of a scan and whether it covers everything."""
    c = files.agg(F.count(F.lit(1)).alias("seen"), F.count_if(eligible).alias("eligible_files_seen"), F.count_if(eligible & admitted).alias("admitted_files"), F.count_if(eligible & admitted & extracted).alias("extracted_files"))
    state = F.when(F.lit(truncated) | (F.col("extracted_files") < F.col("admitted_files")), "partial").otherwise("complete")
    reason = F.when(F.lit(truncated), "scan_truncated").when(F.col("extracted_files") < F.col("admitted_files"), "extraction_incomplete")
    return c.select(F.lit(evidence_class).alias("evidence_class"), state.alias("state"), "eligible_files_seen", "admitted_files", "extracted_files", (F.col("seen") - F.col("eligible_files_seen")).alias("policy_excluded_files"), F.lit(truncated).alias("scan_truncated"), reason.alias("reason"))
