"""Documentation surfaces: overview and map with pages and a byte budget, scope, index state, ranked search with frozen pages; task context."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestack.functions import authority as A
from lodestack.functions import paths as P
from lodestack.operators import documentation as DOC
from lodestack.operators import search as S
from lodestack.operators.relational import offset_page, ranked
from lodestack.plans import planning as PL
from lodestack.plans.api import BadRequest, Cursors, Envelope, limits

#: Serialised bytes of a map that are given at most.
MOST_MAP_BYTES = 32_768


def docs_page(index: DataFrame, order: str = "path", start: int = 0, n: int = 50, headings: int = 20, scope: str | None = None) -> DataFrame:
    """A page of an overview (order "importance") or map (order "path") over docs_index rows.

    path, title, priority, headings (at most so many), heading_count, rank from start + 1, more.
    """
    own = index.where(P.in_scope(F.col("path"), scope)).withColumn("priority", PL.doc_importance(F.col("path")))
    keys = [F.desc("priority"), F.asc("path")] if order == "importance" else [F.asc("path")]
    page = offset_page(own, keys, start, n)
    return page.select("path", "title", "priority", F.slice("headings", 1, headings).alias("headings"), F.size("headings").alias("heading_count"), "rank", "more")


def within_bytes(page: DataFrame, order: str, most: int = MOST_MAP_BYTES) -> DataFrame:
    """Rows of a page whose JSON fits a byte budget, in order; adds `bytes` (so far) and `cut`. The first row always stays."""
    size = F.octet_length(F.to_json(F.struct(*page.columns)))
    w = Window.orderBy(order)  # over a page
    run = page.withColumn("bytes", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.row_number().over(w))
    cut = F.coalesce(F.max(F.when(F.col("_n") > 1, F.col("bytes"))).over(Window.partitionBy()) > most, F.lit(False))
    return run.withColumn("cut", cut).where((F.col("bytes") <= most) | (F.col("_n") == 1)).drop("_n")


def docs_scope(index: DataFrame, depth: int = 1) -> DataFrame:
    """scope, docs: documents below each directory prefix of so many segments; those at the root are in '.'."""
    parts = P.segments(F.col("path"))
    scope = F.when(F.size(parts) > 1, F.array_join(F.slice(parts, F.lit(1), F.least(F.lit(depth), F.size(parts) - 1)), "/")).otherwise(".")
    return index.groupBy(scope.alias("scope")).agg(F.count(F.lit(1)).alias("docs"))


def index_state(snapshots: DataFrame, documents: DataFrame, requested: DataFrame | None = None) -> DataFrame:
    """repo, snapshot_id, freshness, status, document_count of each repository.

    The requested snapshot (repo, snapshot_id) or else the latest decides. A refreshing one with documents is usable. Where none is
    asked for and the latest is not fresh, the latest fresh one with documents stands in. Otherwise what is not fresh is stale, and what
    is fresh but without documents is cold.
    """
    n = documents.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("docs"))
    s = snapshots.join(n, "snapshot_id", "left").select("repo", "snapshot_id", "freshness", F.coalesce("docs", F.lit(0)).alias("docs"))
    one = F.struct("snapshot_id", "freshness", "docs")
    usable = F.max(F.when((F.col("freshness") == "fresh") & (F.col("docs") > 0), one)).alias("usable")
    if requested is None:
        s = s.groupBy("repo").agg(F.max(one).alias("own"), usable)
    else:
        s = s.join(requested, ["repo", "snapshot_id"]).select("repo", one.alias("own"), F.lit(None).cast(s.select(one.alias("x")).schema["x"].dataType).alias("usable"))
    own, fresh = F.col("own"), F.col("own.freshness") == "fresh"
    refreshing = (F.col("own.freshness") == "refreshing") & (F.col("own.docs") > 0)
    other = ~fresh & ~refreshing & F.col("usable").isNotNull()
    pick = F.when(other, F.col("usable")).otherwise(own)
    status = F.when(refreshing | other, "usable").when(~fresh, "stale").when(F.col("own.docs") == 0, "cold").otherwise("usable")
    freshness = F.when(status == "cold", "cold").otherwise(pick["freshness"])
    return s.select("repo", pick["snapshot_id"].alias("snapshot_id"), freshness.alias("freshness"), status.alias("status"), pick["docs"].alias("document_count"))


def searchable_counts(index: DataFrame, scope: str | None = None) -> DataFrame:
    """One row: documents, and those in scope."""
    return index.agg(F.count(F.lit(1)).alias("documents"), F.count_if(P.in_scope(F.col("path"), scope)).alias("in_scope"))


def docs_search(index: DataFrame, query: str, universes: S.Universes, cursors: Cursors, snapshot: str, now: str, expires: str, scope: str | None = None, concerns: dict | None = None, cursor: str | None = None, ready: tuple[str, str | None] = ("ready", None), cap: int | None = S.CANDIDATES, **asked: int) -> Envelope:
    """A page of ranked documentation search.

    The first page ranks the candidates and freezes them; the cursor is signed and bound to snapshot, query and
    scope, and later pages read the frozen universe. More candidates than the cap block with counts and no hits (None: all are
    ranked and frozen); an expired or foreign cursor is refused.
    """
    n = limits("docs_search", **asked)["results"]
    if ready[0] != "ready":
        return Envelope([], "docs_routing", status="blocked", errors=[f"not ready: {ready[1]}"])
    identity = {"snapshot": snapshot, "query": query, "scope": scope or ".", "policy": 1}
    start = cursors.read(cursor, identity) if cursor else 0
    # each first page freezes a result of its own: another one deletes nothing that is being paged
    universe = (cursors.frozen(cursor, identity) or "") if cursor else hashlib.sha256(json.dumps(identity, sort_keys=True).encode()).hexdigest()[:32] + uuid.uuid4().hex[:8]
    if not cursor:
        found = DOC.ranked_search(index, query, concerns, scope, cap, now)
        rows = found.persist()
        try:
            if not rows.where("overflow").isEmpty():
                counts = searchable_counts(index, scope).first().asDict()
                return Envelope([counts], "docs_routing", status="blocked", truncated=True, warnings=["more candidates than can be ranked"])
            universes.put(universe, rows.drop("overflow"), expires)
        finally:
            rows.unpersist()
    try:
        got = [r.asDict(recursive=True) for r in universes.page(universe, start, n, now).collect()]
        size = universes.size(universe)
    except (KeyError, IndexError) as e:
        raise BadRequest("cursor expired") from e
    more = start + n < size
    return Envelope(got, "docs_routing", evidence=["docs"], capability="resource_backed", truncated=more, next_cursor=cursors.make(identity, start + n, universe) if more else None)


def governing_docs(docs: DataFrame, terms: Iterable[str], k: int = 5) -> DataFrame:
    """path, score, rank. docs: path, status, currency. A shortlist of four times k by path terms and priority, then currency counts as well."""
    low = F.lower("path")
    toks = F.filter(F.split(low, "[^a-z0-9_]+"), lambda x: x != "")
    score = F.lit(0.0)
    for t in terms:
        score = score + F.when(F.array_contains(toks, t), 3.0).when(low.contains(t), 1.0).otherwise(0.0)
    first = docs.withColumn("score", score + A.authority_priority(F.col("status"))).where(score > 0)
    top = first.orderBy(F.desc("score"), F.asc("path")).limit(4 * k)
    currency = A.priority_of(F.col("currency"))
    return ranked(top.select("path", (F.col("score") + currency).alias("score")), [F.desc("score"), F.asc("path")], k)


def context_for_task(task: str, files: DataFrame, docs: DataFrame, nodes: DataFrame, explicit: Iterable[str] = (), max_files: int = 5, max_docs: int = 5, max_symbols: int = 20) -> DataFrame:
    """part (file, doc, symbol), item, path, score, rank: what bears on a task. Each part is a top-k of its own."""
    terms, explicit = PL.task_terms(task), list(explicit)
    f = PL.related_files(files.select("path"), task, explicit, max_files).select(F.lit("file").alias("part"), F.col("path").alias("item"), "path", F.col("score").cast("double").alias("score"), "rank")
    d = governing_docs(docs, terms, max_docs).select(F.lit("doc").alias("part"), F.col("path").alias("item"), "path", F.col("score").cast("double").alias("score"), "rank")
    s = DOC.ranked_symbols(nodes, terms[:5], explicit, max_symbols).select(F.lit("symbol").alias("part"), F.col("name").alias("item"), "path", F.col("score").cast("double").alias("score"), "rank")
    return f.unionByName(d).unionByName(s)


def repository_status(snapshots: DataFrame, documents: DataFrame, files: DataFrame) -> DataFrame:
    """repo, snapshots, latest, freshness, files, documents: a row for each repository, counts of its latest snapshot."""
    last = snapshots.groupBy("repo").agg(F.count(F.lit(1)).alias("snapshots"), F.max(F.struct("snapshot_id", "freshness")).alias("x")).select("repo", "snapshots", F.col("x.snapshot_id").alias("latest"), "x.freshness")
    n = lambda df, name: df.groupBy(F.col("snapshot_id").alias("latest")).agg(F.count(F.lit(1)).alias(name))
    out = last.join(n(files, "files"), "latest", "left").join(n(documents, "documents"), "latest", "left")
    return out.select("repo", "snapshots", "latest", "freshness", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("documents", F.lit(0)).alias("documents"))


def platforms(files: DataFrame) -> DataFrame:
    """platform, files: what a repository is built for, told from its marker files."""
    return files.select(F.explode(F.filter(F.array(*(F.when(F.lower("path").rlike(regex), name) for name, regex in PLATFORMS)), lambda x: x.isNotNull())).alias("platform")).groupBy("platform").agg(F.count(F.lit(1)).alias("files"))


# Marker files of platforms.
PLATFORMS = [
    ("aws_sam", r"(^|/)(template|sam)\.(ya?ml|json)$"), ("cmake", r"(^|/)cmakelists\.txt$"), ("docker", r"(^|/)(dockerfile|docker-compose\.ya?ml)$"), ("dotnet", r"\.(sln|csproj|fsproj|vbproj)$"), ("github_actions", r"^\.github/workflows/"),
    ("go", r"(^|/)go\.(mod|work)$"), ("node", r"(^|/)package\.json$"), ("python", r"(^|/)(pyproject\.toml|setup\.cfg|requirements\.txt)$"), ("ruby", r"(^|/)gemfile$"),
]


def overview(files: DataFrame, k: int = 20) -> DataFrame:
    """path, score, rank of the key files of a repository."""
    return ranked(files.select("path", PL.key_file_rank(F.col("path")).alias("score")).where("score > 0"), [F.desc("score"), F.asc("path")], k)


def in_any_scope(path: Column, scopes: list[str]) -> Column:
    out = F.lit(not scopes)
    for s in scopes:
        out = out | P.in_scope(path, s)
    return out
