"""Documentation concerns and ranked search from end to end: map, owners, index, readiness, candidates, rank, page; set audit."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.functions import authority as A
from lodestack.functions import paths as P
from lodestack.functions import text as T
from lodestack.operators import search as S
from lodestack.operators.relational import first_of, offset_page, ranked

MOST_MAP_BYTES, OWNER_PREFIX = 120_000, 16_384


def normal(text: str) -> str:
    """The concern normaliser on the driver, for one small map."""
    low = unicodedata.normalize("NFKC", text).lower()
    return " ".join("".join(" " if unicodedata.category(c)[0] in "PSZ" else c for c in low).split())


@dataclass
class ConcernMap:
    """A parsed registry: rows of (concern_key, term, owner path, line); invalid as a whole when one row is."""

    state: str
    rows: list[tuple[str, str, str, int]] = field(default_factory=list)


def safe_path(path: str) -> str | None:
    out: list[str] = []
    if path.startswith("/") or not path:
        return None
    for p in path.replace("\\", "/").split("/"):
        if p == "..":
            if not out:
                return None
            out.pop()
        elif p not in ("", "."):
            out.append(p)
    return "/".join(out) or None


def parse_concern_map(text: str | None) -> ConcernMap:
    """First table with columns concern and canonical owner, and perhaps intent terms (separated by semicolons)."""
    if text is None:
        return ConcernMap("no_map")
    if len(text.encode()) > MOST_MAP_BYTES:
        return ConcernMap("invalid")
    cells = lambda line: [c.strip() for c in line.strip().strip("|").split("|")]
    columns: dict[str, int] | None = None
    found: dict[tuple[str, str, str], int] = {}
    for n, line in enumerate(text.splitlines(), 1):
        if columns is None:
            if line.lstrip().startswith("|"):
                names = [normal(c) for c in cells(line)]
                if "concern" in names and "canonical owner" in names:
                    columns = {c: i for i, c in enumerate(names)}
            continue
        if not line.strip():
            continue
        if not line.lstrip().startswith("|"):
            break
        row = cells(line)
        if all(re.fullmatch(r":?-*:?", c) for c in row):
            continue
        get = lambda name: row[columns[name]] if name in columns and columns[name] < len(row) else ""  # noqa: E731, B023
        label, owners = normal(get("concern")), re.findall(r"\]\(([^)\s]+)\)|`([^`]+)`", get("canonical owner"))
        owners = [a or b for a, b in owners] or [o.strip() for o in get("canonical owner").split(",") if o.strip()]
        terms = [label, *(normal(t) for t in get("intent terms").split(";") if get("intent terms"))]
        safe = [safe_path(o) for o in owners]
        if not label or not safe or None in safe or "" in terms:
            return ConcernMap("invalid")
        for t in terms:
            for o in safe:
                key = (label.replace(" ", "-"), t, str(o))
                found[key] = min(found.get(key, n), n)
    if columns is None:
        return ConcernMap("no_map")
    return ConcernMap("valid", [(*k, n) for k, n in found.items()])


def owner_state(exists: Column, excluded: Column, status: Column, superseded_by: Column, owners: Column) -> Column:
    """State of a mapped owner; owners: different canonical owners that the document's own front block and the map name."""
    some = F.coalesce(F.length(F.trim(superseded_by)) > 0, F.lit(False))
    return F.when(excluded, "excluded").when(~exists, "missing").when(owners > 1, "conflicting").when(some, "superseded").when(status.isin("archived", "legacy", "historical"), "archived").when(status == "draft", "draft").otherwise("valid")


def concern_tables(spark: SparkSession, parsed: ConcernMap, docs: DataFrame) -> dict[str, DataFrame]:
    """terms (concern_key, term, token_count) and owners (concern_key, path, owner_state, source_line). docs: path, text."""
    rows = spark.createDataFrame(parsed.rows, "concern_key string, term string, path string, source_line int")
    terms = rows.select("concern_key", "term", F.size(F.split("term", " ")).alias("token_count")).distinct()
    heads = docs.select("path", A.front_matter(F.substring("text", 1, OWNER_PREFIX)).alias("m")).withColumn("_there", F.lit(True))
    own = first_of(rows.drop("term"), ["concern_key", "path"], [F.col("source_line")]).join(heads, "path", "left")
    declared = F.col("m")["canonical_owner"]
    status = A.status(F.col("path"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("m")["status"])
    state = owner_state(F.col("_there").isNotNull(), P.is_fixture_markdown(F.col("path")), status, F.col("m")["superseded_by"], F.when(declared.isNotNull() & (declared != F.col("path")), 2).otherwise(1))
    return {"terms": terms, "owners": own.select("concern_key", "path", state.alias("owner_state"), "source_line")}


def docs_index(files: DataFrame, mapped: list[str] | None = None, most_bytes: int = MOST_MAP_BYTES) -> DataFrame:
    """Markdown files as documents: path, title, headings, selected text, truncation; fixtures are left out, mapped owners are not."""
    p, low = F.col("path"), F.lower("path")
    md = files.where(low.rlike(r"\.(md|markdown|mdx)$") & (~P.is_fixture_markdown(p) | p.isin(mapped or [])))
    heads = T.heading_lines(F.col("text"))
    prio = F.when(low == "agents.md", 100).when(low.rlike(r"(^|/)readme\.md$"), 95).when(low.startswith("docs/"), 90).when(low.startswith("doc/"), 85).otherwise(10)
    return md.select("path", F.coalesce(F.get(heads, 0)["text"], P.stem(p)).alias("title"), F.transform(heads, lambda h: h["text"]).alias("headings"), T.utf8_prefix(F.col("text"), most_bytes).alias("selected_text"), (F.octet_length("text") > most_bytes).alias("truncated"), prio.alias("priority"))


def readiness(map_state: str, coverage_state: str, validity: str) -> tuple[str, str | None]:
    """(ready or blocked, recovery hint)."""
    if validity == "stale" or coverage_state in ("refreshing", "stale"):
        return "blocked", "refresh"
    if coverage_state == "blocked":
        return "blocked", "environment_repair"
    if map_state == "invalid":
        return "blocked", "request_repair"
    return ("ready", None) if coverage_state == "complete" else ("blocked", "refresh")


def ranked_search(index: DataFrame, query: str, concerns: dict[str, DataFrame] | None = None, scope: str | None = None, cap: int | None = S.CANDIDATES, now: str = "1970-01-01", files: DataFrame | None = None, explain: bool = False) -> DataFrame:
    """path, rank and its eight components for a query over docs_index rows; one overflow row when a source or the union exceeds the cap (None: all are ranked).

    With files (path, mtime_ms) each hit has modified_at, null for documents that are no files; explain adds the reasons of the rank.

    Both candidate sources are cut at cap + 1 before they meet, so the ranking handles a bounded set
    whatever the corpus holds; without a cap all candidates are ranked, in ranges of the order. Owners come by the query's n-grams, an equi-join on terms.
    """
    terms = T.docs_terms(query)
    docs = index.where(P.in_scope(F.col("path"), scope)).withColumn("_heads", F.array_join("headings", " "))
    hits = bm25_or_none(docs, {"path": 7.0, "title": 9.0, "_heads": 6.0, "selected_text": 1.0}, terms)
    cut = lambda df, *order: df if cap is None else df.orderBy(*order).limit(cap + 1)
    fts = cut(hits.select("path", F.col("score").alias("lexical")), F.desc("lexical"), "path")
    spark = index.sparkSession
    if concerns is None:
        owners = fts.select("path", F.array().cast("array<string>").alias("states")).limit(0)
    else:
        q = spark.range(1, numPartitions=1).select(F.lit(1).alias("q"), F.lit(query).alias("text"))
        matched = S.resolve_phrases(q, "q", "text", concerns["terms"], "term", 12).select("term").distinct()
        keys = concerns["terms"].join(matched, "term", "left_semi").select("concern_key").distinct()
        owners = cut(concerns["owners"].join(keys, "concern_key", "left_semi").join(docs.select("path"), "path", "left_semi").groupBy("path").agg(F.array_sort(F.collect_set("owner_state")).alias("states")), "path")
    union = fts.join(owners, "path", "full_outer")
    c = union.join(index, "path")
    if cap is not None:
        n = union.agg(F.count("lexical").alias("fts"), F.count("states").alias("own"), F.count(F.lit(1)).alias("all"))
        over = F.greatest("fts", "own", "all") > cap
        c = c.join(F.broadcast(n), ~over)
    none = F.lit(None).cast("string")
    m = A.front_matter(F.col("selected_text"))
    status = A.status(F.col("path"), F.col("title"), F.col("selected_text"), m["status"])
    c = c.withColumn("m", m).withColumn("status", status)
    owner = F.coalesce(F.size("states"), F.lit(0)) > 0
    current = A.currency(F.col("path"), F.col("status"), F.col("m")["canonical_owner"], F.col("m")["superseded_by"], F.col("m")["review_after"], F.when(owner, F.col("path")).otherwise(none), now)["state"]
    c = c.withColumn("authority", A.authority(F.col("status"))).withColumn("currency", current)
    band = S.relevance_band(query, F.col("title"), F.col("headings"), F.col("selected_text"), F.col("lexical").isNotNull(), owner)
    tier = S.owner_tier(F.col("states"), F.col("authority"), F.col("currency"))
    c = c.select("path", F.col("path").alias("doc_id"), F.when(owner & F.exists("states", lambda s: s == "valid"), 0).otherwise(1).alias("owner_priority"), band.alias("band"), tier.alias("owner_tier"), "authority", "currency", F.round("lexical", 6).alias("lexical"), F.when(F.col("lexical").isNotNull() & owner, "fts_and_matched_owner").when(owner, "matched_owner").otherwise("fts").alias("candidate_source"))
    out = S.rank_documents(c, cap)
    if files is not None:
        out = out.join(files.select("path", F.timestamp_millis("mtime_ms").alias("modified_at")), "path", "left")
    if explain:
        out = out.withColumn("reasons", S.rank_reasons())
    out = out.withColumn("overflow", F.lit(False))
    if cap is None:
        return out
    blocked = n.where(over).select(*(F.lit(None).cast(t).alias(k) for k, t in out.dtypes if k != "overflow"), F.lit(True).alias("overflow"))
    return out.unionByName(blocked)


#: Full-text hits that the legacy search rescores at least.
WINDOW = 500


def legacy_search(index: DataFrame, query: str, n: int = 10, offset: int = 0, scope: str | None = None, now: str = "1970-01-01") -> DataFrame:
    """path, score, rank, more: the page offset + 1 to offset + n of a window of full-text hits, rescored by path, authority, currency and fields.

    The window holds the best max(offset + n + 1, 500) hits by BM25, then path; rescoring sees these alone.
    """
    terms = T.docs_terms(query)
    docs = index.where(P.in_scope(F.col("path"), scope)).withColumn("_heads", F.array_join("headings", " "))
    hits = bm25_or_none(docs, {"path": 7.0, "title": 9.0, "_heads": 6.0, "selected_text": 1.0}, terms)
    top = hits.orderBy(F.desc("score"), "path").limit(max(offset + n + 1, WINDOW))
    m, none = A.front_matter(F.col("selected_text")), F.lit(None).cast("string")
    top = top.withColumn("_m", m).withColumn("_status", A.status(F.col("path"), F.col("title"), F.col("selected_text"), F.col("_m")["status"]))
    currency = A.currency(F.col("path"), F.col("_status"), F.col("_m")["canonical_owner"], F.col("_m")["superseded_by"], F.col("_m")["review_after"], none, now)["priority"]
    boost = T.field_boost(F.col("title"), F.col("path"), F.col("headings"), F.col("selected_text"), query, terms)
    score = F.greatest(F.lit(0.0), F.greatest(F.lit(0.0), F.col("score")) + A.path_boost(F.col("path")) + A.authority_priority(F.col("_status")) + currency + boost)
    return offset_page(top.select("path", F.round(score, 4).alias("score")), [F.desc("score"), F.asc("path")], offset, n).select("path", "score", "rank", "more")


def bm25_or_none(docs: DataFrame, fields: dict[str, float], terms: list[str]) -> DataFrame:
    """BM25 hits; none for a query without terms."""
    return S.bm25(docs, fields, terms) if terms else docs.withColumn("score", F.lit(0.0)).limit(0)


def audit(findings: DataFrame, docs: DataFrame, start: int = 0, n: int = 20) -> DataFrame:
    """Chunk of a Markdown set: path, findings, worst-first totals; fingerprint of the whole set binds the cursor."""
    chunk = docs.select("path").orderBy("path").offset(start).limit(n)
    total = docs.agg(F.count(F.lit(1)).alias("docs"), F.sha2(F.coalesce(F.sum(F.xxhash64("path").cast("decimal(38,0)")), F.lit(0)).cast("string"), 256).alias("fingerprint"))
    by = findings.groupBy("path").agg(F.count(F.lit(1)).alias("findings"))
    return chunk.join(by, "path", "left").join(F.broadcast(total), F.lit(True)).select("path", F.coalesce("findings", F.lit(0)).alias("findings"), "docs", "fingerprint", (F.lit(start + n) < F.col("docs")).alias("more"))


def ranked_symbols(nodes: DataFrame, terms: list[str], files: list[str] | None = None, k: int = 20) -> DataFrame:
    """Symbols for a task: the best of what each term gives (equal 20, contains 10), a requested file 50, Python 2."""
    name = F.lower("name")
    points = F.greatest(*(F.when(name == t, 20).when(name.contains(t), 10).otherwise(0) for t in terms), F.lit(0), F.lit(0))
    wanted = F.col("path").isin(files or [])
    score = points + F.when(wanted, 50).otherwise(0) + F.when(F.col("language") == "python", 2).otherwise(0) + (F.when(wanted, 20).otherwise(5) if files else F.lit(0))
    return ranked(nodes.where(points > 0).select("node_id", "name", "path", score.alias("score")), [F.desc("score"), F.asc("path"), F.asc("name"), F.asc("node_id")], k)


def merged_feedback(diagnostics: DataFrame, validations: DataFrame, deferred: DataFrame) -> DataFrame:
    """path, checks, outcome: per path the worst of all checks; failed over blocked over deferred over passed."""
    order = F.array(*map(F.lit, ("passed", "deferred", "blocked", "failed")))
    every = diagnostics.select("path", F.when(F.col("severity") == "error", "failed").otherwise("passed").alias("o")).unionByName(validations.select("path", F.col("outcome").alias("o"))).unionByName(deferred.select("path", F.lit("deferred").alias("o")))
    return every.groupBy("path").agg(F.count(F.lit(1)).alias("checks"), F.element_at(order, F.max(F.array_position(order, F.col("o"))).cast("int")).alias("outcome"))
