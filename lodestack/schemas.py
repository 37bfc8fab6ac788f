"""Schemas of the evidence tables; nothing is inferred from data."""

from __future__ import annotations

RANGE = "struct<start_line:int,start_column:int,end_line:int,end_column:int>"
SNAPSHOTS = "snapshot_id long, repo_identity string, config_identity string, freshness string, schema_version int, created_at timestamp, publication_state string, controller_generation long, invalidation_generation long, publication_updated_at timestamp, composition_fingerprint string"
UNITS = "snapshot_id long, repository_key string, parent_repository_key string, path_prefix string, depth int, state string, declaration_path string, head_gitlink_oid string, index_gitlink_oid string, worktree_head_oid string, pinned_revision_matches boolean, cleanliness string, source_available boolean, evidence_paths array<string>, claim_blockers string, receipt_group string"
FILES = "file_id long, snapshot_id long, path string, language string, content_hash string, size_bytes long, mtime_ms long, indexed_at timestamp, node_count int, indexing_error string"
NODES = f"node_id string, path string, kind string, name string, qualified_name string, language string, range {RANGE}, signature string, docstring string, metadata string"
EDGES = f"source string, target string, kind string, path string, range {RANGE}, provenance string, confidence double, metadata string"
REFS = f"source string, name string, kind string, path string, language string, range {RANGE}, static boolean, receiver string, import_dir string, paths array<string>, confidence double, metadata string"
DOCUMENTS = "doc_id long, snapshot_id long, path string, title string, content_hash string, byte_count long, indexed_at timestamp, selected_text string, selected_text_truncated boolean"
HEADINGS = "doc_id long, heading_id string, heading_text string, depth int, line int"
CONCERN_TERMS = "snapshot_id long, concern_key string, normalized_term string, token_count int"
CONCERN_OWNERS = "snapshot_id long, concern_key string, mapped_owner_path string, document_id string, owner_state string, source_line int, exclusion_reason string, superseded_by string, declared_canonical_owner string"
COVERAGE = "snapshot_id long, evidence_class string, state string, indexed_files long, eligible_files_seen long, admitted_files long, extracted_files long, scan_truncated boolean, extraction_truncated boolean, continuation_cursor string, policy_excluded_files long, reason string"
EXTRACTED = f"path string, language string, nodes array<struct<{', '.join(f.strip().replace(' ', ':', 1) for f in ('node_id string', 'kind string', 'name string', 'qualified_name string'))}, range:{RANGE}, signature:string, docstring:string, metadata:string>>, edges array<struct<source:string, target:string, kind:string, range:{RANGE}, provenance:string, confidence:double, metadata:string>>, refs array<struct<source:string, name:string, kind:string, range:{RANGE}, static:boolean, receiver:string, import_dir:string, paths:array<string>, confidence:double, metadata:string>>, error string"

# Closed vocabularies.
ENUMS = {
    "freshness": ["fresh", "stale", "cold", "refreshing", "unknown"],
    "publication_state": ["building", "published", "superseded", "failed"],
    "coverage_state": ["complete", "partial", "refreshing", "stale", "blocked", "unknown"],
    "owner_state": ["valid", "draft", "missing", "archived", "superseded", "conflicting", "excluded"],
    "document_status": ["current", "draft", "historical", "legacy", "archived", "template", "sample", "unknown"],
    "event_kind": ["created", "modified", "deleted", "renamed"],
    "capability": ["semantic", "partial_semantic", "resource_backed", "unsupported"],
}


def violations(df, enums: dict[str, str] | None = None, unique: list[str] | None = None, unit_interval: list[str] | None = None):
    """Rows that break a constraint, with `violation`: what an enforcing store would refuse. Run before publication."""
    from pyspark.sql import functions as F

    bad = F.lit(None).cast("string")
    for col, enum in (enums or {}).items():
        bad = F.when(~F.col(col).isin(ENUMS[enum]), f"{col} not in {enum}").otherwise(bad)
    for col in unit_interval or []:
        bad = F.when(~F.col(col).between(0, 1), f"{col} outside 0..1").otherwise(bad)
    out = df.withColumn("violation", bad).where("violation IS NOT NULL")
    if unique:
        twice = df.groupBy(*unique).count().where("count > 1").drop("count")
        out = out.unionByName(df.join(twice, unique, "left_semi").withColumn("violation", F.lit("repeated " + ", ".join(unique))))
    return out
