"""Project shapes, validation environments, repository composition, routing intent, contract drift."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Shape, role and the expression on lower-cased paths that shows it: fixed values.
SHAPES = [
    ("rails", "routes", r"(^|/)config/routes(\.rb$|/)"), ("rails", "controller", r"(^|/)app/controllers/.*\.rb$"), ("rails", "model", r"(^|/)app/models/.*\.rb$"), ("rails", "view", r"(^|/)app/views/"), ("rails", "test", r"(^|/)(test|spec)/.*\.rb$"), ("rails", "manifest", r"(^|/)gemfile$"),
    ("js_ts", "manifest", r"(^|/)package\.json$"), ("js_ts", "config", r"(^|/)tsconfig[^/]*\.json$"), ("js_ts", "workspace", r"(^|/)pnpm-workspace\.yaml$"), ("js_ts", "test", r"\.(test|spec)\.[jt]sx?$"),
    ("rpc_server", "entrypoint", r"(^|/)src/(server|index|main)\.[jt]s$"), ("rpc_server", "registry", r"(^|/)(registries|tools)/[^/]+\.[jt]s$"),
    ("environment", "devcontainer", r"(^|/)\.devcontainer(/devcontainer)?\.json$|(^|/)\.devcontainer/devcontainer\.json$"), ("environment", "compose", r"(^|/)(docker-)?compose(\.[^/]+)?\.ya?ml$"), ("environment", "container", r"(^|/)dockerfile(\.[^/]+)?$"), ("environment", "policy", r"(^|/)validation-policy\.(json|ya?ml)$"),
]


def shapes(files: DataFrame) -> DataFrame:
    """shape, role, root, files: how many files play each role below each root (the directory above the role's own part)."""
    low = F.lower("path")
    hits = F.array(*(F.when(low.rlike(regex), F.struct(F.lit(s).alias("shape"), F.lit(r).alias("role"), F.regexp_extract(low, f"^(.*?)(?:{regex})", 1).alias("root"))) for s, r, regex in SHAPES))
    each = files.select(F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("h")).select("h.shape", "h.role", F.when(F.col("h.root") == "", ".").otherwise(F.regexp_replace("h.root", "/+$", "")).alias("root"))
    return each.groupBy("shape", "role", "root").agg(F.count(F.lit(1)).alias("files"))


def host_blocked(files: DataFrame, policy_text: Column) -> DataFrame:
    """One row: whether environments exist, and whether a policy file forbids commands on the host."""
    env = F.coalesce(F.bool_or(F.lower("path").rlike("|".join(r for s, k, r in SHAPES if s == "environment" and k != "policy"))), F.lit(False))
    forbids = F.coalesce(F.bool_or(F.lower("path").rlike(SHAPES[-1][2]) & policy_text.rlike(r'(?i)"?host_commands"?\s*:\s*"?(blocked|forbidden|false)')), F.lit(False))
    return files.agg(env.alias("environment"), forbids.alias("blocked"))


class CompositionError(ValueError):
    pass


def composition(root: str, declared: Callable[[str], Iterable[tuple[str, str]]], most_depth: int = 4, most: int = 20) -> list[dict]:
    """Units of a repository and its declared submodules: key, parent, prefix, depth, blockers; small by its limits.

    declared(key) gives (path, key) of the submodules of a unit. Cycles, unsafe paths and limits become blockers.
    """
    out: list[dict] = []

    def visit(key: str, parent: str | None, prefix: str, depth: int, line: tuple[str, ...]) -> None:
        unit = {"repository_key": key, "parent_repository_key": parent, "path_prefix": prefix, "depth": depth, "claim_blockers": []}
        out.append(unit)
        for path, child in sorted(declared(key)):
            parts = path.split("/")
            if path.startswith("/") or "\\" in path or any(p in ("", ".", "..") for p in parts):
                unit["claim_blockers"].append("unsafe_path")
            elif child in line:
                unit["claim_blockers"].append("cycle")
            elif depth + 1 > most_depth:
                unit["claim_blockers"].append("depth_limit")
            elif len(out) >= most:
                unit["claim_blockers"].append("repository_limit")
            else:
                visit(child, key, path if prefix == "." else f"{prefix}/{path}", depth + 1, (*line, child))

    visit(root, None, ".", 0, (root,))
    return out


def fingerprint(units: list[dict]) -> str:
    return hashlib.sha256(json.dumps(sorted(units, key=lambda u: (u["path_prefix"], u["repository_key"])), sort_keys=True, separators=(",", ":")).encode()).hexdigest()


#: Families of words that decide the intent of a task: fixed values.
INTENT = {
    "edit": ["add", "change", "create", "delete", "edit", "fix", "implement", "migrate", "modify", "refactor", "remove", "rename", "replace", "update", "write"],
    "closure": ["close", "complete", "done", "finish", "merge", "release", "ship"],
    "read_only": ["describe", "document", "explain", "find", "inspect", "list", "read", "review", "show", "summarize", "understand", "where"],
}


def intent(task: str) -> dict:
    """edit, closure or read_only; negated change phrases are read-only; both edit and read-only words are a conflict."""
    low = task.lower()
    words = set(re.findall(r"[a-z]+", low))
    negated = bool(re.search(r"\b(do not|don't|without|no)\s+(\w+\s+)?(chang|edit|modif|writ|touch)\w*", low))
    has = {k: bool(words & set(v)) for k, v in INTENT.items()}
    kind = "read_only" if negated else "edit" if has["edit"] else "closure" if has["closure"] else "read_only"
    references = kind in ("edit", "closure") or bool(words & {"callers", "impact", "references", "usages"}) and not words & {"definition", "defined"}
    return {"intent": kind, "conflict": has["edit"] and has["read_only"] and not negated, "needs_references": references}


def drift(schema: dict, example: object, at: str = "$") -> list[str]:
    """Where a JSON example departs from a schema (type, required, properties, items, enum)."""
    kinds = {"object": dict, "array": list, "string": str, "integer": int, "number": (int, float), "boolean": bool, "null": type(None)}
    kind = schema.get("type")
    if kind and (not isinstance(example, kinds[kind]) or kind in ("integer", "number") and isinstance(example, bool)):
        return [f"{at}: not {kind}"]
    out = [f"{at}: not in enum"] if "enum" in schema and example not in schema["enum"] else []
    if isinstance(example, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in example]
        out += [f"{at}.{k}: unknown" for k in example if known and k not in known]
        for k, v in example.items():
            out += drift(known[k], v, f"{at}.{k}") if k in known else []
    if isinstance(example, list) and "items" in schema:
        for i, v in enumerate(example):
            out += drift(schema["items"], v, f"{at}[{i}]")
    return out


def evidence_points(path: Column, sessions: Column) -> Column:
    """Path evidence of an integration task: provider hooks 35 (30 more at session start), source synchronisation 55."""
    low = F.lower(path)
    return F.when(low.rlike(r"(^|/)hooks?/"), 35).otherwise(0) + F.when(low.rlike(r"(^|/)hooks?/") & sessions, 30).otherwise(0) + F.when(low.rlike(r"(^|/)(sync|source-sync)[^/]*"), 55).otherwise(0)
