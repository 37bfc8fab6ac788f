"""Ranking and planning rules: key files, documents for a task, related files, verification plans, trust."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestack.functions import authority as A
from lodestack.functions import paths as P
from lodestack.functions.text import is_json
from lodestack.operators.relational import longest_prefix, ranked


def points(rules: list[tuple[str, float]], low: Column) -> Column:
    """Sum of the points of all patterns that occur."""
    out = F.lit(0.0)
    for regex, n in rules:
        out = out + F.when(low.rlike(regex), float(n)).otherwise(0.0)
    return out


# Rank of files of an overview. The first group decides alone, the second adds up.
KEY_FILE_ALONE = [(r"^cmakelists\.txt$", 130), (r"/cmakelists\.txt$", 125), (r"\.sln$", 320), (r"\.(cs|fs|vb)proj$", 300), (r"(^|/)(template|sam)\.(ya?ml|json)$", 290), (r"(^|/)(lambda_)?handlers?(/|\.[a-z]+$)", 170), (r"/tests?/infra/", 120)]
KEY_FILE_SUM = [
    (r"/program\.cs$", 115), (r"/controllers/", 95), (r"/routes/", 95), (r"\.razor$|/pages/|/shared/", 90), (r"/components/", 88), (r"/migrations/|dbcontext", 85), (r"(^|/)appsettings[^/]*$", 82), (r"^go\.(mod|work)$", 120),
    (r"^(pyproject\.toml|package\.json)$", 100), (r"(^|/)(tsconfig[^/]*\.json|pnpm-workspace\.yaml|vite\.config\.[a-z]+|.+/package\.json)$", 96), (r"^dockerfile$|^\.devcontainer/", 80), (r"^(apps|packages|services)/", 82),
    (r"^(src|lib|app|cmd|internal|include)/", 70), (r"^tests?/", 55), (r"\.(test|spec)\.[jt]sx?$", 55), (r"^\.github/workflows/", 20), (r"\.(cc|cpp|cxx|h|hh|hpp|hxx|c|go)$", 8), (r"\.(cs|razor|cshtml)$", 8), (r"\.pyi?$", 6),
    (r"/generated/|/fixtures/", -60), (r"^tests/fixtures/|/fixture", -140), (r"template-generated", -90),
]
KEY_DOCS = [(r"^agents\.md$", 220), (r"^readme\.md$", 210), (r"^docs/guides/", 90), (r"architecture|design", 70), (r"runbook|operations|developer", 60), (r"^docs/reference/", 50), (r"^skills/", 85), (r"/skill\.md$", 45), (r"template", -80), (r"/fixtures/|^tests/fixtures/", -140), (r"/archive/|^docs/archive/", -70), (r"/updates/|^docs/updates/", -60), (r"project-management|/plans/", -40)]
DOC_IMPORTANCE = [(r"readme", 100), (r"guide", 80), (r"runbook|operations", 70), (r"architecture|design", 65), (r"docs/reference", 30)]
CURRENT_DOCS = [(r"readme", 20), (r"documentation-map", 18), (r"runtime-contract|mcp-surface", 16), (r"design|architecture", 12), (r"reference|runbook", 10)]
NOISE = [(r"(^|/)(vendor|node_modules|third_party|3rdparty)/", 12), (r"(^|/)fixtures?/", 12), (r"(^|/)generated/|installer", 12), (r"\.(md|txt)$", 3)]


def key_file_rank(path: Column) -> Column:
    low, out = F.lower(path), None
    for regex, n in KEY_FILE_ALONE:
        out = F.when(low.rlike(regex), float(n)) if out is None else out.when(low.rlike(regex), float(n))
    return out.otherwise(points(KEY_FILE_SUM, low))


def key_doc_rank(path: Column, status: Column) -> Column:
    return points(KEY_DOCS, F.lower(path)) + A.authority_priority(status) * 10


def doc_importance(path: Column) -> Column:
    return points(DOC_IMPORTANCE, F.lower(path))


def task_terms(task: str) -> list[str]:
    """Distinct lower-cased terms of two or more characters, in order."""
    return list(dict.fromkeys(t for t in re.split(r"[^a-z0-9_]+", task.lower()) if len(t) > 1))


def file_score(path: Column, terms: list[str]) -> Column:
    """Token part, first-party bonus, language affinity, less noise; not below zero."""
    low = F.lower(path)
    toks = F.filter(F.split(low, "[^a-z0-9_]+"), lambda t: F.length(t) > 1)
    total = F.lit(0.0)
    for t in terms:
        total = total + F.when(F.array_contains(toks, t), 3.0).when(low.contains(t), 1.0).otherwise(0.0)
    total = total + F.when(low.rlike(r"^(src|lib|app|cmd|internal|include|tests?|packages)/"), 2.0).otherwise(0.0)
    for lang, words in {"python": {"python"}, "typescript": {"typescript", "codex", "mcp"}, "cpp": {"c", "cpp", "cplusplus", "cmake"}}.items():
        if words & set(terms):
            total = total + F.when(P.language(path) == lang, 2.0).otherwise(0.0)
    return F.greatest(F.lit(0.0), total - points(NOISE, low))


def seeded_bonus(path: Column, seeds: Iterable[str]) -> Column:
    """The largest of what each seed path lends its neighbours: build file, same stem, tests beside or near, same root."""
    out, low, name = F.lit(0.0), F.lower(path), P.basename(path)
    for s in seeds:
        d, stem = (s.rsplit("/", 1)[0] if "/" in s else ""), s.rsplit("/", 1)[-1].rsplit(".", 1)[0]
        same_dir = P.dirname(path) == d
        test = low.rlike(r"(^|/)tests?/|[._-](test|spec)\.")
        near = path.startswith(d.split("/")[0] + "/") if d else F.lit(True)
        out = F.greatest(
            out,
            F.when(path == s, 0.0).when(same_dir & (F.lower(name) == "cmakelists.txt"), 20.0).when(same_dir & (P.stem(path) == stem), 12.0).when(F.lower(path).isin("package.json", "tsconfig.json", "pyproject.toml"), 11.0).when(same_dir & test, 10.0).when(near & test, 9.0).when(near, 8.0).otherwise(0.0),
        )
    return out


def related_files(files: DataFrame, task: str, seeds: Iterable[str] = (), k: int = 5) -> DataFrame:
    p = F.col("path")
    score = file_score(p, task_terms(task)) + seeded_bonus(p, seeds)
    return ranked(files.select("path", score.alias("score")).where("score > 0"), [F.desc("score"), F.collate("path", "UNICODE"), p], k)


def current_docs(docs: DataFrame, task: str, explicit: Iterable[str] = (), k: int = 10) -> DataFrame:
    """docs: path, authority, currency. Explicit files score 100; shortlist of four times k by score; four groups in turn."""
    p, low = F.col("path"), F.lower("path")
    score = points(CURRENT_DOCS, low)
    for t in task_terms(task):
        if len(t) > 2:
            score = score + F.when(low.contains(t), 8.0).otherwise(0.0)
    score = F.when(p.isin(list(explicit)), 100.0).otherwise(score)
    group = F.when((F.col("authority") == "canonical") & (F.col("currency") == "current"), 0).when(F.col("authority") == "non_authoritative", 3).when(F.col("currency") == "unknown", 2).otherwise(1)
    top = docs.select("path", score.alias("score"), group.alias("bucket")).where("score > 0").orderBy(F.desc("score"), p).limit(4 * k)
    return ranked(top, [F.col("bucket"), F.desc("score"), p], k)


# Verification: rules in order, each with the shape that it needs and the command it plans; nothing is run.
RULES = [
    ("go", r"(^|/)go\.(mod|work)$", r"\.go$", "go test ./..."),
    ("cmake", r"(^|/)cmakelists\.txt$", r"\.(cc|cpp|cxx|h|hh|hpp|c)$|cmakelists\.txt$", "cmake --build build"),
    ("dotnet", r"\.(sln|csproj)$", r"\.(cs|razor|cshtml|csproj)$", "dotnet build"),
    ("sam", r"(^|/)(template|sam)\.ya?ml$", r"(^|/)(template|sam)\.ya?ml$|handler", "sam validate"),
    ("ruby", r"(^|/)gemfile$", r"\.rb$", "bundle exec rake test"),
    ("package", r"(^|/)package\.json$", r"\.[cm]?[jt]sx?$", "npm test"),
    ("python", r"(^|/)(pyproject\.toml|setup\.cfg|requirements\.txt)$|\.py$", r"\.pyi?$", "python -m pytest"),
    ("docs", r"\.mdx?$", r"\.mdx?$", "review documents"),
]


def verification_plan(files: DataFrame, selected: DataFrame, host_blocked: bool = False, most: int = 10) -> DataFrame:
    """ord, family, command, status: a rule applies when its markers exist and nothing, or a file it matches, is selected.

    One aggregate over each side; the rows are the rules.
    """
    has = files.agg(*(F.coalesce(F.bool_or(F.lower("path").rlike(m)), F.lit(False)).alias(f"m_{n}") for n, m, _, _ in RULES))
    pick = selected.agg(F.count(F.lit(1)).alias("n"), *(F.coalesce(F.bool_or(F.lower("path").rlike(s)), F.lit(False)).alias(f"s_{n}") for n, _, s, _ in RULES))
    both = has.join(F.broadcast(pick), F.lit(True))
    manual = {"docs"}
    rows = [F.struct(F.lit(i).alias("ord"), F.lit(n).alias("family"), F.lit(c).alias("command"), (F.col(f"m_{n}") & ((F.col("n") == 0) | F.col(f"s_{n}"))).alias("use"), F.lit("blocked" if host_blocked and n not in manual else "planned").alias("status")) for i, (n, _, _, c) in enumerate(RULES)]
    return both.select(F.explode(F.array(*rows)).alias("r")).where("r.use").select("r.ord", "r.family", "r.command", "r.status").orderBy("ord").limit(most)


def nearest_tests(sources: DataFrame, tests: DataFrame) -> DataFrame:
    """source, test, affinity, distance: for each source the test whose name holds its stem, or else the nearest.

    Tests that share the stem meet their sources in an equi-join; the rest is a nearest-path search.
    """
    from lodestack.operators.docs import nearest

    strip = lambda c: F.regexp_replace(F.lower(P.stem(c)), r"^test_|[._-]?(test|tests|spec)$", "")
    s = sources.select(F.col("path").alias("source"), P.dirname(F.col("path")).alias("dir"), F.lower(P.stem(F.col("path"))).alias("key"))
    t = tests.select(F.col("path").alias("test"), P.dirname(F.col("path")).alias("tdir"), strip(F.col("path")).alias("key"))
    same = s.join(t, "key").select("source", "test", P.distance(F.col("dir"), F.col("tdir")).alias("distance"))
    same = same.groupBy("source").agg(F.min(F.struct("distance", "test")).alias("b")).select("source", F.col("b.test").alias("test"), F.lit(1).alias("affinity"), F.col("b.distance").cast("long").alias("distance"))
    rest = nearest(s.join(same, "source", "left_anti"), "source", "dir", t, "test", "tdir").withColumn("affinity", F.lit(0)).select("source", "test", "affinity", "distance")
    return same.unionByName(rest)


def project_units(files: DataFrame, selected: DataFrame | None = None, most: int = 20) -> DataFrame:
    """root, ecosystem, selected: manifest directories, those that hold selected files first."""
    marks = {"go": r"(^|/)go\.mod$", "node": r"(^|/)package\.json$", "python": r"(^|/)pyproject\.toml$", "rust": r"(^|/)cargo\.toml$", "ruby": r"(^|/)gemfile$", "cmake": r"(^|/)cmakelists\.txt$", "dotnet": r"\.(sln|csproj)$"}
    kind = None
    for k, regex in marks.items():
        kind = F.when(F.lower("path").rlike(regex), k) if kind is None else kind.when(F.lower("path").rlike(regex), k)
    root = F.when(P.dirname(F.col("path")) == "", ".").otherwise(P.dirname(F.col("path")))
    units = files.withColumn("ecosystem", kind).where("ecosystem IS NOT NULL").select(root.alias("root"), "ecosystem").distinct()
    if selected is None:
        return units.withColumn("selected", F.lit(0).cast("long")).orderBy("root", "ecosystem").limit(most)
    n = longest_prefix(selected.select("path"), "path", units.select(F.col("root").alias("prefix"), F.col("root").alias("k")).distinct(), "prefix", "k").groupBy(F.col("unit").alias("root")).agg(F.count(F.lit(1)).alias("selected"))
    return units.join(n, "root", "left").select("root", "ecosystem", F.coalesce("selected", F.lit(0)).alias("selected")).orderBy(F.desc("selected"), "root", "ecosystem").limit(most)


def package_scripts(packages: DataFrame) -> DataFrame:
    """root, script, command of package manifests (path, text); invalid JSON gives none."""
    scripts = F.from_json("text", "struct<scripts:map<string,string>>")["scripts"]
    return packages.select(F.when(P.dirname(F.col("path")) == "", ".").otherwise(P.dirname(F.col("path"))).alias("root"), F.explode(scripts).alias("script", "command"))


def nearest_packages(files: DataFrame, packages: DataFrame) -> DataFrame:
    """path, root: the nearest package above each file, null where there is none. packages: path of each manifest."""
    root = F.when(P.dirname(F.col("path")) == "", ".").otherwise(P.dirname(F.col("path")))
    roots = packages.select(root.alias("prefix")).distinct().withColumn("k", F.col("prefix"))
    return longest_prefix(files.select("path"), "path", roots, "prefix", "k").select("path", F.col("unit").alias("root"))


def scripts_for(files: DataFrame, packages: DataFrame, wanted: Iterable[str] = ("test", "lint", "typecheck", "build")) -> DataFrame:
    """root, script, command of the nearest packages of the files: what may be planned for them. packages: path, text."""
    own = nearest_packages(files, packages).where("root IS NOT NULL").select("root").distinct()
    return package_scripts(packages).where(F.col("script").isin(list(wanted))).join(own, "root", "left_semi")


#: Providers of diagnostics: name, the files they take, the column that tells that a text is faulty, message.
PROVIDERS = [
    ("json_syntax", lambda p: F.lower(p).endswith(".json"), lambda t: ~is_json(t), "not one JSON value"),
    ("merge_markers", lambda p: F.lit(True), lambda t: t.rlike(r"(?m)^(<{7}|>{7}) "), "merge marker left"),
]
SEVERITIES = ["blocker", "error", "warning", "info"]


def diagnose(files: DataFrame, reason: Column | None = None) -> DataFrame:
    """path, provider, severity, message: what all providers find in files (path, text), worst first.

    Files that the path policy keeps out (reason other than "source") get one finding that says so and are not looked into.
    """
    reason = F.lit("source") if reason is None else reason
    f = files.select("path", "text", reason.alias("_reason"))
    rows = [F.struct(F.lit(name).alias("provider"), F.lit("error").alias("severity"), F.lit(message).alias("message"), (takes(F.col("path")) & F.coalesce(faulty(F.col("text")), F.lit(False))).alias("use")) for name, takes, faulty, message in PROVIDERS]
    out = F.struct(F.lit("path_policy").alias("provider"), F.lit("info").alias("severity"), F.concat(F.lit("left out: "), F.col("_reason")).alias("message"), F.lit(True).alias("use"))
    found = f.select("path", F.explode(F.when(F.col("_reason") == "source", F.array(*rows)).otherwise(F.array(out))).alias("d")).where("d.use")
    order = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    return found.select("path", "d.provider", "d.severity", "d.message").orderBy(order, "path", "provider")


def diagnostics(findings: DataFrame) -> DataFrame:
    """severity, n and the worst outcome over all findings (path, severity)."""
    order = F.array(F.lit("info"), F.lit("warning"), F.lit("error"), F.lit("blocker"))
    by = findings.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
    worst = F.element_at(order, F.max(F.array_position(order, F.col("severity"))).over(Window.partitionBy()).cast("int"))
    return by.withColumn("worst", worst)


def changed_files(sources: dict[str, DataFrame], most: int = 50) -> DataFrame:
    """path with the sources (staged, unstaged, untracked, caller) that name it; sorted, at most so many."""
    every = None
    for name, df in sources.items():
        own = df.select("path", F.lit(name).alias("source"))
        every = own if every is None else every.unionByName(own)
    return every.groupBy("path").agg(F.array_sort(F.collect_set("source")).alias("sources")).orderBy("path").limit(most)


def changed_context(sources: dict[str, DataFrame], files: DataFrame, most_files: int = 20, most_commands: int = 10, reason: Column | None = None) -> DataFrame:
    """part (file, diagnostic, command), ord, path, detail: the changed files, what providers find in them, and the commands to verify them.

    files: path, text. Diagnostics and plan look at the files of the page alone.
    """
    page = changed_files(sources, most_files)
    rows = page.select(F.lit("file").alias("part"), F.row_number().over(Window.orderBy("path")).alias("ord"), "path", F.array_join("sources", ",").alias("detail"))
    found = diagnose(files.join(F.broadcast(page.select("path")), "path", "left_semi"), reason)  # most_files rows
    order = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.split("detail", ":")[0])
    diag = found.select(F.lit("diagnostic").alias("part"), "path", F.concat_ws(": ", "severity", "provider", "message").alias("detail"))
    diag = diag.select("part", F.row_number().over(Window.orderBy(order, "path", "detail")).alias("ord"), "path", "detail")
    plan = verification_plan(files, page, most=most_commands).select(F.lit("command").alias("part"), (F.col("ord") + 1).alias("ord"), F.lit(None).cast("string").alias("path"), F.col("command").alias("detail"))
    return rows.unionByName(diag).unionByName(plan)


# Trust: what a response may be used for. Fixed values.
PROOF = ["closure_claim", "passed_validation_claim", "safe_mutation_claim", "security_or_vulnerability_claim", "task_completion_claim", "whole_program_impact_claim"]
_READ = ["direct_read_relevant_source", "inspect_ranked_evidence", "run_planned_validation"]
SURFACES = {
    "repository_status": (["navigation", "next_read_selection", "runtime_availability"], PROOF, _READ),
    "docs_session_scope": (["navigation", "next_read_selection", "runtime_availability"], PROOF, _READ),
    "integration_health": (["navigation", "next_read_selection", "runtime_availability"], PROOF, _READ),
    "integration_profile": (["navigation", "next_read_selection"], [*PROOF, "runtime_availability"], _READ),
    "context_routing": (["navigation", "next_read_selection"], PROOF, _READ),
    "docs_routing": (["navigation", "next_read_selection"], PROOF, _READ),
    "graph_symbol_routing": (["navigation", "next_read_selection"], PROOF, ["direct_read_relevant_source", "run_planned_validation"]),
    "graph_reference_routing": (["navigation", "next_read_selection"], PROOF, ["direct_read_relevant_source", "run_planned_validation"]),
    "graph_impact_routing": (["navigation", "next_read_selection"], PROOF, ["direct_read_relevant_source", "run_planned_validation"]),
    "docs_direct_read": ([], PROOF, ["direct_read_relevant_source", "run_planned_validation"]),
    "diagnostics_static": (["navigation"], PROOF, ["direct_read_relevant_source", "review_diagnostics_output", "run_planned_validation"]),
    "markdown_quality": (["navigation"], PROOF, ["direct_read_relevant_source", "review_diagnostics_output", "run_planned_validation"]),
    "validation_plan": (["validation_planning"], PROOF, ["obtain_executed_validation_evidence", "run_planned_validation"]),
    "edit_preview": (["edit_preview_review"], [*PROOF, "applied_edit_observation"], ["review_generated_diff", "run_planned_validation"]),
    "edit_apply": ([], PROOF, ["review_generated_diff", "run_planned_validation"]),
    "generic_error": (["navigation"], PROOF, ["direct_read_relevant_source", "refresh_runtime_snapshot", "resolve_blocked_environment", "run_planned_validation"]),
}


def trust(surface: str, evidence: Iterable[str] = (), capability: str = "unsupported", freshness: str = "fresh", validity: str = "valid", status: str = "not_applicable", troubled: bool = False, direct_read: bool = False, executed: bool = False, applied: bool = False) -> dict[str, list[str]]:
    """Allowed and forbidden uses and what must be verified: base sets, evidence, status, failures; forbidden wins."""
    may, may_not, verify = (set(x) for x in SURFACES[surface])
    evidence = set(evidence)
    if surface == "edit_apply":
        (may if applied else may_not).add("applied_edit_observation")
    if direct_read and "direct_read" in evidence:
        may.add("precise_direct_read_claim")
    if executed and "executed_command" in evidence and status == "done":
        may.add("bounded_executed_validation_claim")
    if evidence & {"parser", "compiler_api", "lsp"} and capability in ("partial_semantic", "semantic"):
        may.add("local_structure_reference")
    if status == "planned":
        may.add("validation_planning")
    if status in ("planned", "blocked") or status == "done" and not executed:
        may_not.add("passed_validation_claim")
    if status in ("planned", "needed"):
        verify.add("run_planned_validation")
    if status == "blocked":
        verify.add("resolve_blocked_environment")
    if validity != "valid" or freshness != "fresh" or status in ("blocked", "planned") or troubled:
        may_not |= set(PROOF)
        verify |= {"refresh_runtime_snapshot", "resolve_blocked_environment", "direct_read_relevant_source", "run_planned_validation"}
    return {"safe_to_use_for": sorted(may - may_not), "not_safe_to_use_for": sorted(may_not), "must_verify_by": sorted(verify)}


def command_allowed(command: Column) -> Column:
    """Whether a planned command may be offered: no shell joins, redirects, removal or publishing."""
    return ~command.rlike(r"[;&|<>`$]|(^|\s)(rm|sudo|curl|wget|ssh|scp|dd|mkfs|shutdown)(\s|$)|\b(publish|deploy|push|install)\b")
