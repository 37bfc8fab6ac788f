"""Verification commands with their targets, planned from what a catalog holds and what is selected; nothing is run.

Families come in one order: Go, CMake, .NET, SAM, package scripts, Python, documents. A family applies when its project files are
there and a file of its languages is selected (any such file, where nothing is). The catalog and the selection are each aggregated once to
one row of facts; targets (nearest projects, templates, package scripts, tests) are joins on path prefixes and short tops.

Package scripts are planned only where no Go, CMake, .NET or SAM project is, since those have the say. Defined cases: an empty catalog
plans nothing; a selected path that the catalog does not hold is missing and blocks the plan, as more than MOST_SELECTED paths and paths with
shell characters do; where host commands are blocked, all commands but reviews are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.functions import paths as P
from lodestack.operators.relational import longest_prefix, ranked
from lodestack.plans.planning import nearest_tests, scripts_for

#: Selected paths beyond which a plan is too broad.
MOST_SELECTED = 50
#: Scripts of a package that may be planned, in order.
SCRIPTS = ["typecheck", "lint", "format:check", "test", "test:client", "test:api", "test:e2e"]
DOCS = ["markdown", "json", "yaml", "toml", "xml", "config"]
_PROJECT, _SOLUTION, _TEMPLATE = r"\.csproj$", r"\.sln$", r"(^|/)(template|sam)\.ya?ml$"
_UNSAFE = r"[;&|<>$`\"'\\\s*?!(){}\[\]]|^-|(^|/)\.\.(/|$)|^/"


def _facts(df: DataFrame, **tests: Column) -> DataFrame:
    """One row: how many rows, and for each test whether any row passes."""
    return df.agg(F.count(F.lit(1)).alias("n"), *(F.coalesce(F.bool_or(c), F.lit(False)).alias(k) for k, c in tests.items()))


def _kinds() -> dict[str, Column]:
    lang, low = P.language(F.col("path")), F.lower("path")
    return {
        "go": lang == "go", "native": lang.isin("c", "cpp"), "dotnet": (lang == "csharp") | low.rlike(_PROJECT), "sam": low.rlike(_TEMPLATE) | low.rlike("(^|/)(infra|sam)/|handler"), "script": lang.isin("typescript", "javascript", "json"),
        "python": (lang == "python") | (F.col("path") == "pyproject.toml"), "docs": lang.isin(*DOCS),
    }


def planned_commands(files: DataFrame, selected: DataFrame, packages: DataFrame | None = None, host_blocked: bool = False, most: int = 10) -> DataFrame:
    """rank, family, command, reason, status (planned or blocked). files, selected: path; packages: path, text of package manifests."""
    p, low = F.col("path"), F.lower("path")
    kinds = _kinds()
    has = _facts(files, **{f"h_{k}": c for k, c in kinds.items()}, gomod=p == "go.mod", gowork=p == "go.work", make=p.isin("Makefile", "makefile"), cmake=low.rlike("(^|/)cmakelists\\.txt$"), project=low.rlike(_PROJECT), solution=low.rlike(_SOLUTION), template=low.rlike(_TEMPLATE), pyproject=p == "pyproject.toml").withColumnRenamed("n", "n_files")
    pick = _facts(selected, **{f"s_{k}": c for k, c in kinds.items()})
    wants = lambda k: F.when(F.col("n") == 0, F.col(f"h_{k}")).otherwise(F.col(f"s_{k}"))
    shape = has.crossJoin(F.broadcast(pick)).select(  # one row each
        "n", "make", "gowork", (F.col("gomod") & wants("go")).alias("go"), (F.col("cmake") & wants("native")).alias("native"), ((F.col("project") | F.col("solution")) & wants("dotnet")).alias("dotnet"),
        (F.col("template") & wants("sam")).alias("sam"), wants("script").alias("script"), (F.col("pyproject") & wants("python")).alias("python"), wants("docs").alias("docs"), "solution",
    )
    one = lambda ord_, family, command, reason, use: F.struct(F.lit(ord_).alias("major"), F.lit(0).alias("minor"), F.lit(family).alias("family"), command.alias("command"), F.lit(reason).alias("reason"), use.alias("use"))
    fixed = [
        one(0, "go", F.when(F.col("make"), "make test").otherwise("go test ./..."), "a Go module at the root", F.col("go")),
        one(1, "cmake", F.lit("cmake --build build"), "a CMake project", F.col("native")),
        one(5, "python", F.lit("python3 -m pytest"), "a Python project at the root", F.col("python")),
        one(6, "docs", F.lit("review documents"), "documents or configuration", F.col("docs")),
    ]
    columns = ["major", "minor", "family", "command", "reason"]
    out = [shape.select(F.explode(F.array(*fixed)).alias("r")).where("r.use").select("r.major", "r.minor", "r.family", "r.command", "r.reason")]

    def targets(df: DataFrame, family: str, major: int, minor: int, command: Column, reason: str, use: str) -> None:
        """df: target, at most a few rows; planned where the shape says so."""
        rows = df.crossJoin(F.broadcast(shape.where(use).select(F.lit(1).alias("_one"))))  # one row or none
        out.append(rows.select(F.lit(major).alias("major"), F.lit(minor).alias("minor"), F.lit(family).alias("family"), command.alias("command"), F.lit(reason).alias("reason")))

    top = lambda df, n: df.select(F.col("path").alias("target")).distinct().orderBy("target").limit(n)
    with_target = lambda text: F.concat(F.lit(text + " "), F.col("target"))
    folder = F.when(P.dirname(p) == "", ".").otherwise(P.dirname(p))
    projects = files.where(low.rlike(_PROJECT))
    nearest = longest_prefix(selected.where(kinds["dotnet"]).select("path"), "path", projects.select(folder.alias("prefix"), "path").groupBy("prefix").agg(F.min("path").alias("k")), "prefix", "k").where("unit IS NOT NULL").select(F.col("unit").alias("path"))
    near = top(nearest, 1)
    targets(near, "dotnet", 2, 0, with_target("dotnet build"), "the project nearest to selected files", "dotnet")
    targets(top(files.where(low.rlike(_SOLUTION)), 1), "dotnet", 2, 1, with_target("dotnet build"), "the solution of the repository", "dotnet")
    targets(top(projects, 1).join(near.select(F.lit(1).alias("_n")), F.lit(True), "left_anti"), "dotnet", 2, 1, with_target("dotnet build"), "a project, without a solution", "dotnet AND NOT solution")
    targets(top(projects.where(P.stem(low).contains("test")), 2), "dotnet", 2, 2, with_target("dotnet test"), "a test project", "dotnet")
    templates = top(files.where(low.rlike(_TEMPLATE)), 2)
    for minor, text in enumerate(("cfn-lint", "sam validate --template-file")):
        targets(templates, "sam", 3, minor, with_target(text), "a template", "sam")
    targets(top(files.where(low.rlike(r"(^|/)tests?/.*infra.*\.py$|(^|/)infra/.*test.*\.py$")), 2), "sam", 3, 2, with_target("python3 -m pytest"), "a test of the infrastructure", "sam")
    if packages is not None:
        every = selected.select("path").unionByName(packages.select("path").join(shape.where("n = 0").select("n"), F.lit(True), "left_semi"))
        scripts = scripts_for(every, packages, SCRIPTS)
        nth = F.array_position(F.array(*map(F.lit, SCRIPTS)), F.col("script")).cast("int")
        run = F.when(F.col("root") == ".", F.concat(F.lit("npm run "), F.col("script"))).otherwise(F.concat(F.lit("npm --prefix "), F.col("root"), F.lit(" run "), F.col("script")))
        some = scripts.select(nth.alias("minor"), run.alias("command")).orderBy("minor", "command").limit(most)
        use = shape.where("script AND NOT go AND NOT native AND NOT dotnet AND NOT sam").select(F.lit(1).alias("_one"))
        out.append(some.crossJoin(F.broadcast(use)).select(F.lit(4).alias("major"), "minor", F.lit("package").alias("family"), "command", F.lit("a script of the nearest package").alias("reason")))
    tests = files.where((P.language(p) == "python") & low.rlike(r"(^|/)test_[^/]*$|_test\.py$"))
    asked = nearest_tests(selected.where((P.language(p) == "python") & ~low.rlike(r"(^|/)test_[^/]*$|_test\.py$")).select("path"), tests.select("path"))
    targets(asked.where("affinity = 1").select(F.col("test").alias("target")).distinct().orderBy("target").limit(5), "python", 5, -1, with_target("python3 -m pytest"), "the test nearest to selected files", "python")
    every = out[0]
    for more in out[1:]:
        every = every.unionByName(more.select(*columns))
    status = F.when(F.lit(host_blocked) & (F.col("family") != "docs"), "blocked").otherwise("planned")
    return ranked(every, [F.col("major"), F.col("minor"), F.col("command")], most).select("rank", "family", "command", "reason", status.alias("status"))


def plan_blockers(files: DataFrame, selected: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """path, blocker of what keeps a plan from being relied on: unsafe, excluded (by the path policy), missing, and too_broad (path null)."""
    own = selected.select("path").where("path IS NOT NULL").distinct()
    unsafe = F.col("path").rlike(_UNSAFE) | (F.col("path") == "")
    marked = own.join(files.select("path", F.lit(True).alias("_there")).distinct(), "path", "left")
    if excluded is not None:
        marked = marked.join(excluded.select("path", F.lit(True).alias("_out")).distinct(), "path", "left")
    out = F.col("_out").isNotNull() if excluded is not None else F.lit(False)
    why = F.when(unsafe, "unsafe").when(out, "excluded").when(F.col("_there").isNull(), "missing")
    rows = marked.select("path", why.alias("blocker")).where("blocker IS NOT NULL")
    return rows.unionByName(own.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MOST_SELECTED).select(F.lit(None).cast("string").alias("path"), F.lit("too_broad").alias("blocker")))
