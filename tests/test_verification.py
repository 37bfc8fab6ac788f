"""Planned commands by family, targets, blockers."""

import pytest

from lodestack.plans import verification as V

CATALOG = ["go.mod", "cmd/main.go", "Makefile", "src/CMakeLists.txt", "src/a.cpp", "App.sln", "app/App.csproj", "app/x/View.cs", "app/tests/App.Tests.csproj", "template.yaml", "infra/test_infra.py", "pyproject.toml", "lib/tool.py", "tests/test_tool.py", "tests/test_other.py", "README.md", "web/a.ts"]
PACKAGES = [("package.json", '{"scripts": {"test": "t", "other": "o"}}'), ("web/package.json", '{"scripts": {"lint": "l", "test": "t", "typecheck": "c"}}')]


def plan(spark, catalog, selected, packages=None, **options):
    one = lambda xs: spark.createDataFrame([(x,) for x in xs], "path string")
    pk = spark.createDataFrame(packages, "path string, text string") if packages else None
    return [(r["family"], r["command"], r["status"]) for r in V.planned_commands(one(catalog), one(selected), pk, **options).orderBy("rank").collect()]


def commands(*args, **options):
    return [c for _, c, _ in plan(*args, **options)]


def test_families_by_what_is_selected(spark):
    assert commands(spark, CATALOG, ["cmd/main.go"]) == ["make test"]
    assert commands(spark, [c for c in CATALOG if c != "Makefile"], ["cmd/main.go"]) == ["go test ./..."]
    assert commands(spark, CATALOG, ["src/a.cpp", "app/x/View.cs"]) == ["cmake --build build", "dotnet build app/App.csproj", "dotnet build App.sln", "dotnet test app/tests/App.Tests.csproj"]
    assert commands(spark, ["b/B.csproj", "a/A.csproj", "View.cs"], ["View.cs"]) == ["dotnet build a/A.csproj"]
    assert commands(spark, CATALOG, ["template.yaml"]) == ["cfn-lint template.yaml", "sam validate --template-file template.yaml", "python3 -m pytest infra/test_infra.py", "review documents"]
    assert commands(spark, CATALOG, ["lib/tool.py"]) == ["python3 -m pytest tests/test_tool.py", "python3 -m pytest"]


def test_package_scripts(spark):
    assert commands(spark, ["web/a.ts", "b.js"], ["web/a.ts"], PACKAGES) == ["npm --prefix web run typecheck", "npm --prefix web run lint", "npm --prefix web run test"]
    assert commands(spark, ["web/a.ts", "b.js"], [], PACKAGES) == ["npm --prefix web run typecheck", "npm --prefix web run lint", "npm --prefix web run test", "npm run test"]
    assert commands(spark, CATALOG, ["web/a.ts", "cmd/main.go"], PACKAGES) == ["make test"]


def test_all_limits_and_blocks(spark):
    every = plan(spark, CATALOG, [], most=50)
    assert [f for f, _, _ in every] == ["go", "cmake", "dotnet", "dotnet", "sam", "sam", "sam", "python", "docs"] and {s for _, _, s in every} == {"planned"}
    assert len(plan(spark, CATALOG, [], most=3)) == 3 and plan(spark, [], []) == []
    assert {(f, s) for f, _, s in plan(spark, CATALOG, ["README.md", "cmd/main.go"], host_blocked=True)} == {("go", "blocked"), ("docs", "planned")}


@pytest.mark.parametrize("n", [3, 60])
def test_blockers(spark, n):
    one = lambda xs: spark.createDataFrame([(x,) for x in xs], "path string")
    selected = ["a;rm", "../up", "-x", "lost.py", "kept/out.py", None, *(f"f{k}.py" for k in range(n))]
    got = {(r["path"], r["blocker"]) for r in V.plan_blockers(one([f"f{k}.py" for k in range(n)] + ["kept/out.py"]), one(selected), one(["kept/out.py"])).collect()}
    assert got == {("a;rm", "unsafe"), ("../up", "unsafe"), ("-x", "unsafe"), ("lost.py", "missing"), ("kept/out.py", "excluded")} | ({(None, "too_broad")} if n == 60 else set())
