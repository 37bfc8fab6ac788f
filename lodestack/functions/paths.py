"""Path functions as Column expressions: parts, language, policy, ignore rules, scopes, distance."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names and extensions that decide a path's class.
SKIPPED_DIRECTORIES = [".cache", ".claude", ".codex", ".devenv", ".direnv", ".git", ".gocache", ".gradle", ".home", ".local", ".m2", ".mypy_cache", ".nox", ".npm", ".nuxt", ".pixi", ".pnpm-store", ".pytest_cache", ".ruff_cache", ".sandbox", ".terraform", ".tox", ".venv", ".yarn", "__pycache__", "3rdparty", "artifacts", "bin", "build", "coverage", "dist", "node_modules", "obj", "publish", "target", "test-artifacts", "testresults", "third_party", "thirdparty", "vendor", "venv"]
VENDOR_DIRECTORIES = ["3rdparty", "node_modules", "third_party", "thirdparty", "vendor", "venv", ".venv"]
HIDDEN_DIRECTORIES = [".devcontainer", ".github"]
HIDDEN_FILES = [".aiignore", ".dockerignore", ".editorconfig", ".env.example", ".env.sample", ".env.template", ".eslintignore", ".eslintrc", ".eslintrc.cjs", ".eslintrc.js", ".eslintrc.json", ".gitattributes", ".gitignore", ".node-version", ".npmrc", ".nvmrc", ".prettierignore", ".prettierrc", ".prettierrc.cjs", ".prettierrc.js", ".prettierrc.json", ".python-version", ".ruby-version", ".tool-versions"]
SKIPPED_EXTENSIONS = [".br", ".coverage", ".coveragexml", ".dll", ".exe", ".gz", ".map", ".nupkg", ".pdb", ".snupkg", ".trx", ".wasm"]
LANGUAGES = {
    "python": [".py", ".pyi"],
    "typescript": [".ts", ".tsx"],
    "javascript": [".js", ".jsx", ".mjs", ".cjs"],
    "csharp": [".cs", ".razor", ".cshtml"],
    "ruby": [".rb"],
    "go": [".go"],
    "rust": [".rs"],
    "java": [".java"],
    "c": [".c"],
    "cpp": [".cc", ".cpp", ".cxx", ".h", ".hh", ".hpp", ".hxx"],
    "shell": [".sh"],
    "infrastructure": [".tf", ".tfvars"],
    "yaml": [".yaml", ".yml"],
    "markdown": [".md", ".markdown", ".mdx"],
    "json": [".json", ".jsonc"],
    "toml": [".toml"],
    "config": [".cfg", ".config", ".ini", ".env", ".sln", ".csproj", ".fsproj", ".vbproj"],
}


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dirname(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def extension(path: Column) -> Column:
    """With the dot, lower-cased; a leading dot starts no extension."""
    return F.lower(F.regexp_extract(basename(path), r"^.+(\.[^.]*)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def canonical(path: Column) -> Column:
    """Without . and .. segments and doubled slashes; null when it escapes its root."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    start = F.struct(F.lit(True).alias("ok"), F.array().cast("array<string>").alias("out"))
    end = F.aggregate(
        parts,
        start,
        lambda a, p: F.when((p == "") | (p == "."), a)
        .when(p == "..", F.when(F.size(a["out"]) > 0, F.struct(a["ok"].alias("ok"), F.slice(a["out"], F.lit(1), F.size(a["out"]) - 1).alias("out"))).otherwise(F.struct(F.lit(False).alias("ok"), a["out"].alias("out"))))
        .otherwise(F.struct(a["ok"].alias("ok"), F.array_append(a["out"], p).alias("out"))),
    )
    return F.when(end["ok"] & ~path.startswith("/"), F.array_join(end["out"], "/"))


def language(path: Column) -> Column:
    """Language of a file by name and extension, first rule first."""
    ext, name, bare = extension(path), F.lower(basename(path)), F.lower(stem(path))
    out = None
    for lang, own in LANGUAGES.items():
        test = ext.isin(own)
        if lang == "shell":
            test = test | name.isin("bashrc", "zshrc")
        elif lang == "infrastructure":
            test = test | (name == "dockerfile")
        elif lang == "config":
            test = test | bare.isin("pyproject", "requirements", "config") | bare.startswith(".") | (bare == "")
        out = F.when(test, lang) if out is None else out.when(test, lang)
    return out.otherwise("text")


def in_scope(path: Column, scope: str | None) -> Column:
    """Path is the scope or below it; wildcards mean themselves."""
    if not scope or scope == ".":
        return F.lit(True)
    return (path == scope) | path.startswith(scope + "/")


def under_any(path: Column, roots: Iterable[str]) -> Column:
    out = F.lit(False)
    for r in roots:
        r = r.replace("\\", "/").strip("/")
        if r:
            out = out | (path == r) | path.startswith(r + "/")
    return out


def is_secret(path: Column) -> Column:
    low = F.lower(path)
    return low.rlike(r"(^|/)\.env($|\.(?!(example|sample|template)$)[^/]+$)") | F.lower(basename(path)).rlike(r"^(\.envrc|credentials(\.[^/]+)?|secrets(\.[^/]+)?|.+\.(key|pem|p12|pfx))$") | low.rlike(r"(^|/)config/credentials(/|$)") & (low.contains("/config/credentials/") | low.startswith("config/credentials/") | (low == "config/credentials"))


def is_temporary(path: Column) -> Column:
    name = F.lower(basename(path))
    return name.endswith("~") | name.startswith(".#") | name.rlike(r"\.(swp|swo|tmp)$")


def policy(path: Column, generated: Iterable[str] = (), vendor: Iterable[str] = (), skipped: Iterable[str] = (), ignored: Column | None = None, admitted: Column | None = None, nested: Column | None = None, shown: Iterable[str] = HIDDEN_DIRECTORIES) -> Column:
    """struct(category, reason, read, write, redaction) of a file path; the first rule that fits decides.

    ignored: whether ignore rules exclude it; admitted: inside a readable submodule; nested: inside another repository;
    shown: directories that are read although their names begin with a dot.
    """
    low = F.transform(F.split(path, "/"), lambda s: F.lower(s))
    leaf = F.element_at(low, -1)
    above = F.slice(low, F.lit(1), F.size(low) - 1)
    hidden = F.exists(above, lambda s: s.startswith(".") & ~s.isin(list(shown))) | leaf.startswith(".") & ~leaf.isin(HIDDEN_FILES)
    rules = [
        ((path == "") | (path == "."), "source", "source"),
        (is_secret(path), "secret", "secret"),
        (F.lit(False) if admitted is None else admitted, "source", "source"),
        (F.lit(False) if nested is None else nested, "nested_repo", "nested_git_repository"),
        (is_temporary(path) | extension(path).isin(SKIPPED_EXTENSIONS), "generated", "generated_or_vendor"),
        (F.exists(low, lambda s: s.isin(SKIPPED_DIRECTORIES)) & F.exists(low, lambda s: s.isin(VENDOR_DIRECTORIES)), "vendor", "generated_or_vendor"),
        (F.exists(low, lambda s: s.isin(SKIPPED_DIRECTORIES) | s.startswith("cmake-build-") | s.startswith(".") & s.endswith("-tests")), "generated", "generated_or_vendor"),
        (under_any(path, generated), "generated", "generated_or_vendor"),
        (under_any(path, vendor), "vendor", "generated_or_vendor"),
        (under_any(path, skipped), "configured_skip", "configured_skip"),
        (hidden, "hidden", "hidden_path"),
        (F.lit(False) if ignored is None else ignored, "ignored", "gitignore"),
    ]
    category = reason = None
    for test, c, r in rules:
        category = F.when(test, c) if category is None else category.when(test, c)
        reason = F.when(test, r) if reason is None else reason.when(test, r)
    category, reason = category.otherwise("source"), reason.otherwise("source")
    source = category == "source"
    write = F.when(source & ~(F.lit(False) if admitted is None else admitted), "allow").otherwise("refuse")
    return F.struct(category.alias("category"), reason.alias("reason"), F.when(source, "allow").otherwise("skip").alias("read"), write.alias("write"), F.when(category == "secret", "secret").when(source, "none").otherwise("path_only").alias("redaction"))


def ignore_rules(content: str) -> list[dict]:
    """Rules of an ignore file in order: pos, regex on the path, negated. Only * is a wildcard."""
    out = []
    for line in re.split(r"\r?\n", content):
        line = line.strip()
        negated = line.startswith("!")
        raw = line[1:] if negated else line
        pattern = raw.strip("/")
        if not line or line.startswith("#") or not pattern:
            continue
        body = "[^/]*".join(re.escape(p) for p in pattern.split("*"))
        star = "*" in pattern
        below = f"{re.escape(pattern)}/.*"
        if raw.startswith("/") or "/" in pattern:
            regex = f"^(?:{body}|{below})$"
        else:
            regex = f"(?:^|/){body}(?:/|$)"
        if raw.endswith("/"):  # for a file, a directory rule needs the directory above it, spelled out
            regex = f"^{re.escape(pattern)}(?:/.*)?$" if not star else f"^(?:{below})$"
        out.append({"pos": len(out), "regex": regex, "negated": negated})
    return out


def ignored_by(path: Column, rules: list[dict]) -> Column:
    """Whether the last rule that matches excludes the path."""
    out = F.lit(False)
    for r in rules:
        out = F.when(path.rlike(r["regex"]), F.lit(not r["negated"])).otherwise(out)
    return out


def ancestors(path: Column) -> Column:
    """The path, every directory above it and ".", so that a prefix join becomes an equi-join."""
    parts = segments(path)
    return F.concat(F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")), F.array(F.lit(".")))


def distance(a: Column, b: Column) -> Column:
    """Segments of both directories less twice the leading ones they share."""
    x, y = segments(a), segments(b)
    shared = F.aggregate(F.zip_with(x, y, lambda p, q: p.eqNullSafe(q)), F.struct(F.lit(True).alias("on"), F.lit(0).alias("n")), lambda s, same: F.when(s["on"] & same, F.struct(F.lit(True).alias("on"), (s["n"] + 1).alias("n"))).otherwise(F.struct(F.lit(False).alias("on"), s["n"].alias("n"))))
    return F.size(x) + F.size(y) - shared["n"] * 2


def is_fixture_markdown(path: Column) -> Column:
    return path.rlike(r"^tests/fixtures/[^/]+/.+") & F.lower(path).rlike(r"\.(md|markdown|mdx)$")
