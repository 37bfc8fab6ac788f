"""Facts of a Git work tree as small DataFrames: head, cleanliness, links to other repositories, first and last touch of files.

They come from the git program on the driver, with a time limit and a bound on its output. Where it fails or takes too long,
nothing is claimed: the rows say so.
"""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SECONDS, MOST_BYTES = 5.0, 8 << 20


def git(repo: str, *args: str, seconds: float = SECONDS) -> str | None:
    """Output of a git command that only reads; null when it fails, takes too long or says too much."""
    try:
        run = subprocess.run(["git", "-C", repo, "--no-optional-locks", "-c", "core.quotepath=off", *args], capture_output=True, timeout=seconds, check=False)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return None if run.returncode or len(run.stdout) > MOST_BYTES else run.stdout.decode("utf-8", "replace")


def state(spark: SparkSession, repo: str) -> DataFrame:
    """One row: head (commit), cleanliness (clean, dirty or blocked)."""
    head, changed = git(repo, "rev-parse", "HEAD"), git(repo, "status", "--porcelain")
    clean = "blocked" if changed is None else "dirty" if changed.strip() else "clean"
    return spark.createDataFrame([(head.strip() if head else None, clean)], "head string, cleanliness string")


def links(spark: SparkSession, repo: str) -> DataFrame:
    """path, head_oid, index_oid: links to other repositories at HEAD and in the index; a side that has none is null."""
    found: dict[str, list[str | None]] = {}
    for k, (text, at) in enumerate(((git(repo, "ls-tree", "-r", "HEAD"), 2), (git(repo, "ls-files", "--stage"), 1))):
        for line in (text or "").splitlines():
            facts, _, path = line.partition("\t")
            parts = facts.split()
            if parts and parts[0] == "160000":
                found.setdefault(path, [None, None])[k] = parts[at]
    return spark.createDataFrame([(p, *v) for p, v in sorted(found.items())], "path string, head_oid string, index_oid string")


def touches(spark: SparkSession, repo: str, paths: list[str] | None = None) -> DataFrame:
    """path, first_at, first_commit, last_at, last_commit of files, from the log of HEAD (of some paths where given)."""
    text = git(repo, "log", "--format=%x01%H %ct", "--name-only", "--no-renames", "--", *(paths or ["."]))
    rows, commit, at = [], None, None
    for line in (text or "").splitlines():
        if line.startswith("\x01"):
            commit, seconds = line[1:].split()
            at = int(seconds)
        elif line:
            rows.append((line, at, commit, len(rows)))
    log = spark.createDataFrame(rows, "path string, at long, commit string, n long")  # the latest commit comes first
    out = log.groupBy("path").agg(F.max_by(F.struct("at", "commit"), "n").alias("a"), F.min_by(F.struct("at", "commit"), "n").alias("b"))
    return out.select("path", F.timestamp_seconds("a.at").alias("first_at"), F.col("a.commit").alias("first_commit"), F.timestamp_seconds("b.at").alias("last_at"), F.col("b.commit").alias("last_commit"))
