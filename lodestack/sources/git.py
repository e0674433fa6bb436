"""What Git knows of a repository; the only driver-side processes."""

from __future__ import annotations

import os
import subprocess
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.operators import changes

INFO = "root string, branch string, commit_hash string, short_hash string, origin string, is_dirty boolean, author string, author_email string, commit_date string, subject string"


def _git(root: str, *arguments: str) -> str | None:
    done = subprocess.run(["git", "-C", root, *arguments], capture_output=True, check=False)
    return done.stdout.decode("utf-8", "replace") if done.returncode == 0 else None


def repository_root(start: str) -> str | None:
    """The nearest folder at or above ``start`` with a ``.git``."""
    at = Path(start).resolve()
    return next((str(p) for p in (at, *at.parents) if (p / ".git").exists()), None)


def tracked_files(spark: SparkSession, root: str) -> DataFrame:
    """``position, path`` of the tracked files that still exist."""
    listed = [p for p in (_git(root, "ls-files", "-z") or "").split("\0") if p and os.path.exists(os.path.join(root, p))]
    return spark.createDataFrame(list(enumerate(listed)), "position int, path string")


def repository_info(spark: SparkSession, root: str) -> DataFrame:
    """One row; what can't be found is null, a detached head has no branch."""
    def one(*arguments: str) -> str | None:
        return ((_git(root, *arguments) or "").strip()) or None

    fields = (one("log", "-1", "--format=%an%x1f%ae%x1f%cI%x1f%s") or "\x1f\x1f\x1f").split("\x1f")
    row = (root, one("symbolic-ref", "--short", "-q", "HEAD"), one("rev-parse", "HEAD"), one("rev-parse", "--short", "HEAD"), one("remote", "get-url", "origin"), bool(one("status", "--porcelain")), *[f or None for f in fields[:4]])
    return spark.createDataFrame([row], INFO)


def changed_files(spark: SparkSession, root: str, against: str | None = None) -> DataFrame:
    """Changes of the working tree, or since the merge base with a branch; the last line of a path counts."""
    lines = _git(root, "diff", "--name-status", f"{against}...HEAD") if against else _git(root, "status", "--porcelain", "--untracked-files=all")
    if lines is None:
        raise ValueError(f"no repository or no such branch: {root} {against or ''}")
    table = spark.createDataFrame(list(enumerate(lines.splitlines())), "pos int, line string")
    parsed = (changes.name_status if against else changes.porcelain)(F.col("line"))
    return changes.last_of_each(table.select("pos", parsed.alias("c")).where("c is not null").select("pos", "c.*"), "pos", ["path"])


def diff_text(root: str, against: str | None = None) -> str:
    """The unified diff: unstaged, then staged changes, or those since the merge base with a branch."""
    if against:
        out = _git(root, "diff", f"{against}...HEAD")
        if out is None:
            raise ValueError(f"no such branch: {against}")
        return out
    return "".join(x for x in (_git(root, "diff"), _git(root, "diff", "--cached")) if x)
