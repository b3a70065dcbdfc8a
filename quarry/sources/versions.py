"""Version control as small tables: what a repository is, its tracked files, its commits, its worktrees and what differs there.

git is asked on the driver, for the few repositories of a workspace; what comes back are rows. Paths are decoded byte by
byte, so names that aren't UTF-8 survive. Where git or the repository is missing the tables are empty.
"""

from __future__ import annotations

import subprocess
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

REPO = "root string, name string, remote_url string, branch string, head_sha string, is_worktree boolean"
COMMIT = "root string, sha string, author string, at timestamp, subject string, body string"


def _git(root: str, *words: str) -> bytes | None:
    try:
        done = subprocess.run(["git", "-C", root, *words], capture_output=True, timeout=120, check=False)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return done.stdout if done.returncode == 0 else None


def _line(root: str, *words: str) -> str | None:
    out = _git(root, *words)
    return out.decode("utf-8", "surrogateescape").strip() or None if out is not None else None


def path_text(raw: bytes) -> str:
    """A path's bytes as text; bytes that aren't UTF-8 stand as \\xNN."""
    return raw.decode("utf-8", "backslashreplace")


def is_linked_worktree(root: str) -> bool:
    """Whether .git is a file that leads to another repository's folder of worktrees (a submodule's doesn't)."""
    mark = Path(root, ".git")
    return mark.is_file() and "/worktrees/" in mark.read_text(errors="replace").replace("\\", "/")


def repositories(spark: SparkSession, roots: list[str]) -> DataFrame:
    """Roots that are repositories, with remote, branch (null when detached) and head (null without a commit)."""
    rows = []
    for root in roots:
        top = _line(root, "rev-parse", "--show-toplevel")
        if top is not None:
            rows.append((root, Path(top).name, _line(root, "config", "--get", "remote.origin.url"), _line(root, "symbolic-ref", "--quiet", "--short", "HEAD"), _line(root, "rev-parse", "--verify", "--quiet", "HEAD"), is_linked_worktree(root)))
    return spark.createDataFrame(rows, REPO)


def _paths(raw: bytes | None) -> list[str]:
    return [path_text(x) for x in (raw or b"").split(b"\0") if x]


def tracked(spark: SparkSession, root: str) -> DataFrame:
    return spark.createDataFrame([(p,) for p in _paths(_git(root, "ls-files", "-z"))], "rel_path string")


def commits(spark: SparkSession, root: str, most: int = 2000) -> DataFrame:
    """The newest commits of a repository."""
    raw = _git(root, "log", f"-{most}", "-z", "--format=%H%x1f%an%x1f%ct%x1f%s%x1f%b") or b""
    rows = []
    for entry in raw.split(b"\0"):
        if entry.strip():
            sha, author, at, subject, body = (x.decode("utf-8", "replace") for x in entry.split(b"\x1f", 4))
            rows.append((root, sha.strip(), author, int(at), subject, body.strip()))
    own = spark.createDataFrame(rows, COMMIT.replace("at timestamp", "at long"))
    return own.withColumn("at", own["at"].cast("timestamp"))


@dataclass(frozen=True)
class Worktree:
    path: str
    branch: str | None
    head: str | None
    main: bool

    @property
    def name(self) -> str:
        return Path(self.path).name


def worktrees(root: str) -> list[Worktree]:
    """The main worktree first, then those linked to it; bare and prunable ones are no places to read from."""
    out = []
    for n, block in enumerate((_git(root, "worktree", "list", "--porcelain") or b"").split(b"\n\n")):
        facts = dict((k.decode(), path_text(v)) for k, _, v in (x.partition(b" ") for x in block.split(b"\n") if x))
        if "worktree" in facts and not {"bare", "prunable"} & set(facts):
            out.append(Worktree(facts["worktree"], facts.get("branch", "").removeprefix("refs/heads/") or None, facts.get("HEAD"), n == 0))
    return out


class WorktreeRegistry:
    """The worktrees of the repositories that a workspace's roots lie in, found by name or path."""

    def __init__(self, roots: list[str]):
        tops = sorted({t for r in roots if (t := _line(r, "rev-parse", "--show-toplevel"))})
        found = {w.path: w for t in tops for w in worktrees(t)}
        self.linked = [w for w in found.values() if not w.main]

    def resolve(self, given: str) -> Worktree:
        hits = [w for w in self.linked if given in (w.path, w.name, w.branch)]
        if len(hits) != 1:
            from ..plans.settings import UnknownName

            raise UnknownName("worktree", given, [w.path for w in hits or self.linked])
        return hits[0]


def scope(registry: WorktreeRegistry, chosen: str | None) -> Worktree | None:
    """The worktree that a caller means; None is the main one. Where there are linked ones a caller has to say, if only 'none'."""
    if chosen == "none" or chosen is None and not registry.linked:
        return None
    if chosen is None:
        from ..plans.settings import UnknownName

        raise UnknownName("worktree", "", ["none", *(w.name for w in registry.linked)])
    return registry.resolve(chosen)


def diverged(spark: SparkSession, worktree: Worktree) -> DataFrame:
    """rel_path of files that differ from the worktree's head, and of untracked ones that aren't ignored."""
    changed = _paths(_git(worktree.path, "diff", "--name-only", "-z", "HEAD")) + _paths(_git(worktree.path, "ls-files", "--others", "--exclude-standard", "-z"))
    return spark.createDataFrame([(p,) for p in sorted(set(changed))], "rel_path string")
