"""Commits, changes and files of a local git repository as tables, read by the git command on the executors."""

from __future__ import annotations

import re
import subprocess
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_FIELDS = "%H%x1f%P%x1f%an%x1f%ae%x1f%at%x1f%ct%x1f%s"
SCHEMAS = {
    "commits": "commit_id string, idx long, parents array<string>, is_merge boolean, author_name string, author_email string, author_s long, committer_s long, message string",
    "changes": "commit_id string, idx long, action string, from_path string, to_path string, from_blob string, to_blob string",
    "files": "path string, blob string, size long",
}


def _git(path: str, *args: str) -> str:
    return subprocess.run(["git", "-C", path, *args], capture_output=True, check=True).stdout.decode("utf-8", "replace")


def parse_since(text: str, now: datetime | None = None) -> int:
    """Seconds since the epoch of a duration before now (36h, 90m), a date or an RFC 3339 time."""
    m = re.fullmatch(r"(\d+)([smhdw])", text.strip())
    if m:
        unit = {"s": 1, "m": 60, "h": 3600, "d": 86_400, "w": 604_800}[m[2]]
        return int(((now or datetime.now(UTC)) - timedelta(seconds=int(m[1]) * unit)).timestamp())
    when = datetime.fromisoformat(text.strip().replace("Z", "+00:00"))
    return int((when if when.tzinfo else when.replace(tzinfo=UTC)).timestamp())


def check_local(path: str) -> str:
    """path, if it is a local one: addresses of hosts are refused."""
    if re.match(r"^[a-z][a-z0-9+.-]*://", path) or re.match(r"^[^/]+@[^/]+:", path):
        raise ValueError(f"only local repositories can be read: {path}")
    return path


class Chunk(InputPartition):
    """A stretch of the commit walk."""

    def __init__(self, start: int, size: int) -> None:
        super().__init__((start, size))
        self.start, self.size = start, size


class GitReader(DataSourceReader):
    """Reads stretches of the walk, oldest commit first; every stretch is read alone, so a lost task is read again."""

    def __init__(self, options: dict) -> None:
        self.path = check_local(options["path"])
        self.table = options.get("table", "commits")
        self.first_parent = options.get("firstparent", "false") == "true"
        self.since = options.get("since")
        self.limit = int(options["limit"]) if options.get("limit") else None
        self.chunk = int(options.get("chunk", "2000"))

    def _walk(self) -> list[str]:
        args = ["rev-list", "--topo-order", "--reverse", *(["--first-parent"] if self.first_parent else []), "HEAD"]
        ids = _git(self.path, *args).split()
        return ids[: self.limit] if self.limit else ids

    def partitions(self) -> list[Chunk]:
        if self.table == "files":
            return [Chunk(0, 1)]
        n = len(self._walk())
        return [Chunk(s, min(self.chunk, n - s)) for s in range(0, n, self.chunk)] or [Chunk(0, 0)]

    def read(self, partition: Chunk) -> Iterator[tuple]:
        if self.table == "files":
            for line in _git(self.path, "ls-tree", "-r", "-l", "HEAD").splitlines():
                meta, _, name = line.partition("\t")
                _, kind, blob, size = meta.split()
                if kind == "blob":
                    yield name, blob, int(size)
            return
        ids = self._walk()[partition.start : partition.start + partition.size]
        floor = parse_since(self.since) if self.since else None
        for at, commit in enumerate(ids, partition.start):
            _, parents, name, mail, author_s, committer_s, message = _git(self.path, "show", "-s", f"--format={_FIELDS}", commit).rstrip("\n").split("\x1f")
            if floor is not None and int(author_s) < floor:
                continue
            if self.table == "commits":
                merge = len(parents.split()) > 1 and not self.first_parent
                yield commit, at, parents.split(), merge, name, mail, int(author_s), int(committer_s), message
                continue
            args = ["diff-tree", "-r", "-M", "--root", "--no-commit-id", "--raw", "-z", "--no-abbrev"]
            args += [parents.split()[0], commit] if parents else [commit]
            parts = _git(self.path, *args).split("\0")
            i = 0
            while i < len(parts) and parts[i].startswith(":"):
                _, _, old, new, status = parts[i].split()
                pair = status[0] in "RC"
                a, b = parts[i + 1], parts[i + 2] if pair else parts[i + 1]
                action = {"A": "insert", "D": "delete", "R": "rename"}.get(status[0], "modify")
                yield commit, at, action, None if action == "insert" else a, None if action == "delete" else b, old, new
                i += 3 if pair else 2


class GitSource(DataSource):
    """Format 'git_history' with options path, table (commits, changes, files), firstParent, since, limit, chunk."""

    @classmethod
    def name(cls) -> str:
        return "git_history"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("table", "commits")]

    def reader(self, schema: object) -> GitReader:
        return GitReader({k.lower(): v for k, v in dict(self.options).items()})


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(GitSource)
