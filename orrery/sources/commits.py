"""Commit logs of repositories as a data source, and the state of a working tree."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "repo string, hash string, subject string, author string, ts timestamp, files array<string>"


def _git(cwd: str, *arguments: str) -> bytes:
    return subprocess.run(["git", "-c", "safe.directory=*", "-C", cwd, *arguments], capture_output=True, check=True, timeout=120).stdout


def read_log(path: str, since: str | None = None, paths: list[str] | None = None, most: int | None = None) -> Iterator[tuple]:
    """Commits without merges, newest first, with the files they touch; all of them unless ``most`` is given.

    The log is read as null-ended pieces: the four fields of a commit, each after a null sign of its own, then its paths.
    A commit begins where a piece is empty, as no path is.
    """
    wanted = ["log", "-z", "--no-merges", "--name-only", "--format=tformat:%x00%H%x00%ct%x00%an%x00%s"]
    wanted += [f"--max-count={most}"] if most else []
    wanted += [f"--since={since}"] if since else []
    pieces = iter(_git(path, *wanted, "--", *(paths or [])).decode("utf-8", "replace").split("\0"))
    commit: list[str] = []
    files: list[str] = []

    def row() -> tuple:
        name, seconds, author, subject = commit
        return path, name, subject, author, datetime.fromtimestamp(int(seconds), timezone.utc), list(files)

    for piece in pieces:
        piece = piece.lstrip("\n")
        if piece and commit:
            files.append(piece)
            continue
        if not piece:
            fields = [next(pieces, "") for _ in range(4)]
            if not fields[0]:
                break
            if commit:
                yield row()
            commit, files = fields, []
    if commit:
        yield row()


class _Part(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.options = options

    def partitions(self):
        """One task per repository."""
        return [_Part(p) for p in self.options["path"].split(",") if p]

    def read(self, partition):
        paths = [p for p in self.options.get("paths", "").split(",") if p]
        yield from read_log(partition.value, self.options.get("since") or None, paths, int(self.options.get("most", "0")) or None)


class CommitLog(DataSource):
    """``spark.read.format("commitlog").option("path", "repo1,repo2")``; options ``since``, ``paths`` and ``most``."""

    @classmethod
    def name(cls):
        return "commitlog"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)


def commit_log(spark: SparkSession, repositories: list[str], **options: str) -> DataFrame:
    """The logs of several repositories, each read by its own task."""
    spark.dataSource.register(CommitLog)
    reader = spark.read.format("commitlog").option("path", ",".join(repositories))
    for key, value in options.items():
        reader = reader.option(key, value)
    return reader.load()


def tree_state(path: str) -> dict:
    """Short hash of the head and whether the working tree has changes; where that cannot be told, it counts as changed."""
    try:
        head = _git(path, "rev-parse", "--short", "HEAD").decode().strip()
        return {"commit": head, "dirty": bool(_git(path, "status", "--porcelain").strip())}
    except (subprocess.SubprocessError, OSError):
        return {"commit": None, "dirty": True}
