"""Patterns of paths: globs as regular expressions, and lists in gitignore syntax."""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple


@lru_cache(maxsize=10_000)
def glob_to_regex(pattern: str) -> str:
    """An anchored regular expression: ``**`` is any text (with a slash after it taken along), ``*`` and ``?`` stay in one segment.

    Valid both in Java (``rlike``) and in Python.
    """
    out, i = [], 0
    while i < len(pattern):
        if pattern.startswith("**", i):
            out.append(".*")
            i += 3 if pattern.startswith("/", i + 2) else 2
        elif pattern[i] == "*":
            out.append("[^/]*")
            i += 1
        elif pattern[i] == "?":
            out.append("[^/]")
            i += 1
        else:
            out.append(re.escape(pattern[i]))
            i += 1
    return "^" + "".join(out) + "$"


class IgnoreRule(NamedTuple):
    """One line of an ignore list: the pattern of paths, whether it takes back, and the remark above it."""

    regex: re.Pattern
    negated: bool
    remark: str


def ignore_rules(lines: list[str] | tuple[str, ...]) -> list[IgnoreRule]:
    """Rules of lines in gitignore syntax. A pattern with a slash before its end is relative to the root, others match at
    any depth; a pattern also covers everything below what it matches. Blank lines are skipped; null lines too."""
    out, remark = [], ""
    for line in lines:
        line = (line or "").rstrip()
        if not line:
            continue
        if line.startswith("#"):
            remark = line.lstrip("# ").lower()
            continue
        negated = line.startswith("!")
        body = line[1:] if negated else line
        body = body[1:] if body.startswith("\\") else body
        directory = body.endswith("/")
        body = body.rstrip("/")
        anchored = "/" in body
        body = body.lstrip("/")
        core = _ignore_regex(body)
        tail = "/.*" if directory else "(?:/.*)?"
        out.append(IgnoreRule(re.compile(("^" if anchored else "^(?:.*/)?") + core + tail + "$", re.S), negated, remark))
    return out


def _ignore_regex(body: str) -> str:
    out, i = [], 0
    while i < len(body):
        if body.startswith("**/", i) and (i == 0 or body[i - 1] == "/"):
            out.append("(?:.*/)?")
            i += 3
        elif body.startswith("**", i):
            out.append(".*")
            i += 2
        elif body[i] == "*":
            out.append("[^/]*")
            i += 1
        elif body[i] == "?":
            out.append("[^/]")
            i += 1
        elif body[i] == "[" and "]" in body[i + 1 :]:
            end = body.index("]", i + 1)
            inside = body[i + 1 : end]
            out.append("[" + ("^" + inside[1:] if inside[:1] in ("!", "^") else inside).replace("\\", "\\\\") + "]")
            i = end + 1
        else:
            out.append(re.escape(body[i]))
            i += 1
    return "".join(out)


def ignored_by(rules: list[IgnoreRule], path: str) -> IgnoreRule | None:
    """The last rule that matches the path, as gitignore decides; None if none does."""
    found = None
    for rule in rules:
        if rule.regex.match(path):
            found = rule
    return found


@lru_cache(maxsize=10_000)
def _rules_of(lines: tuple[str, ...]) -> list[IgnoreRule]:
    return ignore_rules(lines)


#: Directories that no walk enters, whatever the ignore list says.
HARD_EXCLUDES = ("node_modules", ".git")


def is_ignored(path: str, lines: list[str] | tuple[str, ...], hard: tuple[str, ...] = HARD_EXCLUDES) -> bool:
    """Whether a path is left out: a hard exclude wins, then the last matching line decides."""
    if any(part in hard for part in path.split("/")):
        return True
    rule = ignored_by(_rules_of(tuple(lines)), path)
    return rule is not None and not rule.negated
