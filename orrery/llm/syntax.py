"""Source files that are not valid in their language (problem 2).

The lexers of ``lexing`` match brackets on a stack and blame what they cannot read; markers of merge conflicts and diffs
among the tokens are blamed next. On the tokens of each language a reader follows that goes down a level at every opener:
``syntax_go``, ``syntax_js`` (TypeScript too), ``syntax_python`` and ``syntax_rust``. What the Python reader blames is checked by
the interpreter's own parser, which may only acquit.
"""

from __future__ import annotations

import ast
import gc
import sys
import warnings
from bisect import bisect_left
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm import syntax_go, syntax_js, syntax_python, syntax_rust
from orrery.sources import lexing
from orrery.sources.lexing import STRING, WORD, Source

#: Calls one within another that a reader may make, some six for every level of a text. A deeper text counts as valid unless
#: its lexer blames it.
DEEPEST = 100_000


@contextmanager
def quiet() -> Iterator[None]:
    """While many files are read: the parser's warnings about odd literals are of no concern, nor is searching the many
    short-lived lists of tokens for cycles; readers may go down as many levels as any file has."""
    was, depth = gc.isenabled(), sys.getrecursionlimit()
    gc.disable()
    sys.setrecursionlimit(max(depth, DEEPEST))
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore", SyntaxWarning)
            yield
    finally:
        sys.setrecursionlimit(depth)
        if was:
            gc.enable()


def fault_of(text: str, language: str, jsx: bool = False, source: Source | None = None) -> tuple[int, str] | None:
    """Offset and reason of the first thing found that is not valid, or None."""
    source = source or lexing.scan(text, language, jsx)
    if language == "python":
        return _python_fault(text, source)
    if source.fault:
        return source.fault
    if marker := _marker(source):
        return marker
    if language == "go":
        return syntax_go.fault_of(source)
    if language == "rust":
        return syntax_rust.fault_of(source)
    return syntax_js.fault_of(source, language == "typescript")


def _marker(s: Source) -> tuple[int, str] | None:
    """A line of a merge conflict or of a diff that stands among the tokens, not in a string or a comment."""
    text = s.text
    if "\n<<<<<<<" not in text and "\n>>>>>>>" not in text and "\n=======" not in text and "\n|||||||" not in text and "\n@@ " not in text and text[:3] not in ("<<<", ">>>", "===", "|||", "@@ "):
        return None
    for m in lexing.CONFLICT.finditer(text):
        i = bisect_left(s.starts, m.start())
        if i < len(s.starts) and s.starts[i] == m.start() and s.kinds[i] not in (STRING, WORD):
            return m.start(), "conflict marker"
    return None


def _python_fault(text: str, source: Source) -> tuple[int, str] | None:
    """What the pushdown pass blames; the interpreter's own parser, an exact check, is asked about those texts only."""
    found = syntax_python.fault_of(source)
    if found is None:
        return None
    try:
        ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return found
    return None


WARN_HINT = r"(?i)unexpected token|missing closer|partial parse|recovered|walk stopped"
FAULTS = "file_path string, repo string, language string, valid boolean, fault_line int, fault string, hinted boolean"


def judge_files(files: DataFrame) -> DataFrame:
    """One row per file: ``file_path, repo, language, valid, fault_line, fault, hinted``.

    ``files``: current versions ``file_path, repo, text`` and either ``warnings array<string>`` (may be null) or ``hinted``,
    whether one of them hints at a fault. The language is
    that of the extension; files of other extensions are taken as valid with a null language, as are null texts. The
    warnings are only reported beside the finding, as they are neither complete nor sure. Each file is read whole in one
    task; nothing is shuffled here.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            with quiet():
                for path, repo, text, hinted in zip(batch["file_path"], batch["repo"], batch["text"], batch["hinted"]):
                    language = lexing.language_of(path)
                    found, line = None, None
                    if language and text:
                        text = lexing.without_mark(text)
                        source = lexing.scan(text, language, path.endswith("x"))
                        found = fault_of(text, language, path.endswith("x"), source)
                        line = source.line(found[0]) if found else None
                    out.append((path, repo, language, found is None, line, found[1] if found else None, hinted))
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in FAULTS.split(", ")])
            frame["fault_line"] = frame["fault_line"].astype("Int32")
            yield frame

    hint = F.col("hinted") if "hinted" in files.columns else F.exists("warnings", lambda w: w.rlike(WARN_HINT))
    rows = files.select("file_path", "repo", "text", F.coalesce(hint, F.lit(False)).alias("hinted")).filter("file_path is not null")
    return rows.mapInPandas(run, FAULTS)


def rates(judged: DataFrame) -> DataFrame:
    """Per repository and language: files, invalid files and their share."""
    by = judged.groupBy("repo", "language").agg(F.count("*").alias("files"), F.count_if(~F.col("valid")).alias("invalid"), F.count_if(F.col("hinted") & ~F.col("valid")).alias("invalid_with_warning"))
    return by.withColumn("invalid_rate", F.round(F.col("invalid") / F.col("files"), 6))
