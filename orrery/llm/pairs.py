"""The operator of problem 1: functions paired with their documentation."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm import declarations, prose, syntax
from orrery.sources import lexing

PAIRS = "file_path string, start_line int, name string, language string, signature string, docstring string"


def pairs_of(path: str, text: str) -> list[tuple]:
    """The pairs of one file; none if the file is not valid in its language or has no known extension."""
    language = lexing.language_of(path)
    if language is None or not text:
        return []
    text = lexing.without_mark(text)
    # Documentation is a string in Python and a comment elsewhere: a text without any has no pair.
    if ("def" not in text or "'" not in text and '"' not in text) if language == "python" else ("//" not in text and "/*" not in text):
        return []
    source = lexing.scan(text, language, path.endswith("x"))
    if source.fault and language != "python":
        return []
    rows = [
        (path, d.start_line, d.name, language, d.signature, d.doc.strip())
        for d in declarations.declarations(source, documented=True)
        if prose.says_something(d.doc, d.name, d.parameters)
    ]
    # Whether the file is valid matters only if something was found in it.
    return rows if rows and syntax.fault_of(text, language, path.endswith("x"), source) is None else []


def documented(files: DataFrame) -> DataFrame:
    """``file_path, start_line, name, language, signature, docstring`` of every function whose documentation says something.

    ``files``: current versions ``file_path, text``. Null paths and texts, empty texts, unknown extensions and files that
    are not valid give no row. A text of any length is read whole in one task; nothing is shuffled here.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            with syntax.quiet():
                rows = [r for path, text in zip(batch["file_path"], batch["text"]) for r in pairs_of(path, text)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PAIRS.split(", ")])

    return files.select("file_path", "text").filter("file_path is not null and text is not null").mapInPandas(run, PAIRS)
