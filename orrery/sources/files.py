"""Source trees, text and snippets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions.text import language_of

#: Files above this size are left out; directories no walk enters; lines around a snippet and its cap.
MOST_BYTES, SKIPPED, CONTEXT, CAP = 5 * 1024 * 1024, ("node_modules", ".git"), 5, 40
GLOB = "*.{ts,tsx,mts,cts,js,jsx,mjs,cjs,py,pyi,go,rs}"


def source_tree(spark: SparkSession, root: str, most_bytes: int = MOST_BYTES, skipped: tuple[str, ...] = SKIPPED) -> DataFrame:
    """``path, language, text, n_bytes`` of all source files below ``root``, paths relative to it.

    The size limit is pushed to the listing; skipped directories are left out at any depth. Text is decoded as UTF-8 with
    replacement signs and without byte order mark.
    """
    prefix = root.rstrip("/") + "/"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", GLOB).load(root).filter(F.col("length") <= most_bytes)
    path = F.regexp_replace("path", f"^(?:file:)?/*{prefix.lstrip('/')}", "")
    text = F.regexp_replace(F.decode("content", "UTF-8"), "^﻿", "")
    out = raw.select(path.alias("path"), text.alias("text"), F.col("length").alias("n_bytes"))
    for name in skipped:
        out = out.filter(~F.array_contains(F.split("path", "/"), name))
    return out.select("path", language_of("path").alias("language"), "text", "n_bytes").filter("language is not null")


def snippets(symbols: DataFrame, files: DataFrame, context: int = CONTEXT, cap: int = CAP) -> DataFrame:
    """``id, snippet``: the symbol's lines with ``context`` more on both sides, cut evenly at both ends to ``cap`` lines.

    ``symbols``: ``id, path, range_start_line, range_end_line, signature, docstring``; ``files``: ``path, text``. Without a
    file the signature, else the docstring, else null. A file is split once, before its symbols meet it; lines are cut
    JVM-side.
    """
    split = files.select("path", F.split("text", "\r?\n").alias("ls"))
    joined = symbols.join(split, "path", "left")
    low = F.greatest(F.least("range_start_line", "range_end_line") - context, F.lit(1))
    high = F.least(F.greatest("range_start_line", "range_end_line") + context, F.size("ls"))
    joined = joined.withColumns({"lo": low, "hi": high})
    over = F.greatest(F.col("hi") - F.col("lo") + 1 - cap, F.lit(0))
    start = F.col("lo") + F.floor(over / 2).cast("int")
    length = F.least(F.col("hi") - F.col("lo") + 1, F.lit(cap))
    cut = F.when(F.col("ls").isNotNull() & (length > 0), F.array_join(F.slice("ls", start, length), "\n"))
    return joined.select("id", F.coalesce(cut, "signature", "docstring").alias("snippet"))
