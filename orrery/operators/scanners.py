"""Scanners of conventions: each groups evidence, takes the best and asks for at least two places."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions.text import hyphenated
from orrery.lineage import Cuts

# Class names that error families begin with, in order of precedence.
ERROR_ROOTS = ("Error", "TypeError", "RangeError", "SyntaxError", "ReferenceError", "Exception", "BaseException", "RuntimeError", "ValueError", "error")
# Paths of tests.
TEST_PATHS = r"\.test\.[a-z]+$|\.spec\.[a-z]+$|(^|/)test_[^/]+\.py$|[^/]+_test\.go$|(^|/)tests?/.+\.(ts|tsx|js|jsx|mjs|py|rs|go)$"
#: Least places of evidence.
LEAST = 2
#: Levels of error families that are written as one table.
MERGED = 8


def needle_match(module: Column, needle: Column) -> Column:
    """Whether an import names the needle or something below it."""
    return (module == needle) | module.startswith(F.concat(needle, F.lit("/"))) | module.startswith(F.concat(needle, F.lit("."))) | module.startswith(F.concat(needle, F.lit("::")))


def first_match(imports: DataFrame, libraries: DataFrame) -> DataFrame:
    """``file, library``: of every import ``(file, module)`` the first library ``(position, library, needle)`` it matches.

    The libraries are a list of the program's own, tens of rows, so they are broadcast.
    """
    hits = imports.join(F.broadcast(libraries), needle_match(F.col("module"), F.col("needle")))
    best = hits.groupBy("file", "module").agg(F.min_by("library", "position").alias("library"))
    return best.select("file", "library").distinct()


def best_library(matches: DataFrame, libraries: DataFrame, per: list[str] | None = None) -> DataFrame:
    """The library most files use, the earlier one on ties, if at least two do: ``library, files``."""
    counts = matches.groupBy(*(per or []), "library").agg(F.countDistinct("file").alias("files")).filter(F.col("files") >= LEAST)
    order = libraries.groupBy("library").agg(F.min("position").alias("position"))
    counts = counts.join(F.broadcast(order), "library")
    key = F.struct((-F.col("files")).alias("k"), "position")
    return counts.groupBy(*(per or [])).agg(F.min_by("library", key).alias("library"), F.max("files").alias("files")).filter("library is not null")


def all_libraries(matches: DataFrame) -> DataFrame:
    """All libraries at least two files use, with their number: ``library, files``."""
    return matches.groupBy("library").agg(F.countDistinct("file").alias("files")).filter(F.col("files") >= LEAST)


def error_families(inheritance: DataFrame, roots: tuple[str, ...] = ERROR_ROOTS) -> DataFrame:
    """``root, class_id, depth``: transitive descendants of every root by the last part of the base's name.

    Children are found level by level until a level is empty; a class counts once per root with its least depth, which
    also ends cycles. The levels found are written together every ``MERGED`` levels, so plans stay small at any depth.
    """
    spark, cuts = inheritance.sparkSession, Cuts(inheritance.sparkSession, "errors")
    last = F.element_at(F.split(F.regexp_replace("base_name", r"[<\[(].*$", ""), r"\.|::"), -1)
    rows = cuts.cut(inheritance.filter("class_id is not null and base_name is not null").select("class_id", last.alias("base"), F.element_at(F.split("class_id", "::"), -1).alias("name")).distinct())
    level = spark.createDataFrame([(r, r) for r in roots], "root string, at string")
    found: DataFrame | None = None
    for depth in count(1):
        fresh = rows.join(level, F.col("base") == F.col("at")).select("root", "class_id", "name").distinct()
        if found is not None:
            fresh = fresh.join(found.select("root", "class_id"), ["root", "class_id"], "left_anti")
        fresh = cuts.cut(fresh)
        if fresh.isEmpty():
            break
        rows_here = fresh.select("root", "class_id", F.lit(depth).alias("depth"))
        found = rows_here if found is None else found.unionByName(rows_here)
        if depth % MERGED == 0:
            found = cuts.cut(found)
        level = fresh.select("root", F.col("name").alias("at")).distinct()
    return found if found is not None else spark.createDataFrame([], "root string, class_id string, depth int")


def largest_family(families: DataFrame, roots: tuple[str, ...] = ERROR_ROOTS) -> DataFrame:
    """The root with most descendants, the earlier one on ties, if there are at least two: ``root, members``."""
    order = F.array_position(F.array(*[F.lit(r) for r in roots]), F.col("root"))
    counts = families.groupBy("root").agg(F.countDistinct("class_id").alias("members")).filter(F.col("members") >= LEAST).withColumn("o", order)
    return counts.agg(F.min_by("root", F.struct((-F.col("members")).alias("k"), "o")).alias("root"), F.max("members").alias("members")).filter("root is not null")


def test_files(files: DataFrame, path: str = "file_path") -> DataFrame:
    """Files whose path is that of a test."""
    return files.filter(F.col(path).rlike(TEST_PATHS))


def seed_id(kind: str, parts: Column) -> Column:
    """A stable id of a scanner's finding from its sorted parts."""
    return hyphenated(F.sha2(F.concat(F.lit(f"seed:{kind}:"), F.array_join(F.array_sort(parts), "|")), 256))
