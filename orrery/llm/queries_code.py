"""Queries of problems 1, 2 and 7: functions with documentation, invalid files, files nobody here wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import handwritten, pairs, syntax
from orrery.operators.hierarchy import norm_path
from orrery.tables import current_files, table


def p1_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Every documented function of a valid file with its documentation."""
    return pairs.documented(current_files(spark, folder, "text"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Places of the functions whose documentation says something."""
    return p1_pairs(spark, folder).select("file_path", "start_line")


def _judged(spark: SparkSession, folder: str) -> DataFrame:
    files = current_files(spark, folder, "repo", "text")
    # Warnings stand on the row of the file itself; those of every visit count.
    walks = table(spark, folder, "walk_contexts").select(norm_path("symbol_id").alias("fp"), F.explode("warnings").alias("w"))
    hints = walks.filter(~F.col("fp").contains("::")).groupBy("fp").agg(F.max(F.col("w").rlike(syntax.WARN_HINT)).alias("hinted"))
    return syntax.judge_files(files.join(hints, F.col("file_path") == F.col("fp"), "left"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Files that are not valid in the language of their extension."""
    return _judged(spark, folder).filter(~F.col("valid")).select("file_path")


def p2_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Share of invalid files per repository and language."""
    return syntax.rates(_judged(spark, folder))


def _files_with_lists(spark: SparkSession, folder: str) -> DataFrame:
    options = table(spark, folder, "watcher_options").select("repo", "ignore_extra").dropDuplicates(["repo"])
    return current_files(spark, folder, "repo", "text").join(options, "repo", "left")


def p7_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """Score and verdict of every current file."""
    return handwritten.judge(_files_with_lists(spark, folder))[0]


def p7_report(spark: SparkSession, folder: str) -> DataFrame:
    """What validation on repositories held out found: files labelled, held out, share right, false alarms, missed."""
    _, report = handwritten.train(handwritten.read(_files_with_lists(spark, folder)))
    return spark.createDataFrame([tuple(report.values())], ", ".join(f"{k} {'double' if k == 'accuracy' else 'bigint'}" for k in report))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Files that nobody here wrote by hand."""
    return p7_verdicts(spark, folder).filter("foreign").select("file_path")


QUERIES = {"p7_found": p7_found, "p7_verdicts": p7_verdicts, "p7_report": p7_report, "p1_found": p1_found, "p1_pairs": p1_pairs, "p2_found": p2_found, "p2_rates": p2_rates}
ORACLES: dict[str, str] = {}
