"""Queries of problem 10: languages of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import langid
from orrery.tables import table


def _segments(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text", "lang")
    # A fixed table of a few samples a language.
    reference = [r.asDict() for r in table(spark, folder, "lang_reference").collect()]
    return langid.segments(documents, langid.fit(documents, reference), langid.label_codes(reference))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents in several languages, and documents whose label is missing or wrong."""
    return langid.document_issues(_segments(spark, folder)).select("doc_id", "issue", "lang")


def p10_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Every run of sentences in one language with its confidence."""
    return _segments(spark, folder).withColumn("confidence", F.round("confidence", 4))


QUERIES = {"p10_found": p10_found, "p10_segments": p10_segments}
ORACLES: dict[str, str] = {}
