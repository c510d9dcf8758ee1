"""What protects the serving side: the gate of ad-hoc SQL, limits of rows and bytes, and calls at once."""

from __future__ import annotations

import json
import re
import threading
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a statement, rows of a result, tables read by a plan, calls at once, and bytes of a response.
STATEMENT_BYTES, ROWS, SCANS, CALLS, RESPONSE_BYTES = 4096, 1000, 2, 4, 256 * 1024


class Refused(ValueError):
    """A statement or call that the guards do not let through."""


def strip_sql(statement: str) -> str:
    """The statement without comments and with its strings emptied, for looking at its shape."""
    return re.sub(r"--[^\n]*|/\*.*?\*/", " ", re.sub(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`", "''", statement), flags=re.S)


def check_statement(statement: str) -> str:
    """A single SELECT or WITH of limited size; anything else is refused."""
    if len(statement.encode()) > STATEMENT_BYTES:
        raise Refused(f"statement is longer than {STATEMENT_BYTES} bytes")
    shape = strip_sql(statement).strip().rstrip(";").strip()
    if not shape:
        raise Refused("empty statement")
    if ";" in shape:
        raise Refused("more than one statement")
    if not re.match(r"(?i)(select|with)\b", shape):
        raise Refused("only SELECT and WITH are allowed")
    if re.search(r"(?i)\b(insert|update|delete|drop|create|alter|merge|truncate|set|reset|use|cache|uncache|refresh|load|add|grant|revoke|call|explain|analyze)\b(?!\s*\()", shape) and not re.match(r"(?i)(select|with)\b(?!.*\b(insert|merge|update|delete|drop|create)\s+(into|table|view|from)\b)", shape, re.S):
        raise Refused("statement changes something")
    return statement.strip().rstrip(";")


def count_scans(df: DataFrame) -> int:
    """Tables that the optimized plan reads."""
    plan = df._jdf.queryExecution().optimizedPlan()
    return plan.collectLeaves().size()


def has_cartesian(df: DataFrame) -> bool:
    """Whether the physical plan multiplies tables without a key."""
    text = df._jdf.queryExecution().sparkPlan().toString()
    return "CartesianProduct" in text or "BroadcastNestedLoopJoin" in text


def run_sql(spark: SparkSession, statement: str, rows: int = ROWS, scans: int = SCANS) -> tuple[DataFrame, bool]:
    """The result of a guarded statement, at most ``rows`` of it, and whether more there were."""
    df = spark.sql(check_statement(statement))
    if count_scans(df) > scans:
        raise Refused(f"plan reads more than {scans} tables")
    if has_cartesian(df):
        raise Refused("plan multiplies tables without a key")
    # Run once: one row more than is shown tells whether there were more.
    found = df.limit(rows + 1).collect()
    return spark.createDataFrame(found[:rows], df.schema), len(found) > rows


def fit_bytes(rows: list[dict], limit: int = RESPONSE_BYTES) -> tuple[list[dict], bool]:
    """Rows from the front whose JSON stays within ``limit`` bytes, and whether any were dropped."""
    used, out = 2, []
    for row in rows:
        used += len(json.dumps(row, default=str).encode()) + 2
        if used > limit:
            return out, True
        out.append(row)
    return out, False


class InFlight:
    """At most so many calls at once; one more is refused, not queued."""

    def __init__(self, most: int = CALLS):
        self._free = threading.Semaphore(most)

    @contextmanager
    def slot(self):
        if not self._free.acquire(blocking=False):
            raise Refused("too many calls at once")
        try:
            yield
        finally:
            self._free.release()
