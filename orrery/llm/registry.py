"""All queries of this subpackage."""

from __future__ import annotations

from orrery.llm import queries_algorithms, queries_code, queries_language

_MODULES = (queries_algorithms, queries_code, queries_language)


def queries() -> dict:
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def oracles() -> dict:
    return {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
