"""All queries of the core, collected from their modules."""

from __future__ import annotations

from orrery.queries import cards, changes, conventions, graphs, hierarchy, parsing, retrieval

_MODULES = (hierarchy, retrieval, graphs, cards, changes, parsing, conventions)


def queries() -> dict:
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def oracles() -> dict:
    return {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
