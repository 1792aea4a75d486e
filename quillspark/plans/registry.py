"""All queries over the engine's operators, with their DuckDB counterparts."""

from __future__ import annotations

from quillspark.plans import documents, events, tables

MODULES = (documents, events, tables)


def queries() -> dict:
    return {name: query for m in MODULES for name, query in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
