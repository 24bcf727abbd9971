"""Queries of this subpackage."""

from __future__ import annotations

from tendril.catalog import Query

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = oracle
        return f

    return add


def load() -> tuple[dict[str, Query], dict[str, str]]:
    import tendril.llm.queries  # noqa: F401

    return QUERIES, ORACLE
