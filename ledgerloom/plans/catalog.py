"""Every query of the engine and the SQL that checks it."""

from __future__ import annotations

from . import answer_queries, facts_queries, linker_queries, planner_queries, text_queries

_MODULES = [facts_queries, text_queries, linker_queries, planner_queries, answer_queries]


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.ORACLE.items()}
