"""Every query of the note engine with the SQL it is checked against."""

from __future__ import annotations

from ..operators import agent, ask, blocks, graph, health, knowledge, maintained, markdown, memory, retrieval, search, segments, sync, vault
from ..sources import queries as sources
from ..streaming import notes as streams

MODULES = [markdown, blocks, vault, knowledge, health, retrieval, search, segments, sync, maintained, memory, ask, graph, agent, sources, streams]


def queries() -> dict:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
