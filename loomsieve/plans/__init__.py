"""Registered queries and their oracle SQL, one module per family."""

from __future__ import annotations

from collections.abc import Callable

from loomsieve.plans import connectors, evaluation, events, pool, records, repairs, replays, screening, sources, texts

_FAMILIES = (screening, records, evaluation, texts, events, sources, pool, repairs, replays, connectors)


def queries() -> dict[str, Callable]:
    return {name: fn for family in _FAMILIES for name, fn in family.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for family in _FAMILIES for name, sql in family.ORACLE.items()}
