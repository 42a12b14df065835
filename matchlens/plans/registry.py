"""Registered queries: name -> (Spark callable, SQL twin or None, survey ids)."""
from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple


class Query(NamedTuple):
    run: Callable
    sql: str | None
    covers: str


QUERIES: dict[str, Query] = {}


def query(name: str, covers: str, sql: str | None = None):
    def keep(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Query(fn, sql, covers)
        return fn
    return keep
