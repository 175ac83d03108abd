"""Collects queries and their SQL."""

from __future__ import annotations

from .bindings import Views

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of Views under a name, with the SQL that gives the same rows where there is one."""

    def register(f):
        QUERIES[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql:
            ORACLES[name] = sql
        return f

    return register
