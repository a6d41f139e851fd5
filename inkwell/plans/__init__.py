"""Registered queries of the stylometry operators, and their DuckDB SQL."""

from importlib import import_module

MODULES = ("measure", "corpus", "preparation", "reference", "verdict")


def gathered() -> tuple[dict, dict]:
    """All queries, and SQL for those that have it."""
    queries, sql = {}, {}
    for name in MODULES:
        module = import_module(f"inkwell.plans.{name}")
        queries |= module.QUERIES
        sql |= module.SQL
    return queries, sql
