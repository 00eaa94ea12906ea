"""Named queries over the tables of a folder, and the SQL they are checked against."""

from __future__ import annotations

from importlib import import_module

MODULES = ("hierarchies", "corpus", "retrieval", "graphs", "assessment", "vocabulary", "terminology", "builds")


def all_queries() -> tuple[dict, dict]:
    queries, sql = {}, {}
    for name in MODULES:
        m = import_module(f"tamarack.queries.{name}")
        queries |= m.QUERIES
        sql |= m.SQL
    return queries, sql
