"""Named queries over the sample tables, with SQL twins."""

from __future__ import annotations


def all_queries() -> dict:
    _load()
    from .registry import QUERIES

    return dict(QUERIES)


def all_sql() -> dict[str, str]:
    _load()
    from .registry import SQL

    return dict(SQL)


def _load() -> None:
    from . import intake_queries, log_queries, page_queries, record_queries, shape_queries, workflow_queries, write_queries  # noqa: F401
