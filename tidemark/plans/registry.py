"""Queries over the given tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from .fixtures import with_views

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(name: str, views: str = "", sql: str | None = None):
    """Register a function of (spark, sf_dir); ``sql`` is DuckDB SQL after the named fixture views, none where SQL has no form."""

    def add(f: Callable) -> Callable:
        assert name not in QUERIES, name
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = with_views(views, sql) if views else sql
        return f

    return add


def _load() -> None:
    from . import book_queries, feature_queries, journal_queries, ledger_queries, machine_queries, pair_machine_queries, report_queries, run_queries, signal_queries, stat_queries, stream_queries, table_queries  # noqa: F401


def queries() -> dict[str, Callable]:
    _load()
    return QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return SQL


def flagship(spark, sf_dir: str) -> DataFrame:
    from .book_queries import basket_book_equity

    return basket_book_equity(spark, sf_dir, "p_type")
