"""All queries of the engine proper, by name."""

from __future__ import annotations

from revlens.plans import filter_queries, match_queries, measure_queries, review_queries, rollup_queries, rule_queries, sheet_queries, source_queries
from revlens.plans.base import Query

FLAGSHIP = "j01_spatial_diff"
BOOKS = [filter_queries.book, match_queries.book, rollup_queries.book, review_queries.book, sheet_queries.book, measure_queries.book, rule_queries.book, source_queries.book]


def queries() -> dict[str, Query]:
    return {name: f for book in BOOKS for name, f in book.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for book in BOOKS for name, sql in book.sql.items()}
