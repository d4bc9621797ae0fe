"""All registered queries and their SQL."""

from __future__ import annotations

from saltmarsh.catalog import (
    activity,
    cleaning,
    documents,
    forecasts,
    news,
    questions,
    quality,
    retrieval,
    sales,
    sources,
    texts,
    timeseries,
)
from saltmarsh.catalog.base import Query

_BOOKS = (
    sources, cleaning, quality, sales, timeseries, forecasts,
    texts, questions, documents, retrieval, news, activity,
)


def all_queries() -> dict[str, Query]:
    return {name: fn for module in _BOOKS for name, fn in module.BOOK.queries.items()}


def all_sql() -> dict[str, str]:
    return {name: sql for module in _BOOKS for name, sql in module.BOOK.sql.items()}
