"""All named queries of the library itself."""

from __future__ import annotations

from . import checks, files, logs, releases, rules, scores, streams, tables, texts  # noqa: F401  they register their queries
from .registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
