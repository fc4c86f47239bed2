"""Every query by name, and the SQL that an independent engine can check it with."""

from __future__ import annotations

from pairloom.plans import ranking, relational, review, texts  # noqa: F401  they register their queries
from pairloom.plans.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
