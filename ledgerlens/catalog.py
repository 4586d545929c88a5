"""All queries of the library and the SQL that checks them."""

from __future__ import annotations

from . import registry
from .plans import answers, classify, queues, recall, relational, rules, scalar, streams  # noqa: F401  (register their queries)

flagship = recall.flagship


def queries() -> dict:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
