"""All registered queries outside the optional subpackages."""

from __future__ import annotations

from . import analytics_queries, segment_queries, text_queries  # noqa: F401
from .base import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
