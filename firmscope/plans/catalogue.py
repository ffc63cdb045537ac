"""All registered queries of the company-market engine, by name."""

from __future__ import annotations

from ..streaming import market_stream
from . import buying, market, names, payloads, ranking


MODULES = [ranking, names, market, payloads, buying, market_stream]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.ORACLE.items()}
