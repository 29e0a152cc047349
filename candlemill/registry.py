"""Queries of the market-bar library and the SQL that DuckDB can hold them against."""

from __future__ import annotations

from candlemill.plans import calls, decisions, features, filter, holdings, learn, market, replays, setups, stored, surface, trailing, variants  # noqa: F401 - they add their queries to market's

FLAGSHIP = "e13_trade_economics"


def queries():
    """All modules of plans register into one table."""
    return dict(market.QUERIES)


def oracle_sql():
    return dict(market.ORACLE)
