"""All registered queries of the library with their SQL for comparison."""

from __future__ import annotations

from vigil.plans import cleaning, dashboard, insights, learning, risk

_PARTS = [dashboard, cleaning, risk, insights, learning]


def queries() -> dict:
    return {name: query for part in _PARTS for name, query in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
