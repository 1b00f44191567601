"""Name -> query and name -> SQL for the forecast-evaluation operators."""

from __future__ import annotations

from barlane.plans import oracle
from barlane.plans import queries as _queries


def queries() -> dict:
    return dict(_queries.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(oracle.SQL)
