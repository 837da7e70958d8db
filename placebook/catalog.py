"""Registered queries of the gazetteer engine."""

from __future__ import annotations

from placebook.plans.queries import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
