"""Registered queries over the engine's own operators, each with its SQL twin."""

from __future__ import annotations

from corpuscope.plans import queries_eval, queries_graph, queries_more, queries_rank, queries_text, queries_upkeep  # noqa: F401  (they register)
from corpuscope.plans.registry import QUERIES, SQL


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
