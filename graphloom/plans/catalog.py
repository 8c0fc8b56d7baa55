"""The registered queries and their SQL twins, by name."""

from __future__ import annotations

from graphloom.plans import aggregates, audits, graphs, patterns, streams  # noqa: F401  (importing registers)
from graphloom.plans.base import QUERIES, SQL


def flagship(spark, sf_dir):
    """Customers, urgent orders and revenue by region, over the triples."""
    return QUERIES["bgp_chain"](spark, sf_dir)


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
