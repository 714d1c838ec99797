"""The registered queries and their SQL."""

from __future__ import annotations

from .plans.oracles import SQL
from .plans.queries import QUERIES


def queries():
    return {f.__name__: f for f in QUERIES}


def oracle_sql():
    return dict(SQL)
