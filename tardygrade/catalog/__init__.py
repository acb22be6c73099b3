"""Registered queries over the test tables, and their SQL counterparts."""

from .oracles import oracle_sql
from .queries import entry, queries

__all__ = ["entry", "oracle_sql", "queries"]
