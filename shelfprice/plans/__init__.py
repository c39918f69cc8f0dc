"""The registered queries, each next to the ANSI SQL that must give the same rows."""

from shelfprice.plans.registry import QUERIES, queries, oracle_sql

__all__ = ["QUERIES", "oracle_sql", "queries"]
