"""Registered queries: every operator run over whole driver tables, with the SQL that
checks it where SQL can express it."""

from flareframe.queries.registry import all_queries, all_sql

__all__ = ["all_queries", "all_sql"]
