"""All queries over the code-knowledge tables and the SQL that checks each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom.plans import analytics, code, composites, extended, lookups, scoring, traversals

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
for _part in (lookups, analytics, traversals, scoring, extended, composites, code):
    QUERIES |= _part.PLANS.queries
    SQL |= _part.PLANS.sql

FLAGSHIP = "a03_most_called"
