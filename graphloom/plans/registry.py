"""How a plan and its check are written down together."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from graphloom.plans.exemplar import Tables, oracle


class Plans:
    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def plan(self, name: str, sql: str | None = None) -> Callable:
        """Registers a function of the tables; ``sql`` may name derived tables."""

        def register(f: Callable[[Tables], DataFrame]) -> Callable:
            self.queries[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
            if sql is not None:
                self.sql[name] = oracle(sql)
            return f

        return register
