"""A fluent query over named tables; every step stays a lazy DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.numeric import cosine, l2
from graphloom.functions.text import snake
from graphloom.operators.predicates import Condition, Group

METRICS = {"l2": l2, "cosine": lambda a, b: 1 - cosine(a, b)}


class Query:
    """``Query(tables).from_("function").where("complexity", ">", 10).order("complexity", desc=True).limit(5).frame()``

    Field names may be camel case; tables have snake case.
    """

    def __init__(self, tables: Callable[[str], DataFrame], frame: DataFrame | None = None, key: str = "id"):
        self.tables, self.df, self.key = tables, frame, key

    def _with(self, df: DataFrame) -> Query:
        return Query(self.tables, df, self.key)

    def from_(self, name: str, key: str = "id") -> Query:
        return Query(self.tables, self.tables(name), key)

    def where(self, field: str, op: str, value: object = None) -> Query:
        return self._with(self.df.filter(Condition(snake(field), op, value).column()))

    def matching(self, group: Group) -> Query:
        return self._with(self.df.filter(group.column()))

    def join(self, name: str, left: str, right: str, how: str = "inner", columns: list[str] | None = None) -> Query:
        """Columns of the other table that clash come with its name in front."""
        other = self.tables(name)
        chosen = columns or other.columns
        renamed = other.select(
            F.col(right).alias("_right"), *[F.col(c).alias(f"{name}_{c}" if c in self.df.columns else c) for c in chosen]
        )
        return self._with(self.df.join(renamed, self.df[left] == renamed["_right"], how).drop("_right"))

    def rule(self, step: Callable[[DataFrame], DataFrame]) -> Query:
        """Any other step."""
        return self._with(step(self.df))

    def nearest(self, vector: list[float], k: int, column: str = "embedding", metric: str = "l2", within: float | None = None) -> Query:
        to = F.array(*[F.lit(float(v)) for v in vector])
        found = self.df.withColumn("distance", METRICS[metric](F.col(column), to))
        if within is not None:
            found = found.filter(F.col("distance") < within)
        return self._with(found.orderBy("distance", self.key).limit(k))

    def select(self, *fields: str) -> Query:
        return self._with(self.df.select(*[snake(f) for f in fields]))

    def distinct(self) -> Query:
        return self._with(self.df.distinct())

    def order(self, field: str, desc: bool = False) -> Query:
        """Ties go by the key, so that pages are stable."""
        c: Column = F.col(snake(field))
        ties = [self.key] if self.key in self.df.columns else []
        return self._with(self.df.orderBy(c.desc() if desc else c, *ties))

    def page(self, offset: int, limit: int) -> Query:
        return self._with(self.df.offset(offset).limit(limit))

    def limit(self, n: int) -> Query:
        return self._with(self.df.limit(n))

    def frame(self) -> DataFrame:
        return self.df
