"""Condition trees to column expressions."""

from __future__ import annotations

import functools
import operator
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

OPERATORS = {
    "=": lambda c, v: c == v,
    "!=": lambda c, v: c != v,
    ">": lambda c, v: c > v,
    "<": lambda c, v: c < v,
    ">=": lambda c, v: c >= v,
    "<=": lambda c, v: c <= v,
    "contains": lambda c, v: c.contains(v),
    "starts_with": lambda c, v: c.startswith(v),
    "ends_with": lambda c, v: c.endswith(v),
    "in": lambda c, v: c.isin(list(v)),
    "nin": lambda c, v: ~c.isin(list(v)),
    "like": lambda c, v: c.like(v),
    "has": lambda c, v: F.array_contains(c, v),
    "null": lambda c, v: c.isNull(),
    "not_null": lambda c, v: c.isNotNull(),
    "between": lambda c, v: c.between(v[0], v[1]),
    "matches": lambda c, v: F.regexp_like(c, F.lit(v)),
    "icontains": lambda c, v: F.lower(c).contains(v.lower()),
}


@dataclass
class Condition:
    field: str
    op: str
    value: object = None

    def column(self) -> Column:
        if self.op not in OPERATORS:
            raise ValueError(f"unknown operator {self.op!r}; known: {', '.join(OPERATORS)}")
        return OPERATORS[self.op](F.col(self.field), self.value)


@dataclass
class Group:
    """All (``and``) or any (``or``) of its parts; groups nest.  An empty one holds."""

    parts: list = field(default_factory=list)
    any: bool = False

    def column(self) -> Column:
        columns = [p.column() for p in self.parts]
        return functools.reduce(operator.or_ if self.any else operator.and_, columns) if columns else F.lit(True)


def all_of(*parts) -> Group:
    return Group(list(parts))


def any_of(*parts) -> Group:
    return Group(list(parts), any=True)


def where(field_: str, op: str, value: object = None) -> Condition:
    return Condition(field_, op, value)


def any_contains(columns: list[str], terms: list[str]) -> Column:
    """Case-insensitive: some column holds some term."""
    found = F.lit(False)
    for c in columns:
        for t in terms:
            found = found | F.lower(F.col(c)).contains(t.lower())
    return found


def overlaps_path(paths: Column, wanted: str) -> Column:
    """Some path contains the wanted one or is part of it."""
    return F.exists(paths, lambda p: p.contains(wanted) | F.lit(wanted).contains(p))


def at_least(level: Column, floor: str, order: tuple[str, ...] = ("low", "medium", "high")) -> Column:
    """Levels compared by their place in the order."""
    ranks = F.create_map(*[x for i, n in enumerate(order) for x in (F.lit(n), F.lit(i))])
    return ranks[level] >= order.index(floor)


#: Names that are trivial, and parts of names that never are.
ACCESSORS = ["toString", "valueOf", "toJSON", "clone", "copy", "equals", "hashCode", "compareTo"]
SENSITIVE = (
    "auth", "security", "validate", "verify", "credential", "password", "secret", "token",
    "permission", "role", "check", "guard", "encrypt", "decrypt",
)


def trivial_function(name: Column, lines: Column) -> Column:
    """Why a function needs no description, or null.  Unknown line counts pass for short ones."""
    short = lambda n: lines.isNull() | (lines == 0) | (lines <= n)
    return (
        F.when(F.regexp_like(F.lower(name), F.lit("|".join(SENSITIVE))), F.lit(None))
        .when(F.regexp_like(name, F.lit("^(get|is|has)[A-Z]")) & short(3), "simple_getter")
        .when(F.regexp_like(name, F.lit("^set[A-Z]")) & short(3), "simple_setter")
        .when(name.isin(ACCESSORS), "standard_accessor")
        .when((name == "constructor") & short(5), "simple_constructor")
        .when((lines > 0) & (lines <= 1), "very_short_function")
        .when(F.regexp_like(name, F.lit("^(noop$|identity$|_)")), "trivial_utility")
    )
