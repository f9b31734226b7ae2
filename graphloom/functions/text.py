"""String expressions: identifiers, paths, messages, keyword rules."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def snake(name: str) -> str:
    return re.sub(r"(?<!^)([A-Z])", r"_\1", name).lower()


def camel(name: str) -> str:
    return re.sub(r"_([a-z])", lambda m: m[1].upper(), name)


def snake_case(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, "(?<!^)([A-Z])", "_$1"))


def camel_case(name: Column) -> Column:
    parts = F.split(name, "_(?=[a-z])")
    raised = F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.upper(p.substr(1, 1)), F.regexp_replace(p, "(?s)^.", ""))))
    return F.array_join(raised, "")


def entity_id(*parts: Column) -> Column:
    """The first 16 hex digits of the SHA-256 of the parts that aren't empty, joined by colons."""
    return F.substring(F.sha2(F.concat_ws(":", *[F.nullif(p.cast("string"), F.lit("")) for p in parts]), 256), 1, 16)


def qualified_name(module: Column, name: Column) -> Column:
    return F.concat_ws(".", F.nullif(module, F.lit("")), name)


def package_name(spec: Column) -> Column:
    """Of an import specifier: built-ins lose their prefix, scoped packages keep two segments."""
    parts = F.split(spec, "/")
    return (
        F.when(spec.startswith("node:"), F.substring(spec, 6, 1 << 20))
        .when(spec.startswith("@"), F.array_join(F.slice(parts, 1, 2), "/"))
        .otherwise(parts[0])
    )


def module_path(path: Column) -> Column:
    """Up to three segments from src, lib or app on, without the file; else the first two segments."""
    parts = F.split(path, "/")
    at = F.array_min(
        F.filter(F.array(*[F.array_position(parts, x) for x in ("src", "lib", "app")]), lambda p: p > 0)
    )
    inside = F.array_join(F.slice(parts, at.cast("int"), F.least(F.lit(3), F.size(parts) - at).cast("int")), "/")
    return (
        F.when(at.isNotNull() & (F.size(parts) > at), inside)
        .when(F.size(parts) >= 2, F.array_join(F.slice(parts, 1, 2), "/"))
        .otherwise(F.coalesce(F.nullif(parts[0], F.lit("")), F.lit("root")))
    )


def last_directories(path: Column, n: int = 2) -> Column:
    """The last n directories of a path."""
    parts = F.split(path, "/")
    dirs = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.array_join(F.slice(dirs, F.greatest(F.size(dirs) - n + 1, F.lit(1)), n), "/")


def token_estimate(text: Column, characters: float = 3.5) -> Column:
    return F.ceil(F.length(text) / F.lit(characters))


def embedding_text(name: Column, signature: Column, doc: Column, body: Column, snippet: int = 300) -> Column:
    """What is embedded of an entity: its parts on lines of their own, comments stripped of their marks."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(doc, r"/\*+|\*+/|(?m)^\s*\*", " "), r"\s+", " "))
    return F.concat_ws("\n", name, signature, F.nullif(plain, F.lit("")), F.substring(body, 1, snippet))


def source_slice(text: Column, first: Column, last: Column) -> Column:
    """Lines first to last of a text, counted from 1."""
    return F.array_join(F.slice(F.split(text, "\n"), first, last - first + 1), "\n")


#: Words that begin a commit message, or stand in its parentheses, and what they mean.
COMMIT_WORDS = [
    ("feat", "feature-development"),
    ("fix", "bug-fix"),
    ("refactor", "refactoring"),
    ("test", "testing"),
    ("docs", "documentation"),
    ("chore", "configuration"),
]


def commit_intent(message: Column, words: list[tuple[str, str]] = COMMIT_WORDS) -> Column:
    low = F.lower(message)
    out = F.when(F.lit(False), F.lit(""))
    for word, intent in words:
        out = out.when(low.startswith(word) | low.contains(f"({word})"), F.lit(intent))
    return out.otherwise(F.lit("unknown"))


#: Parts of a name and the responsibility that they tell of.
RESPONSIBILITIES = [
    (("get", "fetch", "load"), "Data Retrieval"),
    (("set", "update", "save"), "Data Mutation"),
    (("validate", "check", "verify"), "Validation"),
    (("render", "display", "show"), "Presentation"),
    (("handle", "process", "execute"), "Business Logic"),
    (("log", "track", "record"), "Logging/Tracking"),
    (("send", "notify", "emit"), "Communication"),
    (("parse", "transform", "convert"), "Data Transformation"),
]


def any_of(text: Column, words: tuple[str, ...] | list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def responsibilities(name: Column, rules=RESPONSIBILITIES) -> Column:
    low = F.lower(name)
    found = F.array_compact(F.array(*[F.when(any_of(low, words), F.lit(label)) for words, label in rules]))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("General Purpose")))


def word_set(text: Column) -> Column:
    """Distinct lower-case words of letters and digits."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def keyword_label(text: Column, rules: list[tuple[tuple[str, ...], str]], otherwise: str) -> Column:
    """The label of the first rule with a word that the text contains."""
    out = F.when(F.lit(False), F.lit(""))
    for words, label in rules:
        out = out.when(any_of(text, words), F.lit(label))
    return out.otherwise(F.lit(otherwise))
