"""Requests in plain words to queries over the catalogue.

A request is read as words, not by patterns: a relation (a verb such as "calls" or a noun
such as "callers") is looked up, and what stands around it says which way it goes and what
it is about.  ``answer`` then builds the frame; ``understood`` reads a whole column.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from graphloom.operators.graph import reverse

#: Intents that the relations stand for, seen from their target and from their subject.
VERBS = {
    "call": ("show_callers", "show_callees"),
    "import": ("show_importers", "show_imports"),
    "extend": ("show_hierarchy", None),
    "implement": ("show_hierarchy", None),
    "use": ("find_dependencies", None),
}
NOUNS = {
    "caller": "show_callers",
    "callee": "show_callees",
    "importer": "show_importers",
    "import": "show_imports",
    "implementation": "show_hierarchy",
    "method": "show_methods",
    "dependency": "find_dependencies",
}
KINDS = {"function": "find_function", "class": "find_class", "interface": "find_class", "file": "find_file"}
ASKERS = ("what", "who", "which", "that")
#: How sure a reading is, by how it was found.
SURE, RANKED, RELATED, KIND, GUESS = 0.9, 0.7, 0.6, 0.5, 0.4
#: Words that say nothing about what is sought.
STOP = frozenset(
    ["a", "an", "the", "is", "are", "was", "of", "to", "in", "on", "for", "and", "or", "with", "from", "that", "this", "what", "which", "who", "how",
     "does", "do", "me", "all", "show", "list", "get"]
)
#: Rows of an answer.
MOST = 20


@dataclass
class Request:
    intent: str
    target: str | None = None
    confidence: float = SURE
    keywords: list[str] = field(default_factory=list)


def _singular(word: str) -> str:
    """Of the nouns and verbs known here."""
    if word.endswith("ies"):
        return word[:-3] + "y"
    if word.endswith("sses"):
        return word[:-2]
    return word if word.endswith("ss") else word.removesuffix("s")


class _Reading:
    """The words of a request, as they stand and as they are looked up."""

    def __init__(self, text: str):
        self.said = text.split()
        self.low = [w.lower().strip("?!,;") for w in self.said]
        self.base = [_singular(w) for w in self.low]

    def target(self, start: int, end: int | None = None) -> str | None:
        return " ".join(self.said[start:end]).rstrip("?").strip() or None

    def at(self, *words: str) -> int | None:
        """Where these words stand one after another."""
        n = len(words)
        return next((i for i in range(len(self.low) - n + 1) if self.low[i : i + n] == list(words)), None)

    def relation(self) -> tuple[str, str | None] | None:
        """A verb or a noun with what it relates to."""
        does = self.at("does")
        for i, word in enumerate(self.base):
            after = self.target(i + 1)
            if word in NOUNS and self.low[i + 1 : i + 2] == ["of"] and (target := self.target(i + 2)):
                return NOUNS[word], target
            if word not in VERBS:
                continue
            incoming, outgoing = VERBS[word]
            if outgoing and does is not None and does + 1 < i:  # what does X call
                return outgoing, self.target(does + 1, i)
            if outgoing and i and self.low[i + 1 :] == ["what"]:  # X calls what
                return outgoing, self.target(0, i)
            if i and self.low[i - 1] in ASKERS and after:  # who calls X
                return incoming, after
        if len(self.base) > 1 and self.base[-1] == "method":  # X methods
            return "show_methods", self.target(0, len(self.base) - 1)
        return None

    def place(self) -> tuple[str, str | None] | None:
        where = self.at("where", "is")
        if where is not None and (target := self.target(where + 2)):
            if self.low[-1] in ("implemented", "defined") and len(self.low) > where + 3:
                target = self.target(where + 2, len(self.low) - 1)
            return "find_location", target
        for verb in ("find", "locate"):
            if (i := self.at(verb)) is not None and (target := self.target(i + 1)):
                return "find_location", target
        return None

    def explanation(self) -> tuple[str, str | None] | None:
        how = self.at("how", "does")
        if how is not None and "work" in self.low[how + 3 :]:
            return "explain", self.target(how + 2, self.low.index("work", how + 3))
        i = self.at("explain")
        target = self.target(i + 1) if i is not None else None
        return ("explain", target) if target else None

    def ranking(self) -> tuple[str, str | None] | None:
        over = self.at("complexity", "over")
        if over is not None and self.low[over + 2 : over + 3] and self.low[over + 2].isdigit():
            return "rank_complexity", self.low[over + 2]
        for degree, measure in zip(self.low, self.low[1:], strict=False):
            if (degree, measure) in (("most", "complex"), ("high", "complexity"), ("highest", "complexity")):
                return "rank_complexity", None
            if degree in ("most", "frequently") and measure == "called":
                return "rank_calls", None
            if degree in ("largest", "biggest") and _singular(measure) == "file":
                return "rank_size", None
        return None

    def scope(self) -> tuple[str, str | None] | None:
        for i, (word, link) in enumerate(zip(self.base, self.low[1:], strict=False)):
            if (target := self.target(i + 2)) is None:
                continue
            if link == "in" and word in ("function", "class") or (word, link) == ("exported", "from"):
                return "filter_scope", target
            if (word, link) in (("function", "like"), ("similar", "to")):
                return "semantic_search", target
        external = self.at("external")
        if external is not None and self.base[external + 1 : external + 2] == ["dependency"]:
            return "find_dependencies", None
        return None

    def kind(self) -> tuple[str, str | None] | None:
        if len(self.low) > 1 and self.low[0] in KINDS:
            return KINDS[self.low[0]], self.target(1)
        return None

    def hint(self) -> tuple[str, float] | None:
        """An intent from single words, where nothing was said in full."""
        have = set(self.low)
        if have & {"call", "calls", "callers"}:
            return "show_callers", RELATED
        if have & {"import", "imports"}:
            return "show_imports", RELATED
        if have & {"extends", "implements", "inherits"}:
            return "show_hierarchy", RELATED
        if have & {"most", "top", "largest", "biggest"}:
            by = {"complex": "rank_complexity", "complexity": "rank_complexity", "called": "rank_calls", "used": "rank_calls"}
            by |= {"file": "rank_size", "files": "rank_size", "size": "rank_size"}
            if found := next((intent for word, intent in by.items() if word in have), None):
                return found, RANKED
        kinds = {**KINDS, "method": "find_function"}
        found = next((intent for word, intent in kinds.items() if word in self.base), None)
        return (found, KIND) if found else None


def understand(text: str) -> Request:
    read = _Reading(text)
    keywords = [w for w in re.findall(r"\w+", text.lower()) if w not in STOP]
    for part in (read.relation, read.place, read.explanation, read.ranking, read.scope, read.kind):
        if found := part():
            return Request(*found, SURE, keywords)
    if found := read.hint():
        return Request(found[0], None, found[1], keywords)
    return Request("find_location" if keywords else "unknown", " ".join(keywords) or None, GUESS, keywords)


def understood(requests: DataFrame, text: str = "request") -> DataFrame:
    """Adds intent, target and confidence to each row; a null request is an empty one."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [understand(x if isinstance(x, str) else "") for x in b[text]]
            yield b.assign(intent=[r.intent for r in found], target=[r.target for r in found], confidence=[r.confidence for r in found])

    found = [StructField("intent", StringType()), StructField("target", StringType()), StructField("confidence", DoubleType())]
    schema = StructType([*requests.schema.fields, *found])
    return requests.mapInPandas(read, schema)


def _named(df: DataFrame, target: str | None, column: str = "name") -> DataFrame:
    return df.filter(F.contains(F.lower(column), F.lit((target or "").lower())))


def _ends(t, target: str | None, outgoing: bool) -> DataFrame:
    near, far = ("from_id", "to_id") if outgoing else ("to_id", "from_id")
    hit = _named(t("functions"), target).select(F.col("id").alias(near))
    return t("calls").join(hit, near).select(F.col(far).alias("id")).distinct().join(t("functions"), "id")


def _files(t, target: str | None, outgoing: bool) -> DataFrame:
    edges = t("imports") if outgoing else reverse(t("imports"))
    hit = _named(t("files"), target, "path").select(F.col("id").alias("from_id"))
    return edges.join(hit, "from_id").select(F.col("to_id").alias("id")).distinct().join(t("files"), "id")


def _rank_calls(t, _: str | None) -> DataFrame:
    n = t("calls").groupBy(F.col("to_id").alias("id")).agg(F.count("*").alias("callers"))
    return n.orderBy(F.desc("callers"), "id").limit(MOST).join(t("functions"), "id")


def _rank_complexity(t, target: str | None) -> DataFrame:
    f = t("functions").filter(F.col("complexity") > int(target)) if target else t("functions")
    return f.orderBy(F.desc("complexity"), "id").limit(MOST)


def _with_path(t, rows: DataFrame) -> DataFrame:
    return rows.join(t("files").select(F.col("id").alias("file_id"), "path"), "file_id")


def _entities(rows: DataFrame, kind: str, name: str = "name", path: str = "path") -> DataFrame:
    """What answers of several kinds have in common: kind, id, name and path."""
    return rows.select(F.lit(kind).alias("kind"), F.col("id").cast("string").alias("id"), F.col(name).alias("name"), F.col(path).alias("path"))


def _location(t, target: str | None) -> DataFrame:
    """Functions, files and classes by name or path."""
    functions = _entities(_with_path(t, _named(t("functions"), target)), "function")
    files = _entities(_named(t("files"), target, "path"), "file", "path")
    return functions.unionByName(files).unionByName(_entities(_with_path(t, _named(t("classes"), target)), "class"))


def _explain(t, target: str | None) -> DataFrame:
    """Where it is, and what it calls."""
    return _location(t, target).unionByName(_entities(_with_path(t, _ends(t, target, True)), "callee"))


def _hierarchy(t, target: str | None) -> DataFrame:
    """Classes that extend the classes, or implement the interfaces, of this name."""
    below = lambda edges, above, how: (
        t(edges).join(_named(t(above), target).select(F.col("id").alias("to_id"), F.col("name").alias("parent")), "to_id")
        .join(t("classes").select(F.col("id").alias("from_id"), "name"), "from_id")
        .select(F.lit(how).alias("kind"), F.col("from_id").alias("id"), "name", "parent")
    )
    return below("extends", "classes", "extends").unionByName(below("implements", "interfaces", "implements"))


def _methods(t, target: str | None) -> DataFrame:
    owner = _named(t("classes"), target).select(F.col("id").alias("from_id"), F.col("name").alias("class_name"))
    return t("has_method").join(owner, "from_id").join(t("functions").withColumnRenamed("id", "to_id"), "to_id").select(F.col("to_id").alias("id"), "name", "class_name")


def _class(t, target: str | None) -> DataFrame:
    kinds = [("class", "classes"), ("interface", "interfaces")]
    classes, interfaces = (_named(t(table), target).select(F.lit(kind).alias("kind"), F.col("id").cast("string").alias("id"), "name") for kind, table in kinds)
    return classes.unionByName(interfaces)


def _scope(t, target: str | None) -> DataFrame:
    """Functions and classes of the files below a path."""
    both = _entities(_with_path(t, t("functions")), "function").unionByName(_entities(_with_path(t, t("classes")), "class"))
    return both.filter(F.startswith("path", F.lit(target or "")))


def _dependencies(t, target: str | None) -> DataFrame:
    """What uses a package; without one, packages by how much they are used."""
    if target:
        return _named(t("externals"), target, "package").join(t("functions").select(F.col("id").alias("from_id"), "name"), "from_id")
    return t("externals").groupBy("package").agg(F.count("*").alias("references")).orderBy(F.desc("references"), "package").limit(MOST)


#: One builder for each intent.
BUILDERS: dict[str, Callable] = {
    "show_callers": lambda t, x: _ends(t, x, False),
    "show_callees": lambda t, x: _ends(t, x, True),
    "show_importers": lambda t, x: _files(t, x, False),
    "show_imports": lambda t, x: _files(t, x, True),
    "show_hierarchy": _hierarchy,
    "show_methods": _methods,
    "explain": _explain,
    "rank_complexity": _rank_complexity,
    "rank_calls": _rank_calls,
    "rank_size": lambda t, _: t("files").orderBy(F.desc("size"), "id").limit(MOST),
    "filter_scope": _scope,
    "find_dependencies": _dependencies,
    "find_function": lambda t, x: _named(t("functions"), x),
    "find_class": _class,
    "find_file": lambda t, x: _named(t("files"), x, "path"),
    "find_location": _location,
    "semantic_search": _location,
    "unknown": lambda t, _: t("functions"),
}


def answer(text: str, tables: Callable[[str], DataFrame]) -> DataFrame:
    """The frame that answers a request; without a target its keywords are what is sought."""
    request = understand(text)
    target = request.target
    if target is None and request.confidence < SURE and not request.intent.startswith("rank_"):
        target = " ".join(request.keywords) or None
    return BUILDERS[request.intent](tables, target)
