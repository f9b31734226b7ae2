"""Rules learnt from corrections, failures, refactorings and instructions; answers to questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.numeric import confidence_level

#: Fixed values: (part of an error message, pattern that triggers the rule, rule).
FAILURES = [
    ("is not assignable to type", "type.*=", "Ensure type compatibility in assignments"),
    ("Cannot find module", "import.*from", "Verify module paths and ensure dependencies are installed"),
    ("is not a function", r"\w+\(", "Verify function exists before calling"),
]
#: Words of an instruction that trigger nothing.
COMMON = ("should", "always", "never", "when", "with", "from")


def first_change(before: Column, after: Column) -> Column:
    """bad and good: the first line that differs from the one at its place, neither being blank; null if none."""
    lines = F.zip_with(F.split(before, "\n"), F.split(after, "\n"), lambda a, b: F.struct(F.trim(a).alias("bad"), F.trim(b).alias("good"), (a != b).alias("new")))
    return F.get(F.filter(lines, lambda x: x["new"] & (x["bad"] != "") & (x["good"] != "")), F.lit(0))


def _pattern(code: Column) -> Column:
    escaped = F.regexp_replace(code, r"([.*+?^${}()|\[\]\\])", r"\\$1")
    return F.regexp_replace(escaped, r"\s+", r"\\s*")


def _rules(rows: DataFrame, keep: list[str], scope, category, kind: str, trigger: Column, text: Column, source: str, confidence: float) -> DataFrame:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return rows.select(
        *keep,
        as_column(scope).alias("scope"),
        as_column(category).alias("category"),
        F.lit(kind).alias("trigger_kind"),
        trigger.alias("trigger"),
        text.alias("rule"),
        F.lit(source).alias("source"),
        F.lit(confidence).alias("confidence"),
    )


def from_changes(rows: DataFrame, keep: list[str], refactor: bool = False) -> DataFrame:
    """Rules of corrections, or refactorings (columns before, after, path); rows without a change give none."""
    changed = rows.withColumn("_c", first_change(F.col("before"), F.col("after"))).filter("_c IS NOT NULL")
    text = F.concat(F.lit('Prefer "'), F.col("_c.good"), F.lit('" over "'), F.col("_c.bad"), F.lit('"'))
    if refactor:
        return _rules(changed, keep, "project", "architecture", "code-pattern", _pattern(F.col("_c.bad")), text, "manual-refactor", 0.7)
    ending = F.concat(F.lit("*"), F.regexp_extract("path", r"[^/](\.[^./]*)$", 1))
    return _rules(changed, keep, "file", "convention", "file-pattern", ending, text, "user-correction", 0.6)


def from_failures(rows: DataFrame, keep: list[str]) -> DataFrame:
    """Rules of build errors (column message) of a known kind."""
    kinds = F.array(*[F.struct(*map(F.lit, f)) for f in FAILURES])
    found = rows.withColumn("_f", F.get(F.filter(kinds, lambda k: F.col("message").contains(k["col1"])), F.lit(0))).filter("_f IS NOT NULL")
    return _rules(found, keep, "project", "anti-pattern", "code-pattern", F.col("_f.col2"), F.col("_f.col3"), "build-failure", 0.5)


def from_instructions(rows: DataFrame, keep: list[str]) -> DataFrame:
    """Rules of instructions (columns instruction, scope, category), triggered by their first three telling words."""
    words = F.filter(F.split(F.lower("instruction"), r"\s+"), lambda w: (F.length(w) > 3) & ~w.isin(*COMMON))
    trigger = F.array_join(F.slice(words, 1, 3), "|")
    return _rules(rows, keep, F.col("scope"), F.col("category"), "context-keyword", trigger, F.col("instruction"), "explicit-instruction", 0.9)


def apply_answers(justifications: DataFrame, answers: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Justifications (id, purpose, business_value, feature, detail, confidence, pending) after answers (question, answer).

    A question is its justification's id, a dash and a category.  Each answer adds 0.3 of
    confidence, at most 1; answers of other categories join the detail, by category.  A
    question answered twice counts once, with the greatest answer.  Rows without answers
    stay as they are; level is given for all.
    """
    parts = answers.groupBy("question").agg(F.max("answer").alias("answer")).select(
        F.regexp_extract("question", "(?s)^(.*)-([^-]*)$", 1).alias("_id"), F.regexp_extract("question", "(?s)^(.*)-([^-]*)$", 2).alias("kind"), "answer"
    )
    of = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("answer")))
    told = parts.groupBy("_id").agg(
        F.count("*").alias("_n"),
        of("purpose").alias("_purpose"),
        of("business_value").alias("_value"),
        of("feature_context").alias("_feature"),
        F.array_sort(F.collect_set(F.when(F.col("kind").isin("naming", "relationship", "ownership"), F.concat("kind", F.lit(": "), "answer")))).alias("_more"),
    )
    rows = justifications.join(told, F.col("id").cast("string") == F.col("_id"), "left")
    answered = F.col("_n").isNotNull()
    purpose, value = F.coalesce("_purpose", "purpose"), F.coalesce("_value", "business_value")
    score = F.when(answered, F.least(F.lit(1.0), F.col("confidence") + 0.3 * F.col("_n"))).otherwise(F.col("confidence"))
    empty = lambda x: F.coalesce(x, F.lit("")) == ""
    detail = F.trim(F.concat_ws("\n", F.nullif("detail", F.lit("")), F.array_join("_more", "\n")))
    return rows.select(
        "id",
        purpose.alias("purpose"),
        value.alias("business_value"),
        F.coalesce("_feature", "feature").alias("feature"),
        F.when(answered & (F.size("_more") > 0), detail).otherwise(F.col("detail")).alias("detail"),
        score.alias("confidence"),
        confidence_level(score).alias("level"),
        F.when(answered, empty(purpose) | empty(value) | (score < threshold)).otherwise(F.col("pending")).alias("pending"),
    )
