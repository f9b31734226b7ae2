"""Rows that parsers and analysers deliver, refined: references, patterns, effects, flows, rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.storage import durable

PRIMITIVE = "string number boolean void any unknown never null undefined object".split()

#: What a call's name tells of its effects, and how severe that is.
EFFECTS = [
    ("network", "high", ("fetch(", "axios.", "http.")),
    ("file", "high", ("fs.", "writeFile", "readFile")),
    ("database", "high", (".query(", ".execute(", ".put(")),
    ("console", "low", ("console.",)),
    ("timer", "medium", ("setTimeout", "setInterval")),
    ("random", "low", ("Math.random", "crypto.random")),
]


def type_references(functions: DataFrame, types: Column) -> DataFrame:
    """id and each type that it names, without primitive ones."""
    return functions.select("id", F.explode(F.array_distinct(types)).alias("type")).filter(~F.col("type").isin(PRIMITIVE))


def resolve_imports(imports: DataFrame, files: DataFrame, endings: tuple[str, ...] = ("", ".ts", "/index.ts")) -> DataFrame:
    """from_id, spec, to_id and kind: a relative import ends at the first candidate path that is a file, others are external."""
    relative = F.col("spec").startswith(".")
    base = F.concat_ws("/", F.regexp_replace("path", "/[^/]*$", ""), F.regexp_replace("spec", r"^\./", ""))
    # a/b/../c is a/c; two rounds do for imports that climb twice
    for _ in range(2):
        base = F.regexp_replace(base, r"[^/]+/\.\./", "")
    rows = imports.join(files.select(F.col("id").alias("from_id"), "path"), "from_id").withColumn("base", base)
    tries = F.array(*[F.struct(F.lit(i).alias("at"), F.concat("base", F.lit(e)).alias("p")) for i, e in enumerate(endings)])
    hits = (
        rows.filter(relative).select("from_id", "spec", F.explode(tries).alias("t"))
        .join(files.select(F.col("path").alias("_p"), F.col("id").alias("to_id")), F.col("t.p") == F.col("_p"))
        .groupBy("from_id", "spec").agg(F.min_by("to_id", "t.at").alias("to_id"))
    )
    return rows.join(hits, ["from_id", "spec"], "left").select(
        "from_id", "spec", "to_id", F.when(~relative, "external").when(F.col("to_id").isNull(), "unresolved").otherwise("file").alias("kind")
    )


def escaping(throws: DataFrame, tries: DataFrame) -> DataFrame:
    """Throws (id, line, error) that no try block (id, first, last) of the same function holds."""
    held = F.expr("t.id = b.id AND t.line BETWEEN b.first AND b.last")
    return throws.alias("t").join(tries.alias("b"), held, "left_anti")


def effects(calls: DataFrame, text: str = "text", rules=EFFECTS) -> DataFrame:
    """One row for each call and kind of effect that its text shows."""
    found = F.array_compact(
        F.array(*[F.when(_any(F.col(text), marks), F.struct(F.lit(kind).alias("kind"), F.lit(level).alias("level"))) for kind, level, marks in rules])
    )
    return calls.withColumn("_e", F.explode(found)).select(*calls.columns, "_e.kind", "_e.level")


def _any(text: Column, marks: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for m in marks:
        out = out | text.contains(m)
    return out


def patterns(signals: DataFrame, least: float = 0.4) -> DataFrame:
    """Entities and design patterns whose matched signals weigh enough (entity, pattern, weight, matched)."""
    score = F.sum(F.when(F.col("matched"), F.col("weight")).otherwise(0.0)) / F.sum("weight")
    return signals.groupBy("entity", "pattern").agg(score.alias("confidence")).filter(F.col("confidence") >= least)


def still_valid(cache: DataFrame, files: DataFrame) -> DataFrame:
    """Cached rows whose file still has the hash that they were made from."""
    return cache.join(files.select("file_id", "hash"), ["file_id", "hash"], "left_semi")


def argument_flows(calls: DataFrame, tainted: DataFrame) -> DataFrame:
    """(function, parameter) pairs that tainted ones reach in one call: caller, parameter, callee, argument."""
    return calls.join(tainted, ["caller", "parameter"]).select(F.col("callee").alias("caller"), F.col("argument").alias("parameter")).distinct()


def cross_function(calls: DataFrame, start: DataFrame, most: int = 10) -> DataFrame:
    """caller, parameter and depth of all that the start's parameters reach through calls."""
    frontier = start.select("caller", "parameter").distinct()
    seen = durable(frontier.withColumn("depth", F.lit(0)))
    for depth in range(1, most + 1):
        hop = argument_flows(calls, frontier).join(seen, ["caller", "parameter"], "left_anti")
        hop = durable(hop.withColumn("depth", F.lit(depth)))
        if hop.isEmpty():
            break
        seen, frontier = seen.unionAll(hop), hop.select("caller", "parameter")
    return seen


def observed(events: DataFrame, session: str = "session_id") -> DataFrame:
    """What a session used and touched, and how often."""
    return events.groupBy(session).agg(
        F.count("*").alias("events"), F.countDistinct("event_type").alias("tools"), F.array_sort(F.collect_set("event_type")).alias("names")
    )


def matching_rules(rules: DataFrame, texts: DataFrame) -> DataFrame:
    """Rules (id, pattern) that a text (key, text) matches, in any case; a pattern that isn't valid matches its equal.

    Validity is decided once for each rule.  Rules are few; their number is checked before
    they are broadcast.
    """
    import re

    rows = rules.select("id", "pattern").limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("more than 10000 rules")

    def valid(p: str) -> bool:
        try:
            re.compile(p)
        except re.error:
            return False
        return True

    spark = rules.sparkSession
    given = [(r.id, f"(?i){r.pattern}" if valid(r.pattern) else f"(?s)^{re.escape(r.pattern)}$") for r in rows]
    prepared = spark.createDataFrame(given, f"id {dict(rules.dtypes)['id']}, rule string")
    return texts.join(F.broadcast(prepared), F.regexp_like("text", F.col("rule"))).select("key", "id")
