"""Steps of the composite reports as frames: contributors, gaps, categories, incidents, tests, warnings.

Frames come from the catalogue: ``facts`` has id, name, file_id, layer, area, complexity,
callers, changes; ``ledger`` has seq, at (seconds), event_type, source, entity_ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.numeric import half_up, percent
from graphloom.operators.windows import top_per_group

DAY = 86_400
#: What marks an incident in an event's type, and a test in a path or a name.
INCIDENTS = ("incident", "error", "fail")
TEST_PATHS = ("__tests__", ".test.", ".spec.", "/test/")
TEST_FOLDERS = ("/tests/",)
TEST_STARTS = ("test", "it", "describe")
TEST_PARTS = ("test_", "_test")
TELLING = ("should", "expect", "verify", "check")
#: Shares of mocks among a test's calls, by what its path contains.
MOCKS, OTHER_MOCKS = {"unit": 0.5, "integration": 0.1}, 0.3


def _any(column: Column, marks: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for m in marks:
        found = found | column.contains(m)
    return found


def by_entity(ledger: DataFrame) -> DataFrame:
    """A row for each entity that a ledger row touches, once even if it is listed twice."""
    return ledger.withColumn("entity", F.explode(F.array_distinct("entity_ids")))


def contributors(ledger: DataFrame, members: DataFrame, author: Column) -> DataFrame:
    """module, author, commits and last_active from ledger rows; members has id and module, no author counts as unknown."""
    own = members.select(F.col("id").alias("entity"), "module")
    who = F.coalesce(author, F.lit("unknown"))
    return by_entity(ledger).join(own, "entity").groupBy("module", who.alias("author")).agg(F.count("*").alias("commits"), F.max("at").alias("last_active"))


def experts(found: DataFrame, most: int = 5) -> DataFrame:
    """The authors of each module with the most commits, their rounded share and when they were last active."""
    total = found.groupBy("module").agg(F.sum("commits").alias("total"))
    top = top_per_group(found, ["module"], [F.desc("commits"), F.col("author")], most)
    return top.join(total, "module").select("module", "author", "commits", "rank", "last_active", half_up(percent(F.col("commits"), F.col("total"))).alias("share"))


def module_layer(facts: DataFrame, module: str = "file_id") -> DataFrame:
    """The commonest layer of each module; the first by name of equally common ones."""
    n = facts.groupBy(F.col(module).alias("module"), "layer").agg(F.count("*").alias("n"))
    return n.groupBy("module").agg(F.min_by("layer", F.struct(-F.col("n"), "layer")).alias("layer"))


def bus_risks(found: DataFrame) -> DataFrame:
    """Modules of five commits or more of which one author has 70 % or more; columns module, author, commits."""
    first = F.min_by(F.struct("author", "commits"), F.struct(-F.col("commits"), "author"))
    each = found.groupBy("module").agg(F.sum("commits").alias("total"), first.alias("p"))
    share = percent(F.col("p.commits"), F.col("total"))
    # From four fifths on the first author alone makes up the bus factor.
    level = F.when(share >= 90, "CRITICAL").when(share >= 80, "HIGH").otherwise("MODERATE")
    return each.filter((F.col("total") >= 5) & (share >= 70)).select("module", F.col("p.author").alias("author"), "total", half_up(share).alias("share"), level.alias("risk"))


def gaps(layered: DataFrame, most: int = 20) -> DataFrame:
    """Untested revenue-critical and user-facing entities, the former first, then by complexity; columns id, layer, tested, complexity."""
    priority = F.when(F.col("layer") == "revenue-critical", 1).when(F.col("layer") == "user-facing", 2)
    missed = layered.filter(~F.col("tested")).withColumn("priority", priority).filter("priority IS NOT NULL")
    return missed.orderBy("priority", F.desc("complexity"), "id").limit(most).select("id", "layer", "priority", "complexity")


def recent_changes(ledger: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """entity and changes, its ledger rows within the days before ``as_of`` (seconds)."""
    recent = ledger.filter(F.col("at") >= as_of - days * DAY)
    return by_entity(recent).groupBy("entity").agg(F.count("*").alias("changes"))


def high_friction(found: DataFrame, least: float = 2.0, most: int = 20) -> DataFrame:
    """Entities whose friction is so many times the mean; columns id, friction and multiple."""
    return found.filter(F.col("multiple") >= least).orderBy(F.desc("friction"), "id").limit(most)


def debt_categories(facts: DataFrame, friction: Column) -> DataFrame:
    """Overlapping kinds of debt with number, sum and mean of friction; columns layer, complexity, changes."""
    x = F.col("complexity")
    kinds = {
        "very complex": x > 30,
        "complex": (x >= 15) & (x <= 30),
        "often changed": F.col("changes") > 5,
        "complex domain": (F.col("layer") == "domain") & (x > 15),
    }
    held = F.array_compact(F.array(*[F.when(holds, name) for name, holds in kinds.items()]))
    each = facts.select(F.explode(held).alias("category"), friction.alias("f"))
    return each.groupBy("category").agg(F.count("*").alias("entities"), F.sum("f").alias("friction"), F.avg("f").alias("mean"))


def incidents(ledger: DataFrame) -> DataFrame:
    """entity, number of incidents and when the last one was."""
    hit = ledger.filter(_any(F.lower("event_type"), INCIDENTS))
    return by_entity(hit).groupBy("entity").agg(F.count("*").alias("incidents"), F.max("at").alias("last_incident"))


def is_production(path: Column) -> Column:
    return ~_any(path, TEST_PATHS)


def directory(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def is_test(name: Column, path: Column) -> Column:
    """By path, or by a name that begins or is put together like a test's."""
    low = F.lower(name)
    begins = F.lit(False)
    for start in TEST_STARTS:
        begins = begins | low.startswith(start)
    return _any(F.lower(path), TEST_PATHS + TEST_FOLDERS) | begins | _any(low, TEST_PARTS)


def target_name(name: Column) -> Column:
    """What a test is about, by its name."""
    bare = F.regexp_replace(name, "(?i)^(test_?|it_?|should_?)", "")
    return F.regexp_replace(F.regexp_replace(bare, "(?i)_(test|spec)$", ""), r"(?i)^(describes?|tests?)\s*", "")


def test_estimates(name: Column, path: Column, lines: Column) -> dict[str, Column]:
    """calls, strong and weak assertions and mocks that a test of so many lines is taken to have."""
    calls = F.greatest(F.lit(1), F.floor(lines / 3))
    telling = _any(name, TELLING)
    share = F.lit(OTHER_MOCKS)
    for mark, part in reversed(MOCKS.items()):
        share = F.when(path.contains(mark), part).otherwise(share)
    return {
        "calls": calls,
        "strong": F.when(telling, F.greatest(F.lit(1), F.floor(lines / 5))).otherwise(F.lit(0)),
        "weak": F.when(~telling & (lines > 3), F.floor(lines / 8)).otherwise(F.lit(0)),
        "mocks": F.floor(calls * share),
    }


def criticality_group(score: Column) -> Column:
    return F.when(score >= 80, "revenue-critical").when(score >= 60, "user-facing").otherwise("other")


def with_tests(functions: DataFrame, tests: DataFrame) -> DataFrame:
    """Adds tested: whether a test lies in the function's directory or is named after it; columns name and path on both sides."""
    folders = tests.select(directory(F.col("path")).alias("_d")).distinct()
    names = tests.select(target_name(F.col("name")).alias("_n")).distinct()
    joined = functions.withColumn("_own", directory(F.col("path"))).join(folders, F.col("_own") == F.col("_d"), "left")
    joined = joined.join(names, F.col("name") == F.col("_n"), "left")
    return joined.withColumn("tested", F.col("_d").isNotNull() | F.col("_n").isNotNull()).drop("_own", "_d", "_n")


def incident_modules(found: DataFrame, members: DataFrame, most: int = 10) -> DataFrame:
    """Modules by incidents: those with several, or without tests, which double their risk; members has id, module, tested."""
    each = found.join(members.select(F.col("id").alias("entity"), "module", "tested"), "entity")
    sums = each.groupBy("module").agg(F.sum("incidents").alias("incidents"), F.max("tested").alias("tested"))
    risk = F.col("incidents") * F.when(F.col("tested"), 1).otherwise(2)
    kept = sums.filter((F.col("incidents") > 1) | ~F.col("tested")).withColumn("risk", risk)
    return kept.orderBy(F.desc("incidents"), "module").limit(most)


def test_health(coverage: Column, mocks: Column, flaky: Column, depth: Column, risky: Column) -> Column:
    """The mean of five factors of 0 to 100; coverage and mocks in percent."""
    factors = [
        coverage,
        100 - mocks,
        F.greatest(F.lit(0), 100 - flaky * 10),
        F.least(F.lit(100), depth * 40),
        F.greatest(F.lit(0), 100 - risky * 15),
    ]
    return half_up(sum(factors[1:], factors[0]) / len(factors))


def test_effectiveness(introduced: Column, mocks: Column, coverage: Column) -> Column:
    return half_up((100 - introduced) * 0.4 + (100 - mocks) * 0.3 + coverage * 0.3)


def warnings(expert_count: Column, commits: Column, changes: Column, incident_count: Column) -> Column:
    """What to know before an entity is changed, as an array."""
    return F.array_compact(
        F.array(
            F.when((expert_count == 1) & (commits > 5), "BUS_FACTOR"),
            F.when(changes > 15, "HIGH_CHURN"),
            F.when(incident_count > 0, "INCIDENT_PRONE"),
        )
    )


def had_incident(changes: DataFrame, found: DataFrame) -> DataFrame:
    """Adds whether an incident of the entity is later than the change (entity, at)."""
    joined = changes.join(found.select("entity", "last_incident"), "entity", "left")
    return joined.withColumn("had_incident", F.coalesce(F.col("last_incident") > F.col("at"), F.lit(False))).drop("last_incident")
