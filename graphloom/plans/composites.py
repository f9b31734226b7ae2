"""Steps of the composite reports over the ledger and the functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import composites as C
from graphloom.operators import reports as R
from graphloom.operators import windows as W
from graphloom.plans.analytics import R6, r6
from graphloom.plans.registry import Plans

PLANS = Plans()
plan = PLANS.plan
c = F.col

TOUCHED = "touched AS (SELECT l.seq, l.at, l.event_type, l.source, unnest(list_distinct(l.entity_ids)) AS entity FROM ledger l)"
CONTRIBUTORS = f"""{TOUCHED}, n AS (SELECT f.file_id AS module, COALESCE(t.source, 'unknown') AS author, count(*) AS commits, max(t.at) AS last_active
  FROM touched t JOIN functions f ON f.id = t.entity GROUP BY ALL)"""
FAILED = "(contains(lower(event_type), 'incident') OR contains(lower(event_type), 'error') OR contains(lower(event_type), 'fail'))"
PLACED = "placed AS (SELECT f.id, f.name, x.path, f.file_id, f.start_line, f.end_line, f.complexity FROM functions f JOIN files x ON f.file_id = x.id)"


def members(t):
    return t.functions.select("id", c("file_id").alias("module"))


def contributed(t):
    return C.contributors(t.ledger, members(t), c("source"))


def placed(t):
    """Functions with paths; every seventh lies in a folder of tests."""
    path = F.when(c("id") % 7 == 0, F.concat(F.lit("src/test/f"), (c("id") % 13).cast("string"), F.lit(".ts"))).otherwise(c("path"))
    f = t.functions.join(t.files.select(c("id").alias("file_id"), "path"), "file_id")
    return f.select("id", F.when(c("id") % 11 == 0, F.concat(F.lit("test_"), "name")).otherwise(c("name")).alias("name"), path.alias("path"), "start_line", "end_line")


SPOTS = """spots AS (SELECT f.id, CASE WHEN f.id % 11 = 0 THEN concat('test_', f.name) ELSE f.name END AS name,
  CASE WHEN f.id % 7 = 0 THEN concat('src/test/f', CAST(f.id % 13 AS VARCHAR), '.ts') ELSE x.path END AS path, f.start_line, f.end_line FROM functions f JOIN files x ON f.file_id = x.id)"""
IS_TEST = "(contains(path, '/test/') OR starts_with(name, 'test') OR starts_with(name, 'it') OR contains(name, 'test_'))"


@plan("r1_churn", f"WITH {TOUCHED} SELECT entity, count(*) AS changes FROM touched GROUP BY entity")
def churn(t):
    return C.by_entity(t.ledger).groupBy("entity").agg(F.count("*").alias("changes"))


@plan("r2_contributors", f"WITH {CONTRIBUTORS} SELECT * FROM n")
def contributors(t):
    return contributed(t)


@plan("r2_experts", f"""WITH {CONTRIBUTORS}, k AS (SELECT *, row_number() OVER (PARTITION BY module ORDER BY commits DESC, author) AS rank, sum(commits) OVER (PARTITION BY module) AS total FROM n)
SELECT module, author, commits, CAST(rank AS INT) AS rank, last_active, floor(commits * 100.0 / total + 0.5) AS share FROM k WHERE rank <= 5""")
def experts(t):
    return C.experts(contributed(t))


@plan("r2_module_layer", "WITH n AS (SELECT file_id AS module, layer, count(*) AS n FROM functions GROUP BY ALL) SELECT module, min_by(layer, (-n, layer)) AS layer FROM n GROUP BY module")
def module_layer(t):
    return C.module_layer(t.functions)


LAYERS = """layered AS (SELECT id, complexity, complexity <= 3 OR callers > 2 AS tested, CASE WHEN layer = 'domain' THEN CASE WHEN area LIKE '%payment%' THEN 'revenue-critical'
  WHEN area LIKE '%user%' OR area LIKE '%dashboard%' THEN 'user-facing' ELSE 'internal' END WHEN layer = 'infrastructure' THEN 'infrastructure' ELSE 'unknown' END AS layer FROM entity_facts)"""


@plan("r3_gaps", f"""WITH {LAYERS}, g AS (SELECT id, layer, CASE layer WHEN 'revenue-critical' THEN 1 ELSE 2 END AS priority, complexity FROM layered WHERE NOT tested AND layer IN ('revenue-critical', 'user-facing'))
SELECT * FROM g ORDER BY priority, complexity DESC, id LIMIT 20""")
def gaps(t):
    layer = R.layer(c("layer") == "domain", c("layer") == "infrastructure", c("area"))
    tested = (c("complexity") <= 3) | (c("callers") > 2)
    return C.gaps(t.entity_facts.select("id", layer.alias("layer"), tested.alias("tested"), "complexity"))


@plan("r4_recent", f"""WITH {TOUCHED} SELECT entity, count(*) AS changes FROM touched WHERE touched."at" >= (SELECT max(ledger."at") FROM ledger) - 30 * 86400 GROUP BY entity""")
def recent(t):
    last = F.broadcast(t.ledger.agg(F.max("at").alias("as_of")))  # one row
    return C.recent_changes(t.ledger.crossJoin(last), c("as_of"))


FRICTION = "complexity * greatest(1.0, changes)::DOUBLE"


@plan("r4_high_friction", f"""WITH f AS (SELECT id, {FRICTION} AS friction FROM entity_facts), m AS (SELECT *, friction / avg(friction) OVER () AS multiple FROM f)
SELECT id, friction, {R6.format('multiple')} AS multiple FROM m WHERE multiple >= 2 ORDER BY friction DESC, id LIMIT 20""")
def high_friction(t):
    f = t.entity_facts.select("id", R.friction(c("complexity"), c("changes"), F.lit(1.0)).alias("friction"))
    return C.high_friction(W.over_mean(f, "friction", "multiple")).select("id", "friction", r6(c("multiple")).alias("multiple"))


@plan("r4_categories", f"""WITH k AS (
  SELECT 'very complex' AS category, {FRICTION} AS f FROM entity_facts WHERE complexity > 30 UNION ALL SELECT 'complex', {FRICTION} FROM entity_facts WHERE complexity BETWEEN 15 AND 30
  UNION ALL SELECT 'often changed', {FRICTION} FROM entity_facts WHERE changes > 5 UNION ALL SELECT 'complex domain', {FRICTION} FROM entity_facts WHERE layer = 'domain' AND complexity > 15)
SELECT category, count(*) AS entities, sum(f) AS friction, {R6.format('avg(f)')} AS mean FROM k GROUP BY category""")
def categories(t):
    found = C.debt_categories(t.entity_facts, R.friction(c("complexity"), c("changes"), F.lit(1.0)))
    return found.select("category", "entities", "friction", r6(c("mean")).alias("mean"))


@plan("r5_incidents", f"""WITH {TOUCHED} SELECT entity, count(*) AS incidents, max(touched."at") AS last_incident FROM touched WHERE {FAILED} GROUP BY entity""")
def incidents(t):
    return C.incidents(t.ledger)


@plan("r6_production", f"WITH {SPOTS} SELECT id FROM spots WHERE NOT contains(path, '__tests__') AND NOT contains(path, '.test.') AND NOT contains(path, '.spec.') AND NOT contains(path, '/test/')")
def production(t):
    return placed(t).filter(C.is_production(c("path"))).select("id")


@plan("r6_bus_risks", f"""WITH {CONTRIBUTORS}, p AS (SELECT module, sum(commits) AS total, min_by(author, (-commits, author)) AS author, max(commits) AS most FROM n GROUP BY module)
SELECT module, author, CAST(total AS BIGINT) AS total, floor(most * 100.0 / total + 0.5) AS share, CASE WHEN most * 100.0 / total >= 90 THEN 'CRITICAL' WHEN most * 100.0 / total >= 80 THEN 'HIGH' ELSE 'MODERATE' END AS risk
FROM p WHERE total >= 5 AND most * 100.0 / total >= 70""")
def bus_risks(t):
    return C.bus_risks(contributed(t))


@plan("r7_tests", f"""WITH {SPOTS}, t AS (SELECT *, end_line - start_line AS lines, greatest(1, floor((end_line - start_line) / 3)) AS calls FROM spots WHERE {IS_TEST})
SELECT id, regexp_replace(name, '^test_?', '') AS target, CAST(calls AS BIGINT) AS calls, CAST(CASE WHEN lines > 3 THEN floor(lines / 8) ELSE 0 END AS BIGINT) AS weak, CAST(floor(calls * 0.3::DOUBLE) AS BIGINT) AS mocks FROM t""")
def tests(t):
    found = placed(t).filter(C.is_test(c("name"), c("path")))
    guess = C.test_estimates(c("name"), c("path"), c("end_line") - c("start_line"))
    return found.select("id", C.target_name(c("name")).alias("target"), *[guess[k].cast("long").alias(k) for k in ("calls", "weak", "mocks")])


@plan("r8_has_test", f"""WITH {SPOTS}, t AS (SELECT * FROM spots WHERE {IS_TEST}), p AS (SELECT * FROM spots WHERE NOT {IS_TEST})
SELECT id, regexp_replace(path, '/?[^/]*$', '') IN (SELECT regexp_replace(path, '/?[^/]*$', '') FROM t) OR name IN (SELECT regexp_replace(name, '^test_?', '') FROM t) AS tested FROM p""")
def has_test(t):
    test = C.is_test(c("name"), c("path"))
    return C.with_tests(placed(t).filter(~test), placed(t).filter(test)).select("id", "tested")


@plan("r8_incident_modules", f"""WITH {TOUCHED}, i AS (SELECT f.file_id AS module, count(*) AS incidents, bool_or(f.id % 90 = 1) AS tested FROM touched t JOIN functions f ON f.id = t.entity WHERE {FAILED} GROUP BY ALL)
SELECT module, incidents, tested, CAST(incidents * CASE WHEN tested THEN 1 ELSE 2 END AS BIGINT) AS risk FROM i WHERE incidents > 1 OR NOT tested ORDER BY incidents DESC, module LIMIT 10""")
def incident_modules(t):
    return C.incident_modules(C.incidents(t.ledger), t.functions.select("id", c("file_id").alias("module"), (c("id") % 90 == 1).alias("tested")))


@plan("r8_health", """
WITH h AS (SELECT file_id AS module, count(*) FILTER (WHERE changes > 0) * 100.0 / count(*) AS coverage, count(*) FILTER (WHERE callers = 0) * 100.0 / count(*) AS mocks, count(*) FILTER (WHERE complexity > 45) AS flaky,
  avg(callers) AS depth, count(*) FILTER (WHERE changes > 40) AS risky FROM entity_facts GROUP BY file_id)
SELECT module, floor((coverage + 100 - mocks + greatest(0, 100 - flaky * 10) + least(100, depth * 40) + greatest(0, 100 - risky * 15)) / 5 + 0.5) AS health,
  floor((100 - mocks) * 0.4::DOUBLE + (100 - mocks) * 0.3::DOUBLE + coverage * 0.3::DOUBLE + 0.5) AS effectiveness FROM h""")
def health(t):
    share = lambda holds: F.count_if(holds) * 100.0 / F.count("*")
    h = t.entity_facts.groupBy(c("file_id").alias("module")).agg(
        share(c("changes") > 0).alias("coverage"), share(c("callers") == 0).alias("mocks"), F.count_if(c("complexity") > 45).alias("flaky"),
        F.avg("callers").alias("depth"), F.count_if(c("changes") > 40).alias("risky"),
    )
    return h.select(
        "module", C.test_health(c("coverage"), c("mocks"), c("flaky"), c("depth"), c("risky")).alias("health"),
        C.test_effectiveness(c("mocks"), c("mocks"), c("coverage")).alias("effectiveness"),
    )


@plan("r8_groups", "SELECT id, CASE WHEN complexity * 2 >= 80 THEN 'revenue-critical' WHEN complexity * 2 >= 60 THEN 'user-facing' ELSE 'other' END AS grp FROM functions")
def groups(t):
    return t.functions.select("id", C.criticality_group(c("complexity") * 2).alias("grp"))


@plan("r9_warnings", f"""WITH {TOUCHED}, e AS (SELECT entity, count(DISTINCT source) AS experts, count(*) AS changes, count(*) FILTER (WHERE {FAILED}) AS incidents FROM touched GROUP BY entity)
SELECT entity, concat_ws(',', CASE WHEN experts = 1 AND changes > 5 THEN 'BUS_FACTOR' END, CASE WHEN changes > 15 THEN 'HIGH_CHURN' END, CASE WHEN incidents > 0 THEN 'INCIDENT_PRONE' END) AS warnings FROM e""")
def warnings(t):
    who = C.by_entity(t.ledger).groupBy("entity").agg(F.countDistinct("source").alias("experts"), F.count("*").alias("changes"))
    e = who.join(C.incidents(t.ledger), "entity", "left").withColumn("incidents", F.coalesce("incidents", F.lit(0)))
    return e.select("entity", F.array_join(C.warnings(c("experts"), c("changes"), c("changes"), c("incidents")), ",").alias("warnings"))


@plan("r9_had_incident", f"""WITH {TOUCHED}, i AS (SELECT entity, max(touched."at") AS last FROM touched WHERE {FAILED} GROUP BY entity)
SELECT seq, t.entity, COALESCE(last > t.at, FALSE) AS had_incident FROM touched t LEFT JOIN i ON i.entity = t.entity WHERE event_type = 'purchase'""")
def had_incident(t):
    changes = C.by_entity(t.ledger.filter("event_type = 'purchase'")).select("seq", "entity", "at")
    return C.had_incident(changes, C.incidents(t.ledger)).select("seq", "entity", "had_incident")
