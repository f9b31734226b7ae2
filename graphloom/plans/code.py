"""Readings of code's text, learnt rules, answers, orders and upkeep of the ledger."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators import code as K
from graphloom.operators import graph as G
from graphloom.operators import ledger as L
from graphloom.operators import memory as M
from graphloom.operators import search as S
from graphloom.plans.registry import Plans
from graphloom.sources.tables import Catalog
from graphloom.storage import shared_folder

PLANS = Plans()
plan = PLANS.plan
c = F.col


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


MARKS = ", ".join(f"({i}, {_sql(m.lower())}, {_sql(k)}, {_sql(s)})" for i, (m, k, s) in enumerate(K.MARKS))
CALLS = "concat(event_type, CASE seq % 6 WHEN 0 THEN '.Query(x)' WHEN 1 THEN '(fs.readFile)' WHEN 2 THEN '.sendAll()' WHEN 3 THEN 'this.setName' WHEN 4 THEN '()' ELSE 'Worker.emit()' END)"


@plan("x10_categories", f"""
WITH k AS (SELECT seq, lower({CALLS}) AS call FROM ledger),
m AS (SELECT seq, arg_min(category, n) AS category, arg_min(confidence, n) AS confidence FROM k JOIN (VALUES {MARKS}) p(n, mark, category, confidence) ON contains(call, mark) GROUP BY seq)
SELECT k.seq, COALESCE(m.category, CASE WHEN contains(call, 'set') AND (contains(call, 'this.') OR contains(call, 'self.')) THEN 'mutation-this'
  WHEN regexp_matches(call, 'write|save|store') THEN 'io-file' WHEN regexp_matches(call, 'send|post|push') THEN 'io-network' WHEN regexp_matches(call, 'delete|remove|destroy') THEN 'io-database' END) AS category,
  COALESCE(m.confidence, CASE WHEN contains(call, 'set') AND (contains(call, 'this.') OR contains(call, 'self.')) THEN 'medium'
  WHEN regexp_matches(call, 'write|save|store|send|post|push|delete|remove|destroy') THEN 'low' END) AS confidence
FROM k LEFT JOIN m ON k.seq = m.seq""")
def categories(t):
    """A category for each call's text, by the whole table of marks."""
    rows = t.ledger.select("seq", K.effect(F.expr(CALLS)).alias("e"))
    return rows.select("seq", "e.category", "e.confidence")


@plan("x10_risk", """
WITH k AS (SELECT session_id AS entity, CASE event_type WHEN 'purchase' THEN 'io-database' WHEN 'click' THEN 'async-spawn' ELSE 'io-console' END AS category, value > 50 AS conditional FROM ledger),
n AS (SELECT entity, count(*) FILTER (WHERE category = 'io-database') AS s, count(*) FILTER (WHERE category = 'async-spawn') AS m, count(*) FILTER (WHERE NOT COALESCE(conditional, false)) AS a FROM k GROUP BY entity)
SELECT entity, CASE WHEN s >= 2 OR s = 1 AND a >= 2 THEN 'high' WHEN s >= 1 OR m >= 2 OR a >= 3 THEN 'medium' ELSE 'low' END AS level FROM n""")
def effect_risk(t):
    kind = F.when(c("event_type") == "purchase", "io-database").when(c("event_type") == "click", "async-spawn").otherwise("io-console")
    return K.effect_risk(t.ledger.select(c("session_id").alias("entity"), kind.alias("category"), (c("value") > 50).alias("conditional")))


BODY = "concat('if (a && b) { // while\n return ', CASE id % 4 WHEN 0 THEN 'null' WHEN 1 THEN '1' WHEN 2 THEN '\"if\"' ELSE 'x ? y : z' END, '; } ', CASE id % 3 WHEN 0 THEN 'for (;;) { throw e }' WHEN 1 THEN 'return [1]' ELSE '' END)"


@plan("f10_complexity", "SELECT id, CAST(3 + CASE WHEN id % 4 = 3 THEN 1 ELSE 0 END + CASE WHEN id % 3 = 0 THEN 1 ELSE 0 END AS INT) AS score FROM functions")
def complexity(t):
    return t.functions.select("id", K.complexity(F.expr(BODY.replace("\n", "\\n"))).alias("score"))


@plan("x08_returns", """
WITH k AS (SELECT id, CASE id % 4 WHEN 0 THEN 'null' WHEN 1 THEN 'number' WHEN 2 THEN 'string' ELSE 'unknown' END AS one, id % 3 = 1 AS two FROM functions)
SELECT id, CASE WHEN two THEN 2 ELSE 1 END AS points, CASE WHEN NOT two THEN one WHEN one = 'unknown' THEN 'array' ELSE one || ' | array' END AS inferred_type, one = 'null' AS can_be_null, false AS always_throws FROM k""")
def returns(t):
    rows = t.functions.select("id", F.expr(BODY.replace("\n", "\\n")).alias("body"))
    return K.returns(rows).drop("body")


@plan("x07_parameters", """
SELECT id, CASE id % 5 WHEN 0 THEN 'callback' WHEN 1 THEN 'config' WHEN 2 THEN 'context' WHEN 3 THEN 'input' ELSE 'output' END AS purpose,
  CASE id % 5 WHEN 0 THEN 'non-null' WHEN 1 THEN 'must be string' WHEN 2 THEN 'non-empty' WHEN 3 THEN 'positive' END AS rule FROM functions""")
def parameters(t):
    pick = lambda *values: F.get(F.array(*map(F.lit, values)), (c("id") % 5).cast("int"))
    name = pick("onClose", "buildOptions", "x", "other", "Result")
    kind = pick(None, "", "AppContext", "number", "string")
    condition = pick("x !== null", "typeof x === 'string'", "x.length > 0", "x > 0", "x")
    return t.functions.select("id", K.parameter_purpose(name, kind).alias("purpose"), K.validation_rule(condition).alias("rule"))


@plan("a38_conventions", """
WITH f AS (SELECT replace(name, ' ', '_') AS name FROM functions)
SELECT count(*) FILTER (WHERE regexp_full_match(name, '[a-z][a-zA-Z0-9]*')) AS camel, count(*) FILTER (WHERE regexp_full_match(name, '[a-z][a-z0-9]*(_[a-z0-9]+)*')) AS snake,
  CASE WHEN count(*) FILTER (WHERE regexp_full_match(name, '[a-z][a-z0-9]*(_[a-z0-9]+)*')) > count(*) FILTER (WHERE regexp_full_match(name, '[a-z][a-zA-Z0-9]*')) THEN 'snake_case' ELSE 'camelCase' END AS functions,
  (SELECT count(*) FILTER (WHERE regexp_matches(name, '^I[A-Z]')) > count(*) * 0.5 FROM interfaces) AS interface_prefix FROM f""")
def conventions(t):
    return K.conventions(t.functions.select(F.replace("name", F.lit(" "), F.lit("_")).alias("name")), t.interfaces)


@plan("f04_names", "SELECT seq, concat(event_type, '_of_user') AS snake, concat(event_type, 'OfUser') AS camel FROM ledger")
def names(t):
    snake = T.snake_case(F.concat("event_type", F.lit("OfUser")))
    return t.ledger.select("seq", snake.alias("snake"), T.camel_case(snake).alias("camel"))


@plan("x21_corrections", """
SELECT id, 'file' AS scope, 'convention' AS category, 'file-pattern' AS trigger_kind, '*.ts' AS trigger, concat('Prefer "let b = ', name, '" over "var b = ', name, '"') AS rule, 'user-correction' AS source,
  0.6::DOUBLE AS confidence FROM functions WHERE id % 2 = 0""")
def corrections(t):
    text = lambda word: F.concat(F.lit("a()\n  "), word, F.lit(" b = "), c("name"), F.lit("\nc()"))
    rows = t.functions.select("id", text(F.lit("var")).alias("before"), text(F.when(c("id") % 2 == 0, "let").otherwise("var")).alias("after"), F.lit("src/a.b/x.ts").alias("path"))
    return M.from_changes(rows, ["id"])


@plan("x21_failures", """
SELECT seq, 'project' AS scope, 'anti-pattern' AS category, 'code-pattern' AS trigger_kind, CASE event_type WHEN 'click' THEN 'import.*from' ELSE '\\w+\\(' END AS trigger,
  CASE event_type WHEN 'click' THEN 'Verify module paths and ensure dependencies are installed' ELSE 'Verify function exists before calling' END AS rule, 'build-failure' AS source, 0.5::DOUBLE AS confidence
FROM ledger WHERE event_type IN ('click', 'view')""")
def failures(t):
    message = F.when(c("event_type") == "click", "Cannot find module './a'").when(c("event_type") == "view", "f is not a function").otherwise("other")
    return M.from_failures(t.ledger.select("seq", message.alias("message")), ["seq"])


@plan("x21_instructions", """
SELECT id, 'project' AS scope, 'style' AS category, 'context-keyword' AS trigger_kind, 'prefer|small|functions' AS trigger, concat('Always prefer small functions like ', name) AS rule, 'explicit-instruction' AS source,
  0.9::DOUBLE AS confidence FROM functions""")
def instructions(t):
    rows = t.functions.select("id", F.concat(F.lit("Always prefer small functions like "), "name").alias("instruction"), F.lit("project").alias("scope"), F.lit("style").alias("category"))
    return M.from_instructions(rows, ["id"])


@plan("x20_answers", """
WITH k AS (SELECT id, feature, confidence, pending, id % 3 AS r FROM justifications),
a AS (SELECT *, CASE r WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS n FROM k), s AS (SELECT *, CASE WHEN n = 0 THEN confidence ELSE least(1.0, confidence + 0.3 * n) END AS score FROM a)
SELECT id, CASE WHEN r = 0 THEN 'told' END AS purpose, 'v' AS business_value, feature, CASE WHEN n > 0 THEN 'naming: x-y' END AS detail, round(score, 6) AS confidence,
  CASE WHEN round(score, 9) >= 0.8 THEN 'high' WHEN round(score, 9) >= 0.5 THEN 'medium' WHEN round(score, 9) >= 0.3 THEN 'low' ELSE 'uncertain' END AS level, CASE WHEN n = 0 THEN pending ELSE r <> 0 OR score < 0.5 END AS pending FROM s""")
def answers(t):
    j = t.justifications
    rows = j.select("id", F.lit(None).cast("string").alias("purpose"), F.lit("v").alias("business_value"), "feature", F.lit(None).cast("string").alias("detail"), "confidence", "pending")
    told = lambda kind, answer: j.select(F.concat(c("id").cast("string"), F.lit("-" + kind)).alias("question"), F.lit(answer).alias("answer"))
    given = told("purpose", "told").filter(F.split("question", "-")[0].cast("long") % 3 == 0).unionAll(told("naming", "x-y").filter(F.split("question", "-")[0].cast("long") % 3 != 2))
    found = M.apply_answers(rows.withColumn("confidence", F.round("confidence", 6)), given)
    return found.withColumn("confidence", F.round("confidence", 6))


@plan("g10_order")
def dependency_order(t):
    nodes = t.files.select("id")
    return G.dependency_order(t.imports.select("from_id", "to_id"), nodes)


@plan("v06_cohesion")
def cohesion(t):
    v = t.embeddings.select(c("vec_id").alias("id"), "embedding")
    return S.cohesion(S.cosine_clusters(v, 0.3))


@plan("t08_merged")
def merged(t):
    """Sessions as clusters, similar as their vectors are."""
    sessions = t.ledger.groupBy(c("session_id").alias("id")).agg(F.count("*").alias("events"), F.max("event_type").alias("intent"), F.lit(0.5).alias("confidence"))
    v = t.embeddings.select(c("vec_id").alias("id"), "embedding").join(sessions.select("id"), "id", "left_semi")
    return L.merge_clusters(sessions, S.cosine_clusters(v, 0.35))


@plan("t07_retention", 'WITH o AS (SELECT session_id FROM ledger GROUP BY session_id HAVING max(ledger."at") >= 0.99 * (SELECT max(ledger."at") FROM ledger)) SELECT seq, session_id FROM ledger WHERE session_id IN (SELECT session_id FROM o)')
def retention(t):
    """One run over a catalogue, which ends the sessions that have been silent for the last hundredth of the time; what stays."""
    catalog = Catalog(t.spark, f"{shared_folder(t.spark)}/retention-{uuid.uuid4().hex}")
    catalog.replace("ledger", t.ledger.select("seq", "at", "session_id", "event_type", "source", "files", "entity_ids"))
    last = catalog("ledger").agg(F.max("at")).first()[0] or 0.0
    L.maintain(catalog, "ledger", "compacted", 0.99 * last)
    return catalog("ledger").select("seq", "session_id")


@plan("s17_tables", "SELECT 'files' AS name UNION ALL SELECT 'functions'")
def table_names(t):
    """The catalogue's listing."""
    catalog = Catalog(t.spark, f"{shared_folder(t.spark)}/names-{uuid.uuid4().hex}")
    catalog.write_batch({"functions": t.functions.select("id"), "files": t.files.select("id")}, {"functions": ["id"], "files": ["id"]})
    return t.spark.createDataFrame([(n,) for n in catalog.names()], "name string")
