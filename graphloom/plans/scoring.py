"""Scores and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import numeric as N
from graphloom.functions import text as T
from graphloom.operators import ledger as L
from graphloom.operators import reports as R
from graphloom.operators import windows as W
from graphloom.plans.analytics import R6, r6
from graphloom.plans.registry import Plans

PLANS = Plans()
plan = PLANS.plan
c = F.col

COMPLEXITY = "CASE WHEN complexity = 0 THEN 0.3 WHEN complexity <= 5 THEN 0.1 WHEN complexity <= 10 THEN 0.3 WHEN complexity <= 20 THEN 0.5 WHEN complexity <= 30 THEN 0.7 ELSE 1.0 END"
CALLERS = "CASE WHEN callers <= 2 THEN 0.1 WHEN callers <= 5 THEN 0.3 WHEN callers <= 10 THEN 0.5 WHEN callers <= 20 THEN 0.7 ELSE 1.0 END"
CHURN = "CASE WHEN changes <= 1 THEN 0.1 WHEN changes <= 3 THEN 0.3 WHEN changes <= 5 THEN 0.5 WHEN changes <= 10 THEN 0.7 ELSE 1.0 END"
SURE = "CASE WHEN confidence IS NULL THEN 0.5 WHEN confidence >= 0.9 THEN 0.1 WHEN confidence >= 0.7 THEN 0.3 WHEN confidence >= 0.5 THEN 0.5 ELSE 0.8 END"
RISK = f"""CAST(floor(100 * ((CASE WHEN layer = 'domain' THEN 0.8 ELSE 0.3 END)::DOUBLE * 0.30::DOUBLE + ({COMPLEXITY})::DOUBLE * 0.25::DOUBLE
  + ({CALLERS})::DOUBLE * 0.20::DOUBLE + ({CHURN})::DOUBLE * 0.15::DOUBLE + ({SURE})::DOUBLE * 0.10::DOUBLE) + 0.5) AS BIGINT)"""


def facts(t):
    return t.entity_facts


@plan("r1_risk", f"WITH s AS (SELECT id, {RISK} AS score FROM entity_facts) SELECT id, score, CASE WHEN score >= 70 THEN 'HIGH' WHEN score >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM s")
def risk(t):
    score = R.risk_score(c("layer") == "domain", c("complexity"), c("callers"), c("changes"), c("confidence"))
    return facts(t).select("id", score.cast("long").alias("score")).withColumn("level", R.risk_level(c("score")))


@plan("r2_bus_factor", """
WITH n AS (SELECT module, author, count(*) AS n FROM commits GROUP BY ALL),
k AS (SELECT *, COALESCE(sum(n) OVER (PARTITION BY module ORDER BY n DESC, author ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n) OVER (PARTITION BY module) AS total FROM n),
b AS (SELECT module, count(*) FILTER (WHERE before * 100 < total * 80) AS bus_factor, min_by(author, (-n, author)) AS primary_author FROM k GROUP BY module)
SELECT f.id AS module, COALESCE(bus_factor, 0) AS bus_factor, primary_author, CASE WHEN COALESCE(bus_factor, 0) <= 1 THEN 'CRITICAL' WHEN bus_factor <= 2 THEN 'MODERATE' ELSE 'HEALTHY' END AS risk
FROM files f LEFT JOIN b ON f.id = b.module""")
def bus_factor(t):
    n = t.commits.groupBy("module", "author").agg(F.count("*").alias("n"))
    b = W.bus_factor(n, "module", "author", "n").join(n.groupBy("module").agg(F.min_by("author", F.struct(-c("n"), "author")).alias("primary_author")), "module")
    factor = F.coalesce("bus_factor", F.lit(0))
    return t.files.select(c("id").alias("module")).join(b, "module", "left").select("module", factor.alias("bus_factor"), "primary_author", R.bus_risk(factor).alias("risk"))


LAYER = """CASE WHEN layer = 'domain' THEN CASE WHEN area LIKE '%payment%' THEN 'revenue-critical' WHEN area LIKE '%user%' OR area LIKE '%dashboard%' THEN 'user-facing' ELSE 'internal' END
  WHEN layer = 'infrastructure' THEN 'infrastructure' ELSE 'unknown' END"""


@plan("r3_coverage", f"""
WITH l AS (SELECT {LAYER} AS l, complexity <= 3 OR (complexity < 10 AND callers > 2) OR id % 10 < 6 AS tested FROM entity_facts),
s AS (SELECT l AS layer, count(*) AS total, count(*) FILTER (WHERE tested) AS tested FROM l GROUP BY l),
p AS (SELECT *, CAST(floor(tested * 100.0 / total + 0.5) AS BIGINT) AS percentage, CASE layer WHEN 'revenue-critical' THEN 95 WHEN 'user-facing' THEN 80 WHEN 'internal' THEN 70 ELSE 50 END AS target FROM s)
SELECT layer, total, tested, percentage, CASE WHEN percentage >= target THEN 'healthy' WHEN percentage >= target - 15 THEN 'warning' ELSE 'critical' END AS status FROM p""")
def coverage(t):
    layer = R.layer(c("layer") == "domain", c("layer") == "infrastructure", c("area"))
    tested = (c("complexity") <= 3) | ((c("complexity") < 10) & (c("callers") > 2)) | (c("id") % 10 < 6)
    s = facts(t).select(layer.alias("layer"), tested.alias("ok")).groupBy("layer").agg(F.count("*").alias("total"), F.count_if("ok").alias("tested"))
    target = F.create_map(*[F.lit(x) for kv in R.TARGETS.items() for x in kv])[c("layer")]
    p = s.withColumn("percentage", N.half_up(N.percent(c("tested"), c("total"))))
    return p.withColumn("status", R.coverage_status(c("percentage"), target))


WEIGHT = "CASE WHEN layer = 'domain' THEN 1.5 WHEN layer = 'infrastructure' THEN 0.5 ELSE 1.0 END"


@plan("r4_debt", f"""
WITH f AS (SELECT *, CAST(complexity * greatest(1.0, changes) * {WEIGHT} AS DOUBLE) AS friction FROM entity_facts),
m AS (SELECT *, friction / avg(friction) OVER () AS multiple, CASE WHEN complexity > 30 THEN 5 WHEN complexity > 20 THEN 3 WHEN complexity > 10 THEN 2 ELSE 1 END + CASE WHEN callers > 20 THEN 2 WHEN callers > 10 THEN 1 ELSE 0 END AS effort FROM f)
SELECT id, effort, {R6.format('friction')} AS friction, {R6.format('multiple')} AS multiple, {R6.format('0.5 * log2(friction + 1) / 3 * changes')} AS hours FROM m""")
def debt(t):
    weight = F.when(c("layer") == "domain", 1.5).when(c("layer") == "infrastructure", 0.5).otherwise(1.0)
    f = facts(t).withColumn("friction", R.friction(c("complexity"), c("changes"), weight))
    m = W.over_mean(f, "friction", "multiple")
    return m.select(
        "id", R.effort(c("complexity"), c("callers")).alias("effort"), r6(c("friction")).alias("friction"), r6(c("multiple")).alias("multiple"),
        r6(R.monthly_hours(c("friction"), c("changes"))).alias("hours"),
    )


@plan("r5_pull_request", f"""
WITH p AS (SELECT file_id AS pr, count(*) FILTER (WHERE layer = 'domain') * 100.0 / count(*) AS share, CAST(sum(callers) AS BIGINT) AS callers, count(*) FILTER (WHERE changes > 25) AS incidents, max(changes) AS author, avg(complexity) AS complexity FROM entity_facts GROUP BY file_id),
b AS (SELECT pr, 30 + CASE WHEN share > 80 THEN 20 WHEN share > 50 THEN 12 ELSE 5 END + CASE WHEN callers > 30 THEN 15 WHEN callers > 10 THEN 8 ELSE 3 END + CASE WHEN incidents > 2 THEN 15 WHEN incidents > 0 THEN 8 ELSE 0 END
  + CASE WHEN author < 3 THEN 10 WHEN author < 10 THEN 5 ELSE -5 END + CASE WHEN complexity > 20 THEN 10 WHEN complexity > 10 THEN 5 ELSE 0 END AS base FROM p)
SELECT pr, base, CAST(least(100, floor(base * sqrt(1.5 * 1.2) + 0.5)) AS BIGINT) AS score FROM b""")
def pull_request(t):
    p = facts(t).groupBy(c("file_id").alias("pr")).agg(
        N.percent(F.count_if(c("layer") == "domain"), F.count("*")).alias("share"), F.sum("callers").alias("callers"),
        F.count_if(c("changes") > 25).alias("incidents"), F.max("changes").alias("author"), F.avg("complexity").alias("complexity"),
    )
    b = p.select("pr", R.pull_request_factors(c("share"), c("callers"), c("incidents"), c("author"), c("complexity")).alias("base"))
    return b.withColumn("score", R.pull_request_score(c("base"), F.lit(1.5), F.lit(1.2)).cast("long"))


@plan("r6_day0", """
WITH h AS (SELECT count(*) FILTER (WHERE complexity <= 10) * 100 // count(*) AS simple, count(*) FILTER (WHERE changes >= 30 AND complexity >= 45) AS hot FROM entity_facts),
g AS (SELECT count(*) AS gods FROM (SELECT file_id FROM functions GROUP BY file_id HAVING sum(complexity) > 25 AND count(*) > 8) x)
SELECT CAST(least(100, floor(simple * 1.2 + 0.5)) AS BIGINT) AS simplicity, greatest(0, 100 - gods * 15) AS gods, greatest(0, 100 - hot * 20) AS stability FROM h, g""")
def day0(t):
    h = facts(t).agg(
        F.floor(F.count_if(c("complexity") <= 10) * 100 / F.count("*")).alias("simple"), F.count_if((c("changes") >= 30) & (c("complexity") >= 45)).alias("hot")
    )
    g = t.functions.groupBy("file_id").agg(F.sum("complexity").alias("s"), F.count("*").alias("n")).filter("s > 25 AND n > 8").agg(F.count("*").alias("g"))
    return h.crossJoin(F.broadcast(g)).select(
        F.least(F.lit(100), N.half_up(c("simple") * 1.2)).cast("long").alias("simplicity"),
        F.greatest(F.lit(0), 100 - c("g") * 15).alias("gods"), F.greatest(F.lit(0), 100 - c("hot") * 20).alias("stability"),
    )


@plan("r6_god_modules", """
SELECT file_id, count(*) AS functions, CAST(sum(complexity) AS BIGINT) AS complexity, CASE WHEN sum(complexity) / 30.0 + count(*) / 15.0 > 2 THEN 'CRITICAL' WHEN sum(complexity) / 30.0 + count(*) / 15.0 > 1.3 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM functions GROUP BY file_id HAVING sum(complexity) > 25 AND count(*) > 8""")
def god_modules(t):
    g = t.functions.groupBy("file_id").agg(F.count("*").alias("functions"), F.sum("complexity").alias("complexity")).filter("complexity > 25 AND functions > 8")
    return g.withColumn("severity", R.god_class(c("complexity"), c("functions")))


@plan("r7_test_quality", """
WITH t AS (SELECT id, (id % 10) / 10.0 AS strong, (id % 7) / 7.0 AS mocks, (id % 4) / 4.0 AS match, id % 3 = 0 AS errors, id % 5 = 0 AS snap FROM functions),
s AS (SELECT id, greatest(0, least(100, 100 - (CASE WHEN strong < 0.3 THEN 30 WHEN strong < 0.5 THEN 15 WHEN strong < 0.7 THEN 5 ELSE 0 END + CASE WHEN mocks > 0.8 THEN 25 WHEN mocks > 0.5 THEN 10 ELSE 0 END
  + CASE WHEN match < 0.2 THEN 20 WHEN match < 0.5 THEN 10 ELSE 0 END + CASE WHEN errors THEN 0 ELSE 10 END + CASE WHEN snap THEN 15 ELSE 0 END))) AS score FROM t)
SELECT id, score, CASE WHEN score >= 70 THEN 'VALID' WHEN score >= 40 THEN 'SUSPICIOUS' ELSE 'COVERAGE_PADDING' END AS verdict FROM s""")
def test_quality(t):
    i = c("id")
    score = R.test_quality(i % 10 / 10.0, i % 7 / 7.0, i % 4 / 4.0, i % 3 == 0, i % 5 == 0)
    return t.functions.select("id", score.alias("score")).withColumn("verdict", R.test_verdict(c("score")))


@plan("r8_criticality", """
SELECT id, least(100, greatest(0, 50 + CASE WHEN layer = 'domain' THEN 25 + CASE WHEN area LIKE '%payment%' THEN 20 WHEN area LIKE '%user%' THEN 10 ELSE 0 END WHEN layer = 'infrastructure' THEN -15 ELSE 0 END
  + CASE WHEN confidence > 0.8 THEN 8 ELSE 0 END + CASE WHEN name LIKE '%revenue%' OR name LIKE '%payment%' OR name LIKE '%critical%' OR name LIKE '%transaction%' THEN 12 ELSE 0 END + least(15, (callers % 4) * 5))) AS score FROM entity_facts""")
def criticality(t):
    score = R.criticality(c("layer") == "domain", c("layer") == "infrastructure", c("area"), c("confidence"), c("name"), c("callers") % 4)
    return facts(t).select("id", score.alias("score"))


@plan("r8_friction", """
SELECT id, floor(greatest(1.0, complexity / (SELECT avg(complexity) FROM functions)) * greatest(1.0, changes / 5.0) * 10 + 0.5) / 10 AS friction FROM entity_facts WHERE changes > 0""")
def friction(t):
    mean = F.broadcast(t.functions.agg(F.avg("complexity").alias("mean")))
    return facts(t).filter("changes > 0").crossJoin(mean).select("id", R.modification_friction(c("complexity"), c("changes"), c("mean")).alias("friction"))


@plan("r9_context", """
WITH top AS (SELECT id, 2 * complexity + callers AS weight FROM entity_facts ORDER BY weight DESC, id LIMIT 10),
n AS (SELECT entity, author, count(*) AS n FROM commits WHERE entity IN (SELECT id FROM top) GROUP BY ALL)
SELECT entity, author, n, CAST(row_number() OVER (PARTITION BY entity ORDER BY n DESC, author) AS INT) AS rank FROM n QUALIFY rank <= 3""")
def context(t):
    top = facts(t).select("id", (2 * c("complexity") + c("callers")).alias("weight")).orderBy(F.desc("weight"), "id").limit(10)
    n = t.commits.join(top.select(c("id").alias("entity")), "entity", "left_semi").groupBy("entity", "author").agg(F.count("*").alias("n"))
    return W.top_per_group(n, ["entity"], [F.desc("n"), c("author")], 3)


@plan("r11_slices", "SELECT a.layer AS from_feature, b.layer AS to_feature, count(*) AS edges FROM calls x JOIN functions a ON x.from_id = a.id JOIN functions b ON x.to_id = b.id WHERE a.layer <> b.layer GROUP BY ALL")
def slices(t):
    from graphloom.operators.joins import across

    return across(t.calls, t.functions.select("id", c("layer").alias("feature")))


@plan("r12_health", """
WITH n AS (SELECT (SELECT count(*) FROM files) AS files, (SELECT count(DISTINCT file_id) FROM functions) AS covered)
SELECT files, covered, CASE WHEN covered = files THEN 'healthy' WHEN covered * 2 >= files THEN 'partial' ELSE 'stale' END AS status FROM n""")
def health(t):
    covered = t.functions.agg(F.countDistinct("file_id").alias("covered"))
    n = t.files.agg(F.count("*").alias("files")).crossJoin(F.broadcast(covered))
    state = F.when(c("covered") == c("files"), "healthy").when(c("covered") * 2 >= c("files"), "partial").otherwise("stale")
    return n.withColumn("status", state)


@plan("r14_timeline", "SELECT seq, CASE WHEN 2 * len(files) + len(entity_ids) + 3 * (seq % 7) > 20 THEN 'high' WHEN 2 * len(files) + len(entity_ids) + 3 * (seq % 7) > 5 THEN 'medium' ELSE 'low' END AS impact FROM ledger")
def timeline(t):
    return t.ledger.select("seq", L.impact(F.size("files"), F.size("entity_ids"), c("seq") % 7).alias("impact"))


@plan("f06_packages", """
SELECT id, CASE id % 3 WHEN 0 THEN 'fs' WHEN 1 THEN '@scope/pkg' ELSE 'lodash' END AS package FROM functions""")
def packages(t):
    spec = F.when(c("id") % 3 == 0, "node:fs").when(c("id") % 3 == 1, "@scope/pkg/deep").otherwise("lodash/fp")
    return t.functions.select("id", T.package_name(spec).alias("package"))


@plan("f07_module_path", "SELECT id, array_to_string(list_slice(string_split(path, '/'), 1, 3), '/') AS module FROM files")
def module_path(t):
    return t.files.select("id", T.module_path(c("path")).alias("module"))


@plan("f09_tokens", "SELECT doc_id, CAST(ceil(length(text) / 3.5) AS BIGINT) AS tokens FROM documents")
def tokens(t):
    return t.documents.select("doc_id", T.token_estimate(c("text")).alias("tokens"))


@plan("f11_entity_id", "SELECT id, substr(sha256(concat_ws(':', file_id, 'function', name)), 1, 16) AS entity_id FROM functions")
def entity_id(t):
    return t.functions.select("id", T.entity_id(c("file_id"), F.lit("function"), F.lit(""), c("name")).alias("entity_id"))


@plan("f14_strength", f"""
SELECT seq, {R6.format('least(1.0, 0.3 * (seq % 3) / 2.0 + 0.5 * (seq % 5) / 4.0 + 0.2 * (1 - (seq % 60) / 60.0))')} AS strength, CASE WHEN seq % 4 = 1 THEN 'query-led-to-creation' WHEN seq % 6 = 1 THEN 'query-led-to-deletion' ELSE 'query-led-to-edit' END AS kind FROM ledger""")
def strength(t):
    s = c("seq")
    kind = L.correlation_kind(F.when(s % 4 == 1, 1).otherwise(0), F.when(s % 6 == 1, 1).otherwise(0))
    return t.ledger.select("seq", r6(L.correlation_strength(s % 3 / 2.0, s % 5 / 4.0, s % 60, 60.0)).alias("strength"), kind.alias("kind"))


@plan("f18_frequency", """
SELECT id, CASE WHEN changes * 7.0 / 30 >= 7 THEN 'Daily or more' WHEN changes * 7.0 / 30 >= 3 THEN 'Several times per week' WHEN changes * 7.0 / 30 >= 1 THEN 'Weekly' WHEN changes * 7.0 / 30 >= 0.5 THEN 'Bi-weekly' ELSE 'Monthly or less' END AS frequency FROM churn""")
def frequency(t):
    return t.churn.select("id", R.change_frequency(c("changes")).alias("frequency"))


@plan("f22_responsibilities", """
SELECT conv_id, turn, array_to_string(CASE WHEN len(r) = 0 THEN ['General Purpose'] ELSE r END, ',') AS found FROM (SELECT conv_id, turn, list_filter([
  CASE WHEN regexp_matches(lower(text), 'get|fetch|load') THEN 'Data Retrieval' END, CASE WHEN regexp_matches(lower(text), 'set|update|save') THEN 'Data Mutation' END,
  CASE WHEN regexp_matches(lower(text), 'validate|check|verify') THEN 'Validation' END, CASE WHEN regexp_matches(lower(text), 'render|display|show') THEN 'Presentation' END,
  CASE WHEN regexp_matches(lower(text), 'handle|process|execute') THEN 'Business Logic' END, CASE WHEN regexp_matches(lower(text), 'log|track|record') THEN 'Logging/Tracking' END,
  CASE WHEN regexp_matches(lower(text), 'send|notify|emit') THEN 'Communication' END, CASE WHEN regexp_matches(lower(text), 'parse|transform|convert') THEN 'Data Transformation' END], lambda x: x IS NOT NULL) AS r FROM conversations) y""")
def responsibilities(t):
    return t.conversations.select("conv_id", "turn", F.array_join(T.responsibilities(c("text")), ",").alias("found"))


@plan("f23_commit_intent", """
SELECT seq, CASE seq % 4 WHEN 0 THEN 'feature-development' WHEN 1 THEN 'bug-fix' WHEN 2 THEN 'refactoring' ELSE 'unknown' END AS intent FROM ledger""")
def commit_intent(t):
    m = F.element_at(F.array(F.lit("Feat: add"), F.lit("FIX(ui): repair"), F.lit("core(refactor): move"), F.lit("bump")), (c("seq") % 4 + 1).cast("int"))
    return t.ledger.select("seq", T.commit_intent(m).alias("intent"))


@plan("f24_bloom", f"""
SELECT id, CAST(ceil(-size * ln(0.01) / (ln(2.0) * ln(2.0))) AS BIGINT) AS bits, {R6.format('pow(1 - exp(-3.0 * size / 100000.0), 3.0)')} AS rate FROM files""")
def bloom(t):
    return t.files.select("id", N.optimal_bits(c("size"), 0.01).alias("bits"), r6(N.false_positive_rate(100000, 3, c("size"))).alias("rate"))


@plan("f25_decay", f"SELECT id, {R6.format('changes * pow(0.95, callers / 2.0)')} AS heat FROM entity_facts")
def decay(t):
    return facts(t).select("id", r6(N.decayed(c("changes"), 0.95, c("callers"), 2.0)).alias("heat"))


@plan("f26_reinforced", f"""
SELECT id, {R6.format('greatest(0.0, least(1.0, confidence + (id % 4) * 0.1::DOUBLE) - (id % 3) * 0.15::DOUBLE)')} AS confidence, greatest(0.0, least(1.0, confidence + (id % 4) * 0.1::DOUBLE) - (id % 3) * 0.15::DOUBLE) >= 0.2::DOUBLE AS active FROM justifications""")
def reinforced(t):
    v = L.reinforced(c("confidence"), c("id") % 4, c("id") % 3)
    return t.justifications.select("id", r6(v).alias("confidence"), (v >= 0.2).alias("active"))


@plan("f27_half_up", "SELECT c_custkey, floor(c_acctbal / 100 + 0.5) AS hundreds FROM customer")
def half_up(t):
    return t.customer.select("c_custkey", N.half_up(c("c_acctbal") / 100).cast("double").alias("hundreds"))


@plan("f28_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json(t):
    return t.events.select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@plan("f31_routing", f"""
SELECT s_suppkey, {R6.format('s_acctbal / 10000 * 100 + (1 - least(s_suppkey * 100 / 5000.0, 1)) * 20 + (1 - least(s_nationkey / 1000.0 / 0.02, 1)) * 15 + least(s_suppkey * 9000 / 200000.0, 1) * 10 + CASE WHEN s_suppkey % 2 = 0 THEN 30 ELSE 0 END')} AS score FROM supplier""")
def routing(t):
    score = L.model_score(c("s_acctbal") / 10000, c("s_suppkey") % 2 == 0, c("s_suppkey") * 100, c("s_nationkey") / 1000.0, c("s_suppkey") * 9000, True)
    return t.supplier.select("s_suppkey", r6(score).alias("score"))


@plan("f32_adjustments", f"""
WITH s AS (SELECT event_type AS model, count(*) AS n, avg(CASE WHEN value < 30 THEN 1.0 ELSE 0.0 END) AS success, quantile_disc(value, 0.9) AS p90 FROM events GROUP BY event_type),
a AS (SELECT model, 0 AS rule, 'score-penalty' AS kind, least(30.0, (0.9 - success) * 50) AS value FROM s WHERE n >= 10 AND success < 0.9
  UNION ALL SELECT model, 1, 'score-penalty', least(15.0, (p90 / 60.0 - 1) * 10) FROM s WHERE n >= 10 AND p90 > 60
  UNION ALL SELECT model, 2, 'score-boost', least(20.0, (success - 0.95) * 200 + (1 - p90 / 60.0) * 10) FROM s WHERE n >= 10 AND success > 0.98 AND p90 < 30
  UNION ALL SELECT model, 3, 'disable', 0 FROM s WHERE n >= 20 AND success < 0.5)
SELECT model, CAST(rule AS INT) AS rule, kind, {R6.format('value')} AS value FROM a""")
def adjustments(t):
    s = t.events.groupBy(c("event_type").alias("model")).agg(
        F.count("*").alias("n"), F.avg(F.when(c("value") < 30, 1.0).otherwise(0.0)).alias("success_rate"), F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY value)").alias("p90")
    )
    return L.routing_adjustments(s, latency=60.0).select("model", "rule", "kind", r6(c("value")).alias("value"))
