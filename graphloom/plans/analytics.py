"""Aggregations, windows, ledger, sessions, statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from graphloom.functions import numeric as N
from graphloom.functions import text as T
from graphloom.operators import ledger as L
from graphloom.operators import windows as W
from graphloom.plans.registry import Plans

PLANS = Plans()
plan = PLANS.plan


def r6(x):
    """Both engines round the same way: halves up, at six digits."""
    return N.half_up_to(x, 6)


R6 = "floor(({}) * 1000000.0 + 0.5) / 1000000.0"


@plan("a01_counts", """
SELECT 'functions' AS relation, count(*) AS n FROM functions UNION ALL SELECT 'files', count(*) FROM files
UNION ALL SELECT 'calls', count(*) FROM calls UNION ALL SELECT 'imports', count(*) FROM imports UNION ALL SELECT 'externals', count(*) FROM externals""")
def counts(t):
    parts = [t(n).agg(F.count("*").alias("n")).select(F.lit(n).alias("relation"), "n") for n in ("functions", "files", "calls", "imports", "externals")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


@plan("a02_languages", "SELECT language, count(*) AS files FROM files GROUP BY language")
def languages(t):
    return t.files.groupBy("language").agg(F.count("*").alias("files"))


@plan("a03_most_called", """
SELECT f.id, f.name, x.path, c.callers FROM callers c JOIN functions f ON c.id = f.id JOIN files x ON f.file_id = x.id ORDER BY c.callers DESC, f.id LIMIT 20""")
def most_called(t):
    # The limit runs on the narrow counts; only the twenty rows are joined.
    top = t.calls.groupBy(F.col("to_id").alias("id")).agg(F.count("*").alias("callers")).orderBy(F.desc("callers"), "id").limit(20)
    from graphloom.operators.joins import with_path

    return with_path(top.join(t.functions.select("id", "name", "file_id"), "id"), t.files).select("id", "name", F.col("file_path").alias("path"), "callers")


@plan("a04_complexity", f"SELECT {R6.format('avg(complexity)')} AS mean, max(complexity) AS most, count(*) FILTER (WHERE complexity > 10) AS high FROM functions")
def complexity(t):
    return t.functions.agg(r6(F.avg("complexity")).alias("mean"), F.max("complexity").alias("most"), F.count_if(F.col("complexity") > 10).alias("high"))


@plan("a05_histogram", f"""
SELECT CAST(floor(complexity / 5.0) * 5 AS BIGINT) AS low, count(*) AS n, {R6.format('count(*) * 100.0 / (SELECT count(*) FROM functions)')} AS share FROM functions GROUP BY 1""")
def histogram(t):
    h = t.functions.groupBy((F.floor(F.col("complexity") / 5) * 5).alias("low")).agg(F.count("*").alias("n"))
    return h.withColumn("share", r6(N.percent(F.col("n"), F.sum("n").over(Window.partitionBy()))))


@plan("a06_ranges", """
SELECT CASE WHEN complexity <= 5 THEN '1-5' WHEN complexity <= 10 THEN '6-10' WHEN complexity <= 20 THEN '11-20' WHEN complexity <= 50 THEN '21-50' ELSE '51+' END AS bucket,
       count(*) AS n, min(id) AS example FROM functions GROUP BY 1""")
def ranges(t):
    bucket = N.steps(F.col("complexity"), [(5, "1-5"), (10, "6-10"), (20, "11-20"), (50, "21-50")], "51+")
    return t.functions.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.min("id").alias("example"))


@plan("a07_total_size", "SELECT CAST(sum(size) AS BIGINT) AS size FROM files")
def total_size(t):
    return t.files.agg(F.sum("size").alias("size"))


@plan("a08_packages", "SELECT package, count(*) AS users, CAST(sum(uses) AS BIGINT) AS uses FROM externals GROUP BY package ORDER BY users DESC, package LIMIT 20")
def packages(t):
    return t.externals.groupBy("package").agg(F.count("*").alias("users"), F.sum("uses").alias("uses")).orderBy(F.desc("users"), "package").limit(20)


@plan("a09_tiers", """
SELECT count(*) FILTER (WHERE confidence >= 0.8) AS high, count(*) FILTER (WHERE confidence >= 0.5 AND confidence < 0.8) AS medium,
       count(*) FILTER (WHERE confidence >= 0.3 AND confidence < 0.5) AS low, count(*) FILTER (WHERE confidence < 0.3) AS uncertain FROM justifications""")
def tiers(t):
    level = N.confidence_level(F.col("confidence"))
    return t.justifications.agg(*[F.count_if(level == x).alias(x) for x in ("high", "medium", "low", "uncertain")])


@plan("a10_coverage", f"SELECT {R6.format('(SELECT count(*) FROM labels) * 100.0 / count(*)')} AS coverage FROM documents")
def coverage(t):
    n = t.labels.agg(F.count("*").alias("n"))
    return t.documents.agg(F.count("*").alias("all")).crossJoin(F.broadcast(n)).select(r6(N.percent(F.col("n"), F.col("all"))).alias("coverage"))


@plan("a11_feature_areas", f"""
SELECT feature, count(*) AS n, {R6.format('avg(confidence)')} AS mean, array_to_string(list_slice(list_sort(list_distinct(flatten(list(tags)))), 1, 10), ',') AS tags
FROM justifications GROUP BY feature""")
def feature_areas(t):
    # The set is built of single tags, so a task's buffer holds each once.
    tags = t.justifications.select("feature", F.explode("tags").alias("tag")).groupBy("feature").agg(
        F.array_join(F.slice(F.array_sort(F.collect_set("tag")), 1, 10), ",").alias("tags")
    )
    sums = t.justifications.groupBy("feature").agg(F.count("*").alias("n"), r6(F.avg("confidence")).alias("mean"))
    return sums.join(tags, "feature").select("feature", "n", "mean", "tags")


@plan("a12_hotspots", f"""
SELECT file_id, count(*) AS n, count(*) FILTER (WHERE confidence < 0.5) AS low, count(*) FILTER (WHERE pending) AS pending, {R6.format('avg(confidence)')} AS mean
FROM justifications GROUP BY file_id""")
def hotspots(t):
    return t.justifications.groupBy("file_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("confidence") < 0.5).alias("low"), F.count_if("pending").alias("pending"), r6(F.avg("confidence")).alias("mean")
    )


@plan("a13_uncertain_features", f"""
SELECT feature, {R6.format('avg(confidence)')} AS mean, count(*) AS n FROM justifications WHERE feature NOT IN ('', 'General') GROUP BY feature ORDER BY mean, feature LIMIT 10""")
def uncertain_features(t):
    f = t.justifications.filter(~F.col("feature").isin("", "General")).groupBy("feature").agg(r6(F.avg("confidence")).alias("mean"), F.count("*").alias("n"))
    return f.orderBy("mean", "feature").limit(10)


@plan("a14_feature_map", """
SELECT feature, count(*) AS entities, count(DISTINCT file_id) AS files, count(*) FILTER (WHERE kind = 'en') AS en, count(*) FILTER (WHERE kind = 'fr') AS fr FROM justifications GROUP BY feature""")
def feature_map(t):
    return t.justifications.groupBy("feature").agg(
        F.count("*").alias("entities"), F.countDistinct("file_id").alias("files"), *[F.count_if(F.col("kind") == k).alias(k) for k in ("en", "fr")]
    )


@plan("a15_migration", """
SELECT feature, count(*) AS total, count(*) FILTER (WHERE list_contains(tags, 't3')) AS tagged FROM justifications GROUP BY ROLLUP (feature)""")
def migration(t):
    return t.justifications.rollup("feature").agg(F.count("*").alias("total"), F.count_if(F.array_contains("tags", "t3")).alias("tagged"))


@plan("a16_ledger_totals", f"""
SELECT event_type, source, count(*) AS n, {R6.format('avg(value)')} AS mean FROM ledger GROUP BY GROUPING SETS ((event_type), (source), ())""")
def ledger_totals(t):
    sums = [F.count("*").alias("n"), r6(F.avg("value")).alias("mean")]
    return t.ledger.groupingSets([["event_type"], ["source"], []], "event_type", "source").agg(*sums)


@plan("a16_hours", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, count(*) AS n FROM ledger GROUP BY 1")
def hours(t):
    return t.ledger.groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour").start.alias("w")).agg(F.count("*").alias("n")).select(
        F.date_format("w", "yyyy-MM-dd HH").alias("hour"), "n"
    )


@plan("a16_top_entities", "SELECT entity, count(*) AS n FROM (SELECT unnest(entity_ids) AS entity FROM ledger) x GROUP BY entity ORDER BY n DESC, entity LIMIT 10")
def top_entities(t):
    return t.ledger.select(F.explode("entity_ids").alias("entity")).groupBy("entity").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "entity").limit(10)


@plan("a18_compaction", """
WITH s AS (
  SELECT session_id, count(*) AS events, count(DISTINCT event_type) AS types, list_distinct(flatten(list(files))) AS fs,
         len(list_distinct(flatten(list(entity_ids)))) AS entities, bool_or(event_type = 'error') AS errors, bool_or(source = 'query') AS queries, bool_or(source = 'change') AS changes
  FROM ledger GROUP BY session_id HAVING count(*) >= 3),
f AS (SELECT *, len(list_filter(fs, lambda x: contains(x, 'test'))) > 0 AS test, len(list_filter(fs, lambda x: contains(x, 'config'))) > 0 AS config FROM s)
SELECT session_id, substr(sha256(CAST(session_id AS VARCHAR)), 1, 16) AS entry_id, events, CAST(types AS INT) AS types, CAST(len(fs) AS INT) AS files, CAST(entities AS INT) AS entities,
       CASE WHEN errors THEN 'debugging' WHEN test AND NOT config THEN 'testing' WHEN config AND NOT test THEN 'configuration' WHEN changes AND len(fs) > 0 THEN 'feature-development' ELSE 'unknown' END AS intent,
       floor((0.3 + CASE WHEN queries THEN 0.2 ELSE 0 END + CASE WHEN len(fs) > 0 THEN 0.15 ELSE 0 END + CASE WHEN changes THEN 0.15 ELSE 0 END) * 1000 + 0.5) / 1000 AS completeness
FROM f""")
def compaction(t):
    return L.compact(t.ledger, ["session_id"]).withColumn("completeness", N.half_up_to(F.col("completeness"), 3))


@plan("a21_rule_stats", """
SELECT kind AS scope, count(*) AS n, count(*) FILTER (WHERE confidence > 0.8) AS trusted, count(*) FILTER (WHERE id >= 900) AS recent FROM justifications GROUP BY kind""")
def rule_stats(t):
    return t.justifications.groupBy(F.col("kind").alias("scope")).agg(
        F.count("*").alias("n"), F.count_if(F.col("confidence") > 0.8).alias("trusted"), F.count_if(F.col("id") >= 900).alias("recent")
    )


@plan("a23_heat", """
WITH q AS (SELECT entity, count(*) AS queries FROM (SELECT unnest(entity_ids) AS entity FROM ledger WHERE source = 'query') x GROUP BY entity),
     c AS (SELECT entity, count(*) AS changes FROM (SELECT unnest(entity_ids) AS entity FROM ledger WHERE source = 'change') x GROUP BY entity)
SELECT entity, queries, COALESCE(changes, 0) AS changes, 2 * queries + 3 * COALESCE(changes, 0) AS heat FROM q LEFT JOIN c USING (entity) ORDER BY heat DESC, entity LIMIT 20""")
def heat(t):
    h = L.entity_heat(t.ledger.filter("source = 'query'"), t.ledger.filter("source = 'change'"))
    return h.orderBy(F.desc("heat"), "entity").limit(20)


@plan("a24_outcomes", f"""
SELECT event_type AS model, count(*) AS n, {R6.format("avg(CASE WHEN value < 100 THEN 1.0 ELSE 0.0 END)")} AS success_rate,
       quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.9) AS p90, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY event_type""")
def outcomes(t):
    q = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY value)").alias(f"p{int(p * 100)}")
    return t.events.groupBy(F.col("event_type").alias("model")).agg(
        F.count("*").alias("n"), r6(F.avg(F.when(F.col("value") < 100, 1.0).otherwise(0.0))).alias("success_rate"), q(0.5), q(0.9), q(0.99)
    )


@plan("a25_timing", f"""
SELECT event_type, count(*) AS n, min(value) AS least, max(value) AS most, {R6.format('avg(value)')} AS mean,
       quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.9) AS p90, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY event_type""")
def timing(t):
    return L.timing(t.events, "event_type", "value").withColumn("mean", r6(F.col("mean")))


@plan("a26_costs", f"""
SELECT event_type, source, count(*) AS n, {R6.format('sum(value)')} AS cost FROM ledger GROUP BY GROUPING SETS ((event_type, source), (source), ())""")
def costs(t):
    money = F.sum(F.col("value").cast("decimal(20,6)")).cast("double")
    return t.ledger.groupingSets([["event_type", "source"], ["source"], []], "event_type", "source").agg(F.count("*").alias("n"), r6(money).alias("cost"))


@plan("a27_budget", f"""
WITH d AS (SELECT strftime(ts, '%Y-%m-%d') AS day, sum(value) AS spent FROM ledger GROUP BY 1)
SELECT day, {R6.format('spent')} AS spent, CASE WHEN spent / 15000.0 >= 1 THEN 'exceeded' WHEN spent / 15000.0 >= 0.9 THEN 'critical' WHEN spent / 15000.0 >= 0.75 THEN 'warning' ELSE 'fine' END AS state FROM d""")
def budget(t):
    days = t.ledger.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.sum(F.col("value").cast("decimal(20,6)")).cast("double").alias("s"))
    return days.select("day", r6(F.col("s")).alias("spent"), L.budget_state(F.col("s"), 15000.0).alias("state"))


@plan("a28_bottlenecks", f"""
SELECT session_id, n, {R6.format('mean')} AS mean FROM (SELECT session_id, count(*) AS n, avg(value) AS mean FROM ledger GROUP BY session_id) x WHERE mean >= 0.3 * 100 AND n >= 3""")
def bottlenecks(t):
    return L.bottlenecks(L.timing(t.ledger, "session_id", "value"), 100.0).select("session_id", "n", r6(F.col("mean")).alias("mean"))


@plan("a29_graph_stats", """
WITH o AS (SELECT from_id AS id, count(*) AS n FROM calls GROUP BY 1), i AS (SELECT to_id AS id, count(*) AS n FROM calls GROUP BY 1)
SELECT kind, count(*) AS nodes, CAST(sum(COALESCE(o.n, 0)) AS BIGINT) AS edges, count(*) FILTER (WHERE o.n IS NULL) AS leaves, count(*) FILTER (WHERE i.n IS NULL) AS roots
FROM functions f LEFT JOIN o ON f.id = o.id LEFT JOIN i ON f.id = i.id GROUP BY kind""")
def graph_stats(t):
    from graphloom.operators.graph import degrees

    d = degrees(t.calls, t.functions).join(t.functions.select("id", "kind"), "id")
    return d.groupBy("kind").agg(
        F.count("*").alias("nodes"), F.sum("outgoing").alias("edges"), F.count_if(F.col("outgoing") == 0).alias("leaves"), F.count_if(F.col("incoming") == 0).alias("roots")
    )


@plan("a31_questions", "SELECT kind, CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.5 THEN 'medium' WHEN confidence >= 0.3 THEN 'low' ELSE 'uncertain' END AS level, count(*) AS n FROM justifications WHERE pending GROUP BY ALL")
def questions(t):
    return t.justifications.filter("pending").groupBy("kind", N.confidence_level(F.col("confidence")).alias("level")).agg(F.count("*").alias("n"))


@plan("a33_pattern_mix", "SELECT kind, count(*) FILTER (WHERE confidence >= 0.8) AS high, count(*) FILTER (WHERE confidence >= 0.5 AND confidence < 0.8) AS medium, count(*) FILTER (WHERE confidence < 0.5) AS low FROM justifications GROUP BY kind")
def pattern_mix(t):
    c = F.col("confidence")
    return t.justifications.groupBy("kind").agg(F.count_if(c >= 0.8).alias("high"), F.count_if((c >= 0.5) & (c < 0.8)).alias("medium"), F.count_if(c < 0.5).alias("low"))


@plan("a34_weighted", "SELECT l_orderkey AS entity, " + R6.format("sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) / sum(l_quantity)") + " AS confidence FROM lineitem GROUP BY l_orderkey")
def weighted(t):
    m = F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0)) / F.sum("l_quantity")
    return t.lineitem.groupBy(F.col("l_orderkey").alias("entity")).agg(r6(m).alias("confidence"))


@plan("a35_best_by_key", "SELECT kind, file_id, id FROM justifications QUALIFY row_number() OVER (PARTITION BY kind, file_id ORDER BY confidence DESC, id) = 1")
def best_by_key(t):
    return t.justifications.groupBy("kind", "file_id").agg(F.max_by("id", F.struct("confidence", -F.col("id"))).alias("id"))


@plan("a36_per_file", "SELECT x.path, count(f.id) AS functions, count(f.id) FILTER (WHERE f.is_exported) AS exported FROM files x LEFT JOIN functions f ON f.file_id = x.id GROUP BY x.path")
def per_file(t):
    f = t.functions.groupBy("file_id").agg(F.count("*").alias("n"), F.count_if("is_exported").alias("e"))
    return t.files.join(f, t.files.id == f.file_id, "left").select("path", F.coalesce("n", F.lit(0)).alias("functions"), F.coalesce("e", F.lit(0)).alias("exported"))


@plan("a37_modules", "SELECT array_to_string(list_slice(string_split(path, '/'), 2, 3), '/') AS module, count(*) AS files, CAST(sum(size) AS BIGINT) AS size FROM files GROUP BY 1")
def modules(t):
    return t.files.groupBy(T.last_directories(F.col("path")).alias("module")).agg(F.count("*").alias("files"), F.sum("size").alias("size"))


@plan("a38_naming", "SELECT count(*) FILTER (WHERE regexp_matches(name, '^[a-z]+ [a-z]+$')) AS two_words, count(*) FILTER (WHERE regexp_matches(name, '^(red|blue)')) AS colours, count(*) AS n FROM functions")
def naming(t):
    return t.functions.agg(
        F.count_if(F.col("name").rlike("^[a-z]+ [a-z]+$")).alias("two_words"), F.count_if(F.col("name").rlike("^(red|blue)")).alias("colours"), F.count("*").alias("n")
    )


@plan("a39_side_effects", """
WITH e AS (SELECT from_id, count(*) AS effects, count(*) FILTER (WHERE uses = 1) AS single, count(*) FILTER (WHERE package < 'Supplier#000000003') AS severe FROM externals GROUP BY from_id)
SELECT f.id, COALESCE(effects, 0) AS effects, effects IS NULL AS pure, CASE WHEN effects IS NULL THEN 'none' WHEN severe > 0 THEN 'high' WHEN single > 0 THEN 'medium' ELSE 'low' END AS risk FROM functions f LEFT JOIN e ON f.id = e.from_id""")
def side_effects(t):
    from graphloom.operators.reports import side_effect_risk

    e = t.externals.groupBy("from_id").agg(
        F.count("*").alias("e"), F.count_if(F.col("uses") == 1).alias("u"), F.count_if(F.col("package") < "Supplier#000000003").alias("s")
    )
    joined = t.functions.select("id").join(e, F.col("id") == F.col("from_id"), "left").na.fill(0, ["e", "u", "s"])
    return joined.select("id", F.col("e").alias("effects"), (F.col("e") == 0).alias("pure"), side_effect_risk(F.col("e"), F.col("u"), F.col("s")).alias("risk"))


@plan("a40_roll_up", f"""
WITH c AS (SELECT parent_id, count(*) AS children, avg(confidence) AS mean, list_sort(list_distinct(list_filter(list(feature), lambda x: x <> ''))) AS fs, list_distinct(flatten(list(tags))) AS ts
           FROM justifications WHERE parent_id IS NOT NULL GROUP BY parent_id)
SELECT j.id, children, CASE WHEN len(fs) = 1 THEN fs[1] ELSE array_to_string(fs, ', ') END AS feature, {R6.format('greatest(j.confidence, mean)')} AS confidence,
       array_to_string(list_sort(list_distinct(list_concat(j.tags, ts))), ',') AS tags FROM justifications j JOIN c ON j.id = c.parent_id""")
def roll_up(t):
    from graphloom.operators.graph import roll_up as up

    return up(t.justifications).select("id", "children", "feature", r6(F.col("confidence")).alias("confidence"), F.array_join("tags", ",").alias("tags"))


@plan("w02_ranks", "SELECT id, row_number() OVER (ORDER BY complexity DESC, id) - 1 AS rank FROM functions QUALIFY row_number() OVER (ORDER BY complexity DESC, id) <= 50")
def ranks(t):
    top = t.functions.orderBy(F.desc("complexity"), "id").limit(50)
    return W.ranked(top, [F.desc("complexity"), F.col("id")]).select("id", F.col("rank").cast("long").alias("rank"))


@plan("w03_normalise", f"SELECT id, {R6.format('complexity / (SELECT CAST(max(complexity) AS DOUBLE) FROM functions)')} AS score FROM functions")
def normalise(t):
    return W.over_max(t.functions, "complexity", "score").select("id", r6(F.col("score")).alias("score"))


@plan("w04_bus_factor", """
WITH n AS (SELECT module, author, count(*) AS n FROM commits GROUP BY ALL),
c AS (SELECT *, COALESCE(sum(n) OVER (PARTITION BY module ORDER BY n DESC, author ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n) OVER (PARTITION BY module) AS total,
      row_number() OVER (PARTITION BY module ORDER BY n, author) AS i, count(*) OVER (PARTITION BY module) AS k FROM n)
SELECT module, count(*) AS contributors, count(*) FILTER (WHERE before * 100 < total * 80) AS bus_factor,
       CASE WHEN count(*) <= 1 THEN 0.0 ELSE floor((1 - sum((2 * i - k - 1) * n) / CAST(any_value(k) * any_value(total) AS DOUBLE)) * 100 + 0.5) / 100 END AS evenness FROM c GROUP BY module""")
def bus_factor(t):
    return W.bus_factor(t.commits.groupBy("module", "author").agg(F.count("*").alias("n")), "module", "author", "n")


@plan("w06_gap_trend", """
WITH a AS (SELECT session_id, ledger."at" AS w, row_number() OVER (PARTITION BY session_id ORDER BY ledger."at" DESC) AS n FROM ledger),
g AS (SELECT session_id, count(*) AS accesses, max(w) FILTER (WHERE n = 1) - max(w) FILTER (WHERE n = 2) AS now, max(w) FILTER (WHERE n = 2) - max(w) FILTER (WHERE n = 3) AS before FROM a WHERE n <= 10 GROUP BY session_id)
SELECT session_id, accesses, CASE WHEN before IS NULL THEN 'stable' WHEN now < before * 0.7 THEN 'rising' WHEN now > before * 1.3 THEN 'falling' ELSE 'stable' END AS trend FROM g""")
def gap_trend(t):
    return W.gap_trend(t.ledger, "session_id", "at")


@plan("w07_bucket_trend", """
WITH b AS (SELECT event_type, CAST(floor(seq / 100.0) AS BIGINT) AS bucket, count(*) AS n FROM ledger GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY bucket DESC) AS back FROM b),
k AS (SELECT *, count(*) OVER (PARTITION BY event_type) AS total FROM r WHERE back <= 10),
e AS (SELECT event_type, max(total) AS buckets, sum(n) FILTER (WHERE back <= 3) * 10 AS new, sum(n) FILTER (WHERE total - back + 1 <= 3) AS old FROM k GROUP BY event_type)
SELECT event_type, buckets, CASE WHEN new > old * 12 THEN 'up' WHEN new < old * 8 THEN 'down' ELSE 'flat' END AS trend FROM e""")
def bucket_trend(t):
    b = t.ledger.groupBy("event_type", F.floor(F.col("seq") / 100).alias("bucket")).agg(F.count("*").alias("n"))
    return W.bucket_trend(b, "event_type", "bucket", "n")


@plan("w08_over_mean", f"SELECT id, {R6.format('changes / (SELECT avg(changes) FROM churn)')} AS multiple FROM churn")
def over_mean(t):
    return W.over_mean(t.churn, "changes", "multiple").select("id", r6(F.col("multiple")).alias("multiple"))


@plan("w10_experts", """
WITH n AS (SELECT module, author, count(*) AS n FROM commits GROUP BY ALL),
s AS (SELECT *, CAST(floor(n * 100.0 / sum(n) OVER (PARTITION BY module) + 0.5) AS BIGINT) AS share, row_number() OVER (PARTITION BY module ORDER BY n DESC, author) AS rank FROM n)
SELECT module, author, share, CAST(rank AS INT) AS rank FROM s WHERE rank <= 3""")
def experts(t):
    n = t.commits.groupBy("module", "author").agg(F.count("*").alias("n"))
    s = W.shares(n, "module", "author", "n").withColumn("share", N.half_up(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy("module"))))
    return W.top_per_group(s, ["module"], [F.desc("n"), F.col("author")], 3).select("module", "author", "share", "rank")


@plan("t05_sessions", """
WITH RECURSIVE e AS (SELECT session_id, seq, ledger."at" AS s, row_number() OVER (PARTITION BY session_id ORDER BY ledger."at" DESC, seq DESC) AS n FROM ledger),
walk AS (SELECT session_id, seq, s, n, s AS anchor, 0 AS part FROM e WHERE n = 1
  UNION ALL SELECT e.session_id, e.seq, e.s, e.n, CASE WHEN w.anchor - e.s > 43200 THEN e.s ELSE w.anchor END, w.part + CASE WHEN w.anchor - e.s > 43200 THEN 1 ELSE 0 END
  FROM walk w JOIN e ON e.session_id = w.session_id AND e.n = w.n + 1)
SELECT session_id, CAST(part AS BIGINT) AS part, count(*) AS events, min(seq) AS first_seq FROM walk GROUP BY session_id, part""")
def sessions(t):
    s = L.anchored_sessions(t.ledger, 43200.0)
    return s.groupBy("session_id", "part").agg(F.count("*").alias("events"), F.min("seq").alias("first_seq"))


@plan("t05_gap_sessions", """
WITH l AS (SELECT session_id, seq, ledger."at" AS s FROM ledger),
e AS (SELECT *, CASE WHEN s - lag(s) OVER (PARTITION BY session_id ORDER BY s, seq) > 43200 OR lag(s) OVER (PARTITION BY session_id ORDER BY s, seq) IS NULL THEN 1 ELSE 0 END AS new FROM l),
p AS (SELECT session_id, seq, sum(new) OVER (PARTITION BY session_id ORDER BY s, seq) AS part FROM e)
SELECT session_id, CAST(part AS BIGINT) AS part, count(*) AS events FROM p GROUP BY session_id, part HAVING count(*) >= 3""")
def gap_sessions(t):
    s = L.gap_sessions(t.ledger, 43200.0)
    return s.groupBy("session_id", "part").agg(F.count("*").alias("events")).filter("events >= 3")


@plan("t11_buckets", f"""SELECT event_type, CAST(floor(ledger."at" / 86400) AS BIGINT) AS day, count(*) AS n, {R6.format('max(value)')} AS most FROM ledger GROUP BY ALL""")
def buckets(t):
    return t.ledger.groupBy("event_type", F.floor(F.col("at") / 86400).alias("day")).agg(F.count("*").alias("n"), r6(F.max("value")).alias("most"))


@plan("t13_recent", f"""SELECT event_type, count(*) AS n, {R6.format('avg(value)')} AS mean FROM ledger WHERE ledger."at" > (SELECT max(ledger."at") FROM ledger) - 86400 GROUP BY event_type""")
def recent(t):
    last = t.ledger.agg((F.max("at") - 86400).alias("since"))
    return t.ledger.crossJoin(F.broadcast(last)).filter("at > since").groupBy("event_type").agg(F.count("*").alias("n"), r6(F.avg("value")).alias("mean"))


@plan("t14_gaps", "SELECT count(*) AS commits, min(o_orderkey) AS first, max(o_orderkey) AS last FROM orders WHERE o_orderkey > (SELECT max(sha) FROM commits WHERE sha % 2 = 0 AND sha < 500)")
def gaps(t):
    seen = t.commits.filter("sha % 2 = 0 AND sha < 500").agg(F.max("sha").alias("seen"))
    return t.orders.crossJoin(F.broadcast(seen)).filter("o_orderkey > seen").agg(F.count("*").alias("commits"), F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"))


@plan("t15_reindex", """
SELECT count(*) AS pending, count(*) FILTER (WHERE p > 0.7) AS hot, count(*) FILTER (WHERE p > 0.3) AS warm,
       CASE WHEN count(*) FILTER (WHERE p > 0.7) > 0 THEN 'now' WHEN count(*) FILTER (WHERE p > 0.3) >= 10 THEN 'batch' ELSE 'defer' END AS decision
FROM (SELECT CAST(id AS DOUBLE) % 70 / 100 AS p FROM functions) x""")
def reindex(t):
    return L.reindex_decision(t.functions.select(F.col("id").alias("entity"), (F.col("id").cast("double") % 70 / 100).alias("priority")))


@plan("x06_batch_stats", "SELECT file_id, count(*) AS rows, count(*) FILTER (WHERE is_async) AS async FROM functions GROUP BY CUBE (file_id)")
def batch_stats(t):
    return t.functions.cube("file_id").agg(F.count("*").alias("rows"), F.count_if("is_async").alias("async"))


@plan("x19_token_batches")
def token_batches(t):
    rows = t.documents.select("doc_id", "source", T.token_estimate(F.col("text")).alias("tokens"))
    b = L.token_batches(rows, "source", ["doc_id"], "tokens", 4000)
    return b.groupBy("source", "batch").agg(F.count("*").alias("rows"), F.sum("tokens").alias("tokens"))


@plan("x23_commit_batches", """
WITH f AS (SELECT module, sha, entity, row_number() OVER (PARTITION BY module ORDER BY sha, entity, lines) AS rn FROM commits)
SELECT module, CAST(floor((rn - 1) / 10.0) AS BIGINT) AS batch, count(*) AS n, min(sha) AS first_sha FROM f GROUP BY ALL""")
def commit_batches(t):
    rn = F.row_number().over(Window.partitionBy("module").orderBy("sha", "entity", "lines"))
    return t.commits.withColumn("batch", F.floor((rn - 1) / 10)).groupBy("module", "batch").agg(F.count("*").alias("n"), F.min("sha").alias("first_sha"))
