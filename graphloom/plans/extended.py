"""Writes, state, producers' rows and the rest of the scores."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from graphloom.functions import numeric as N
from graphloom.functions import text as T
from graphloom.operators import extraction as X
from graphloom.operators import graph as G
from graphloom.operators import joins
from graphloom.operators import ledger as L
from graphloom.operators import reports as R
from graphloom.operators import search as S
from graphloom.operators import store
from graphloom.operators import windows as W
from graphloom.operators.builder import Query
from graphloom.operators.language import answer, understood
from graphloom.plans.analytics import R6, r6
from graphloom.plans.registry import Plans
from graphloom.plans.traversals import VECTORS, first_vector
from graphloom.sources import files as Files
from graphloom.sources import ledger_files
from graphloom.sources.tables import Catalog
from graphloom.storage import shared_folder
from graphloom.streaming.ledger import last_per_path

PLANS = Plans()
plan = PLANS.plan
c = F.col


@plan("s07_append", "SELECT id, name FROM functions UNION ALL SELECT id + 500000, name FROM functions WHERE id < 10")
def append(t):
    """Rows appended to a table of the catalogue, and the table read again."""
    catalog = Catalog(t.spark, f"{shared_folder(t.spark)}/append-{uuid.uuid4().hex}")
    f = t.functions.select("id", "name")
    catalog.replace("functions", f)
    catalog.append("functions", f.filter("id < 10").withColumn("id", c("id") + 500000))
    return catalog("functions")


@plan("s03_batch_write", "SELECT 'functions' AS relation, count(*) AS n FROM functions UNION ALL SELECT 'files', count(*) FROM files")
def batch_write(t):
    """A batch through the catalogue into the shared folder, and read again."""
    catalog = Catalog(t.spark, f"{shared_folder(t.spark)}/batch-{uuid.uuid4().hex}")
    catalog.write_batch({"functions": t.functions, "files": t.files}, {"functions": ["id"], "files": ["id"]})
    counts = [catalog(n).agg(F.count("*").alias("n")).select(F.lit(n).alias("relation"), "n") for n in ("functions", "files")]
    return counts[0].unionAll(counts[1])


@plan("s11_ignore", r"SELECT page_id FROM pages WHERE NOT regexp_matches(url, '\.html$') AND NOT regexp_matches(url, '/en/')")
def ignore(t):
    return t.pages.filter(~Files.ignored(c("url"), ["**.html", "**/en/**"])).select("page_id")


@plan("s13_ledger_json", "SELECT seq, event_type, len(files) AS files FROM ledger")
def ledger_json(t):
    rows = t.ledger.select(F.to_json(F.struct("seq", "event_type", "files")).alias("j"))
    back = rows.select(F.from_json("j", "seq long, event_type string, files array<string>").alias("r"))
    return back.select("r.seq", "r.event_type", F.size("r.files").cast("long").alias("files"))


@plan("s18_commit_files", "SELECT sha, row_number() OVER (PARTITION BY sha ORDER BY entity, module, author, lines) - 1 AS place, entity FROM commits")
def commit_files(t):
    f = F.struct("entity", "module", "author", "lines")
    grouped = t.commits.groupBy("sha").agg(F.array_sort(F.collect_list(f)).alias("files"))  # an order's lines
    rows = ledger_files.commit_files(grouped.withColumn("author", F.lit("")).withColumn("at", F.lit(None)).withColumn(
        "files", F.transform("files", lambda x: F.struct(x["entity"].alias("entity")))))
    return rows.select("sha", c("place").cast("long").alias("place"), "entity")


@plan("s22_embedding_upsert", "SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 'new' ELSE 'old' END AS model FROM embeddings")
def embedding_upsert(t):
    old = t.embeddings.select("vec_id", F.lit("old").alias("model"), F.lit(1).alias("v"))
    new = t.embeddings.filter("vec_id % 3 = 0").select("vec_id", F.lit("new").alias("model"), F.lit(2).alias("v"))
    return store.keep_last(old.unionAll(new), ["vec_id"], c("v")).select("vec_id", "model")


@plan("p20_recent_uncertain", "SELECT id FROM justifications WHERE n_chars >= 2000 AND confidence < 0.5")
def recent_uncertain(t):
    return Query(t).from_("justifications").where("nChars", ">=", 2000).where("confidence", "<", 0.5).select("id").frame()


@plan("j03_file_path", "SELECT f.id, x.path, x.language FROM functions f JOIN files x ON f.file_id = x.id WHERE f.is_exported")
def file_path(t):
    f = t.functions.filter("is_exported").join(t.files.select(c("id").alias("file_id"), "path", "language"), "file_id")
    return f.select("id", "path", "language")


@plan("j07_subclasses", "SELECT p.id AS parent, k.id AS child FROM justifications k JOIN justifications p ON k.parent_id = p.id WHERE p.kind = 'en' AND k.id <> p.id")
def subclasses(t):
    up = t.justifications.filter("parent_id != id").select(c("id").alias("from_id"), c("parent_id").alias("to_id"))
    parents = t.justifications.filter("kind = 'en'")
    return joins.link(up, t.justifications, parents, [], []).select(c("to_id").alias("parent"), c("from_id").alias("child"))


@plan("a17_compaction_stats", f"""
WITH s AS (SELECT session_id, count(*) AS n, bool_or(event_type = 'error') AS e FROM ledger GROUP BY session_id HAVING count(*) >= 3)
SELECT e AS errors, count(*) AS entries, CAST(sum(n) AS BIGINT) AS events, {R6.format('avg(n)')} AS mean FROM s GROUP BY e""")
def compaction_stats(t):
    s = L.compact(t.ledger, ["session_id"])
    return s.groupBy((c("intent") == "debugging").alias("errors")).agg(F.count("*").alias("entries"), F.sum("events").alias("events"), r6(F.avg("events")).alias("mean"))


@plan("a19_completeness", f"""
SELECT session_id, {R6.format("least(1.0, 0.3 + CASE WHEN bool_or(event_type = 'signup') THEN 0.2 ELSE 0 END + CASE WHEN bool_or(source = 'query') THEN 0.2 ELSE 0 END + 0.15 + CASE WHEN bool_or(source = 'change') OR bool_or(event_type = 'error') THEN 0.15 ELSE 0 END)")} AS completeness
FROM ledger GROUP BY session_id""")
def completeness(t):
    has = lambda x: F.bool_or(x)
    score = L.completeness(c("p"), c("q"), F.lit(True), c("ch"), c("e"))
    flags = t.ledger.groupBy("session_id").agg(
        has(c("event_type") == "signup").alias("p"), has(c("source") == "query").alias("q"), has(c("source") == "change").alias("ch"), has(c("event_type") == "error").alias("e")
    )
    return flags.select("session_id", r6(score).alias("completeness"))


@plan("a20_intent", """
WITH f AS (SELECT session_id, bool_or(event_type = 'error') AS e, bool_or(len(list_filter(files, lambda x: contains(x, 'test'))) > 0) AS te, bool_or(len(list_filter(files, lambda x: contains(x, 'config'))) > 0) AS co, bool_or(event_type = 'view') AS cl, bool_or(source = 'change') AS ch FROM ledger GROUP BY session_id)
SELECT session_id, CASE WHEN e THEN 'debugging' WHEN te AND NOT co THEN 'testing' WHEN co AND NOT te THEN 'configuration' WHEN cl THEN 'exploration' WHEN ch THEN 'feature-development' ELSE 'unknown' END AS intent FROM f""")
def intent(t):
    part = lambda x: F.bool_or(F.exists("files", lambda f: f.contains(x)))
    is_ = lambda x: F.bool_or(c("event_type") == x)
    f = t.ledger.groupBy("session_id").agg(
        is_("error").alias("e"), part("test").alias("te"), part("config").alias("co"), is_("view").alias("cl"), F.bool_or(c("source") == "change").alias("ch")
    )
    return f.select("session_id", L.intent_category(c("e"), c("te"), c("co"), c("cl"), c("ch"), F.lit(1)).alias("intent"))


@plan("a22_adaptive", f"SELECT source, count(*) AS n, count(*) FILTER (WHERE value > 50) AS strong, {R6.format('avg(value)')} AS mean FROM ledger GROUP BY source")
def adaptive(t):
    return t.ledger.groupBy("source").agg(F.count("*").alias("n"), F.count_if(c("value") > 50).alias("strong"), r6(F.avg("value")).alias("mean"))


@plan("a32_documentation", f"SELECT source, count(*) AS entities, {R6.format('count(l.doc_id) * 100.0 / count(*)')} AS coverage FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY source")
def documentation(t):
    has = t.labels.select("doc_id", F.lit(1).alias("h"))
    g = t.documents.select("doc_id", "source").join(has, "doc_id", "left").groupBy("source").agg(F.count("*").alias("entities"), F.count("h").alias("h"))
    return g.select("source", "entities", r6(N.percent(c("h"), c("entities"))).alias("coverage"))


@plan("w05_gini", """
WITH n AS (SELECT file_id, complexity, row_number() OVER (PARTITION BY file_id ORDER BY complexity, id) AS i, count(*) OVER (PARTITION BY file_id) AS k, sum(complexity) OVER (PARTITION BY file_id) AS s FROM functions)
SELECT file_id, floor((1 - sum((2 * i - k - 1) * complexity) / CAST(any_value(k) * any_value(s) AS DOUBLE)) * 100 + 0.5) / 100 AS evenness FROM n GROUP BY file_id HAVING count(*) > 1""")
def gini(t):
    return W.bus_factor(t.functions, "file_id", "id", "complexity").filter("contributors > 1").select("file_id", "evenness")


@plan("w09_versions", "SELECT user_id, max(event_id) AS event_id FROM events GROUP BY user_id")
def versions(t):
    rows = t.events.select("user_id", "event_id")
    return store.keep_last(rows, ["user_id"], c("event_id"))


@plan("w11_first_match", """
SELECT file, rank, id FROM (SELECT file_id AS file, id, CAST(row_number() OVER (ORDER BY price DESC, id) - 1 AS INT) AS rank FROM functions QUALIFY row_number() OVER (ORDER BY price DESC, id) <= 60) x
QUALIFY row_number() OVER (PARTITION BY file ORDER BY rank) = 1""")
def first_match(t):
    top = W.ranked(t.functions.orderBy(F.desc("price"), "id").limit(60), [F.desc("price"), c("id")]).select(c("file_id").alias("file"), "rank", "id")
    return S.first_match(top)


@plan("k02_pages", "SELECT id, path, size FROM files ORDER BY path DESC, id OFFSET 5 LIMIT 5")
def pages(t):
    return Query(t).from_("files").order("path", desc=True).page(5, 5).select("id", "path", "size").frame()


@plan("k08_cold", """
WITH h AS (SELECT entity, count(*) AS n FROM (SELECT unnest(entity_ids) AS entity FROM ledger) x GROUP BY entity)
SELECT 'hot' AS side, entity, n FROM (SELECT * FROM h ORDER BY n DESC, entity LIMIT 5) a UNION ALL SELECT 'cold', entity, n FROM (SELECT * FROM h ORDER BY n, entity LIMIT 5) b""")
def cold(t):
    h = t.ledger.select(F.explode("entity_ids").alias("entity")).groupBy("entity").agg(F.count("*").alias("n"))
    side = lambda name, o: h.orderBy(o, "entity").limit(5).select(F.lit(name).alias("side"), "entity", "n")
    return side("hot", F.desc("n")).unionAll(side("cold", c("n")))


@plan("k09_priorities", f"SELECT id, {R6.format('complexity / 50.0 + changes / 100.0')} AS priority FROM entity_facts ORDER BY complexity / 50.0 + changes / 100.0 DESC, id LIMIT 15")
def priorities(t):
    p = c("complexity") / 50.0 + c("changes") / 100.0
    return t.entity_facts.select("id", r6(p).alias("priority"), p.alias("p")).orderBy(F.desc("p"), "id").limit(15).drop("p")


@plan("k10_slow", "SELECT event_id, value FROM events WHERE value > 100 ORDER BY value DESC, event_id LIMIT 100")
def slow(t):
    return t.events.filter("value > 100").select("event_id", "value").orderBy(F.desc("value"), "event_id").limit(100)


@plan("g04_class_hierarchy", """
WITH RECURSIVE up AS (SELECT id, 0 AS depth FROM justifications WHERE id = 187 UNION SELECT j.parent_id, u.depth + 1 FROM up u JOIN justifications j ON j.id = u.id WHERE j.parent_id IS NOT NULL AND u.depth < 10 AND j.parent_id <> j.id)
SELECT id, depth FROM up WHERE depth > 0""")
def class_hierarchy(t):
    up = t.justifications.filter("parent_id != id").select(c("id").alias("from_id"), c("parent_id").alias("to_id"))
    return G.chain(up, t.justifications.filter("id = 187").select("id"), 10)


@plan("g13_bottom_up", """
WITH RECURSIVE up AS (SELECT id, parent_id, 0 AS depth FROM justifications UNION ALL SELECT u.id, j.parent_id, u.depth + 1 FROM up u JOIN justifications j ON j.id = u.parent_id AND u.depth < 30),
d AS (SELECT id, max(depth) AS depth FROM up GROUP BY id)
SELECT id, CAST(depth AS INT) AS depth, row_number() OVER (ORDER BY depth DESC, id) AS place FROM d""")
def bottom_up(t):
    """Every node with its depth and its place from the leaves up."""
    j = t.justifications.select("id", "parent_id")
    deep = G.ancestors(j, j, 30).groupBy("id").agg(F.max("steps").alias("depth"))
    levels = j.select("id").join(deep, "id", "left").select("id", F.coalesce("depth", F.lit(0)).alias("depth"))
    return G.placed(levels, "depth", descending=True)


FLOWS = "fl AS (SELECT from_id AS caller, line_number % 2 AS parameter, to_id AS callee, (line_number + 1) % 2 AS argument FROM calls)"


@plan("g17_cross_function", f"""
WITH RECURSIVE {FLOWS}, w AS (SELECT caller, parameter, 0 AS depth FROM fl WHERE caller IN (SELECT id FROM hub) UNION SELECT fl.callee, fl.argument, w.depth + 1 FROM w JOIN fl ON fl.caller = w.caller AND fl.parameter = w.parameter WHERE w.depth < 4)
SELECT caller, parameter, min(depth) AS depth FROM w GROUP BY ALL""")
def cross_function(t):
    flows = t.calls.select(c("from_id").alias("caller"), (c("line_number") % 2).alias("parameter"), c("to_id").alias("callee"), ((c("line_number") + 1) % 2).alias("argument"))
    start = flows.join(t.hub, c("caller") == c("id"), "left_semi")
    return X.cross_function(flows, start, 4)


@plan("v01_knn_cosine", f"WITH {VECTORS} SELECT id, {R6.format('1 - list_cosine_similarity(e, q)')} AS distance FROM v, q ORDER BY 1 - list_cosine_similarity(e, q), id LIMIT 10")
def knn_cosine(t):
    v = t.embeddings.select(c("vec_id").alias("id"), "embedding").crossJoin(first_vector(t))
    return S.knn(v, c("q"), 10, "cosine").select("id", r6(c("distance")).alias("distance"))


@plan("v07_memory_search", f"WITH {VECTORS} SELECT id, {R6.format('list_cosine_similarity(e, q)')} AS similarity FROM v, q WHERE label % 2 = 0 ORDER BY list_cosine_similarity(e, q) DESC, id LIMIT 10")
def memory_search(t):
    active = t.embeddings.filter("label % 2 = 0").select(c("vec_id").alias("id"), "embedding").crossJoin(first_vector(t))
    return S.knn(active, c("q"), 10, "cosine").select("id", r6(1 - c("distance")).alias("similarity"))


@plan("v12_intents", """
SELECT id, query, CASE id % 7 WHEN 0 THEN 'definition' WHEN 1 THEN 'usage' WHEN 2 THEN 'conceptual' WHEN 3 THEN 'definition' WHEN 4 THEN 'usage' WHEN 5 THEN 'conceptual' ELSE 'keyword' END AS intent
FROM asked""")
def intents(t):
    return S.with_intents(t.asked)


@plan("v13_expansion", f"""
WITH {VECTORS}, r AS (SELECT b.id, min(list_distance(a.e, b.e)) AS distance FROM v a JOIN v b ON a.id IN (0, 1, 2) GROUP BY b.id)
SELECT id, {R6.format('distance')} AS distance FROM r ORDER BY distance, id LIMIT 20""")
def expansion(t):
    asked = F.broadcast(t.embeddings.filter("vec_id IN (0, 1, 2)").select(c("embedding").alias("q")))  # three rows
    d = t.embeddings.crossJoin(asked).select(c("vec_id").alias("id"), N.l2(c("embedding"), c("q")).alias("d"))
    best = d.groupBy("id").agg(F.min("d").alias("d")).orderBy("d", "id").limit(20)
    return best.select("id", r6(c("d")).alias("distance"))


@plan("v15_understand", """
SELECT id, request, name AS target, 0.9::DOUBLE AS confidence,
       CASE id % 12 WHEN 0 THEN 'show_callers' WHEN 1 THEN 'show_callees' WHEN 2 THEN 'show_callers' WHEN 3 THEN 'find_location' WHEN 4 THEN 'explain' WHEN 5 THEN 'show_methods'
            WHEN 6 THEN 'show_hierarchy' WHEN 7 THEN 'filter_scope' WHEN 8 THEN 'semantic_search' WHEN 9 THEN 'find_function' WHEN 10 THEN 'find_dependencies' ELSE 'find_location' END AS intent
FROM requests""")
def requests(t):
    return understood(t.requests.select("id", "request"))


PLACES = """SELECT 'function' AS kind, CAST(f.id AS VARCHAR) AS id, f.name, x.path FROM functions f JOIN files x ON f.file_id = x.id WHERE contains(lower(f.name), '{0}')
UNION ALL SELECT 'file', id, path, path FROM files WHERE contains(lower(path), '{0}')
UNION ALL SELECT 'class', CAST(k.id AS VARCHAR), k.name, x.path FROM classes k JOIN files x ON k.file_id = x.id WHERE contains(lower(k.name), '{0}')"""


@plan("v16_location", PLACES.format("m1"))
def location(t):
    return answer("where is m1", t)


@plan("v16_explain", PLACES.format("red bolt") + """
UNION ALL SELECT DISTINCT 'callee', CAST(b.id AS VARCHAR), b.name, x.path FROM calls c JOIN functions a ON c.from_id = a.id JOIN functions b ON c.to_id = b.id JOIN files x ON b.file_id = x.id
WHERE contains(lower(a.name), 'red bolt')""")
def explain(t):
    return answer("how does red bolt work", t)


@plan("v16_hierarchy", """
SELECT 'extends' AS kind, k.id, k.name, p.name AS parent FROM extends e JOIN classes p ON e.to_id = p.id JOIN classes k ON e.from_id = k.id WHERE contains(lower(p.name), '000000002')
UNION ALL SELECT 'implements', k.id, k.name, p.name FROM implements e JOIN interfaces p ON e.to_id = p.id JOIN classes k ON e.from_id = k.id WHERE contains(lower(p.name), '000000002')""")
def hierarchy(t):
    return answer("classes that extend Supplier#000000002", t).filter("contains(lower(parent), '000000002')")


@plan("v16_implementers", """
SELECT 'implements' AS kind, k.id, k.name, p.name AS parent FROM implements e JOIN interfaces p ON e.to_id = p.id JOIN classes k ON e.from_id = k.id WHERE contains(lower(p.name), 'nation_1')""")
def implementers(t):
    return answer("what implements nation_1", t)


@plan("v16_methods", """
SELECT f.id, f.name, k.name AS class_name FROM has_method m JOIN classes k ON m.from_id = k.id JOIN functions f ON m.to_id = f.id WHERE contains(lower(k.name), '000003')""")
def methods(t):
    return answer("methods of 000003", t)


@plan("v16_classes", """
SELECT 'class' AS kind, CAST(id AS VARCHAR) AS id, name FROM classes WHERE contains(lower(name), '_1') UNION ALL SELECT 'interface', CAST(id AS VARCHAR), name FROM interfaces WHERE contains(lower(name), '_1')""")
def classes(t):
    return answer("interface _1", t)


@plan("v16_scope", """
SELECT 'function' AS kind, CAST(f.id AS VARCHAR) AS id, f.name, x.path FROM functions f JOIN files x ON f.file_id = x.id WHERE starts_with(x.path, 'src/core')
UNION ALL SELECT 'class', CAST(k.id AS VARCHAR), k.name, x.path FROM classes k JOIN files x ON k.file_id = x.id WHERE starts_with(x.path, 'src/core')""")
def scope(t):
    return answer("functions in src/core", t)


@plan("v16_dependencies", 'SELECT package, count(*) AS "references" FROM externals GROUP BY package ORDER BY "references" DESC, package LIMIT 20')
def dependencies(t):
    return answer("external dependencies", t)


@plan("v18_relevant", """
SELECT concept, id FROM (SELECT w.concept, f.id, row_number() OVER (PARTITION BY w.concept ORDER BY f.complexity DESC, f.id) AS r FROM functions f JOIN (VALUES ('red'), ('gear'), ('small')) w(concept) ON contains(f.name, w.concept)) x WHERE r <= 5""")
def relevant(t):
    words = F.explode(F.array(*[F.lit(w) for w in ("red", "gear", "small")])).alias("concept")
    hits = t.functions.select("id", "name", "complexity", words).filter(F.contains("name", c("concept")))
    return W.top_per_group(hits, ["concept"], [F.desc("complexity"), c("id")], 5).select("concept", "id")


@plan("v19_concepts", """
SELECT seq, CASE seq % 2 WHEN 0 THEN 'parseConfig,login flow,cache' ELSE 'user_id,api' END AS concepts FROM ledger""")
def concepts(t):
    text = F.when(c("seq") % 2 == 0, "make parseConfig use the cache for 'login flow'").otherwise("read user_id from the api")
    return t.ledger.select("seq", F.array_join(S.concepts(text, ["cache", "api", "queue"]), ",").alias("concepts"))


@plan("v23_rule_triggers", """
SELECT doc_id AS key, r.id FROM documents d JOIN (VALUES (1, 'licen[cs]ed'), (2, '^the '), (3, '[0-9]{3}-[0-9]{4}')) r(id, p) ON regexp_matches(d.text, r.p, 'i')""")
def rule_triggers(t):
    rules = t.spark.createDataFrame([(1, "licen[cs]ed"), (2, "^the "), (3, "[0-9]{3}-[0-9]{4}"), (4, "(broken")], "id int, pattern string")
    return X.matching_rules(rules, t.documents.select(c("doc_id").alias("key"), "text"))


@plan("f03_inner_product", f"WITH {VECTORS} SELECT id, {R6.format('list_inner_product(e, q)')} AS product FROM v, q")
def inner_product(t):
    v = t.embeddings.crossJoin(first_vector(t))
    return v.select(c("vec_id").alias("id"), r6(N.dot(c("embedding"), c("q"))).alias("product"))


@plan("f08_embedding_text", """
SELECT item_id, 'f' || chr(10) || 'f()' || chr(10) || 'doc text' || chr(10) || substr(text, 1, 300) AS text FROM benchmark""")
def embedding_text(t):
    return t.benchmark.select("item_id", T.embedding_text(F.lit("f"), F.lit("f()"), F.lit("/** doc\n * text */"), c("text")).alias("text"))


@plan("f12_level", "SELECT id, CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.5 THEN 'medium' WHEN confidence >= 0.3 THEN 'low' ELSE 'uncertain' END AS level FROM justifications")
def level(t):
    return t.justifications.select("id", N.confidence_level(c("confidence")).alias("level"))


@plan("f17_return", f"""
WITH e AS (SELECT id, CASE WHEN complexity > 30 THEN 5 WHEN complexity > 20 THEN 3 WHEN complexity > 10 THEN 2 ELSE 1 END + CASE WHEN callers > 20 THEN 2 WHEN callers > 10 THEN 1 ELSE 0 END AS points, changes, complexity, callers FROM entity_facts)
SELECT id, floor(changes * 0.5::DOUBLE * 6 / (points * 4) * 10 + 0.5) / 10 AS roi,
       CAST(floor(least(complexity / 30.0::DOUBLE, 1) * 40 + least(changes / 10.0::DOUBLE, 1) * 30 + least(callers / 20.0::DOUBLE, 1) * 1.5::DOUBLE * 30 + 0.5) AS BIGINT) AS debt FROM e""")
def return_(t):
    points = R.effort(c("complexity"), c("callers"))
    debt = R.debt_score(c("complexity"), c("changes"), F.lit(1.5), c("callers"))
    return t.entity_facts.select("id", R.return_on_effort(points, c("changes") * 0.5).alias("roi"), debt.cast("long").alias("debt"))


@plan("f21_business_flow", """
SELECT id, CASE WHEN contains(area, 'payment') OR contains(area, 'billing') THEN 'Payment' WHEN contains(area, 'user') THEN 'Accounts' ELSE 'General' END AS flow FROM entity_facts""")
def business_flow(t):
    return t.entity_facts.select("id", T.keyword_label(c("area"), [(("payment", "billing"), "Payment"), (("user",), "Accounts")], "General").alias("flow"))


@plan("f29_effects", """
WITH k AS (SELECT seq, CASE seq % 4 WHEN 0 THEN 'fetch(url)' WHEN 1 THEN 'console.log(fs.x)' WHEN 2 THEN 'add(1)' ELSE 'db.query(q)' END AS text FROM ledger)
SELECT seq, kind, level FROM k JOIN (VALUES ('network', 'high', 'fetch('), ('file', 'high', 'fs.'), ('database', 'high', '.query('), ('console', 'low', 'console.')) e(kind, level, mark) ON contains(text, mark)""")
def effects(t):
    text = F.element_at(F.array(*map(F.lit, ["fetch(url)", "console.log(fs.x)", "add(1)", "db.query(q)"])), (c("seq") % 4 + 1).cast("int"))
    return X.effects(t.ledger.select("seq", text.alias("text"))).select("seq", "kind", "level")


@plan("f30_purity", "SELECT id, id NOT IN (SELECT from_id FROM externals) AS pure FROM functions")
def purity(t):
    used = t.externals.select(c("from_id").alias("id")).distinct().withColumn("u", F.lit(True))
    return t.functions.select("id").join(used, "id", "left").select("id", c("u").isNull().alias("pure"))


@plan("r10_migration", """
SELECT CASE WHEN m.id IS NULL THEN 'external' ELSE 'internal' END AS kind, f.file_id, count(*) AS edges FROM calls c JOIN functions f ON c.from_id = f.id AND f.file_id IN ('Brand#3', 'Brand#7')
LEFT JOIN functions m ON c.to_id = m.id AND m.file_id IN ('Brand#3', 'Brand#7') GROUP BY ALL""")
def migration(t):
    members = t.functions.filter("file_id IN ('Brand#3', 'Brand#7')")
    split = joins.split_dependencies(t.calls, members)
    return split.join(members.select(c("id").alias("from_id"), "file_id"), "from_id").groupBy("kind", "file_id").agg(F.count("*").alias("edges"))


@plan("r13_roll_up", """
SELECT array_to_string(list_slice(string_split(x.path, '/'), 2, 3), '/') AS module, count(DISTINCT x.id) AS files, count(f.id) AS functions FROM files x LEFT JOIN functions f ON f.file_id = x.id GROUP BY 1""")
def roll_up(t):
    n = t.functions.groupBy("file_id").agg(F.count("*").alias("n"))
    x = t.files.join(n, t.files.id == n.file_id, "left")
    return x.groupBy(T.last_directories(c("path")).alias("module")).agg(F.count("*").alias("files"), F.sum(F.coalesce("n", F.lit(0))).alias("functions"))


@plan("r15_integrity", """
SELECT (SELECT count(DISTINCT sha) FROM commits) AS known, (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT sha FROM commits)) AS missing, (SELECT count(DISTINCT sha) FROM commits WHERE sha NOT IN (SELECT o_orderkey FROM orders)) AS orphans""")
def integrity(t):
    shas, orders = t.commits.select("sha").distinct(), t.orders.select(c("o_orderkey").alias("sha"))
    one = lambda df, n: df.agg(F.count("*").alias(n))
    return one(shas, "known").crossJoin(one(store.missing(orders, shas, ["sha"]), "missing")).crossJoin(one(store.missing(shas, orders, ["sha"]), "orphans"))


@plan("t02_last_event", "SELECT files[1] AS path, max(seq) AS seq FROM ledger GROUP BY 1")
def last_event(t):
    return last_per_path(t.ledger.select(c("files")[0].alias("path"), "seq"), "path", "seq")


@plan("t03_live_filter", "SELECT seq FROM ledger WHERE event_type = 'error' AND list_has_any(files, ['src/f1.ts', 'src/f2.ts'])")
def live_filter(t):
    return t.ledger.filter(L.event_filter(types=["error"], files=["src/f1.ts", "src/f2.ts"])).select("seq")


@plan("t06_least_events", "SELECT session_id, count(*) AS events FROM ledger GROUP BY session_id HAVING count(*) >= 3")
def least_events(t):
    return t.ledger.groupBy("session_id").agg(F.count("*").alias("events")).filter("events >= 3")


@plan("t10_heat_state")
def heat_state(t):
    """The stateful fold of streaming.ledger.heat over a bounded replay."""
    import pandas as pd

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows, heat, last = rows.sort_values(["at", "seq"], kind="stable"), 0.0, None
        for at in rows["at"]:
            heat = min(1.0, heat * (0.95 ** ((at - last) / 3600.0) if last is not None else 1.0) + 0.1)
            last = at
        return pd.DataFrame({"session_id": [rows["session_id"].iloc[0]], "heat": [round(heat, 6)]})

    return t.ledger.select("session_id", "seq", "at").groupBy("session_id").applyInPandas(fold, "session_id long, heat double")


@plan("t12_sequence", 'SELECT seq, session_id, row_number() OVER (PARTITION BY session_id ORDER BY ledger."at", seq) AS number FROM ledger')
def sequence(t):
    return L.numbered(t.ledger).select("seq", "session_id", "number")


@plan("x02_type_references", "SELECT DISTINCT id, kind AS type FROM functions")
def type_references(t):
    return X.type_references(t.functions, F.array(c("kind"), F.lit("string"), c("kind"), F.lit("void")))


@plan("x04_imports", """
SELECT id AS from_id, CASE WHEN id = 'Brand#7' THEN 'lodash' ELSE '../m7/index' END AS spec, CASE WHEN id <> 'Brand#7' AND length(id) = 7 THEN 'Brand#7' END AS to_id,
       CASE WHEN id = 'Brand#7' THEN 'external' WHEN length(id) = 7 THEN 'file' ELSE 'unresolved' END AS kind FROM files""")
def imports(t):
    spec = F.when(c("id") == "Brand#7", "lodash").otherwise("../m7/index")
    return X.resolve_imports(t.files.select(c("id").alias("from_id"), spec.alias("spec")), t.files)


@plan("x09_escaping", """
WITH th AS (SELECT file_id AS id, start_line AS line, kind AS error FROM functions), tr AS (SELECT DISTINCT file_id AS id, 5 AS first, 20 AS last FROM functions WHERE length(file_id) = 7)
SELECT id, line, error FROM th WHERE NOT EXISTS (SELECT 1 FROM tr WHERE tr.id = th.id AND th.line BETWEEN tr.first AND tr.last)""")
def escaping(t):
    throws = t.functions.select(c("file_id").alias("id"), c("start_line").alias("line"), c("kind").alias("error"))
    tries = t.functions.filter(F.length("file_id") == 7).select(c("file_id").alias("id"), F.lit(5).alias("first"), F.lit(20).alias("last")).distinct()
    return X.escaping(throws, tries)


@plan("x13_cache", "SELECT doc_id FROM documents WHERE doc_id % 4 <> 0")
def cache(t):
    h = F.md5(c("text").cast("binary"))
    kept = t.documents.select("doc_id", c("doc_id").alias("file_id"), F.when(c("doc_id") % 4 == 0, "stale").otherwise(h).alias("hash"))
    return X.still_valid(kept, t.documents.select(c("doc_id").alias("file_id"), h.alias("hash"))).select("doc_id")


@plan("x14_patterns", f"""
WITH s AS (SELECT l_partkey AS entity, CASE WHEN l_linenumber % 2 = 0 THEN 'factory' ELSE 'observer' END AS pattern, l_quantity AS weight, l_returnflag = 'N' AS matched FROM lineitem),
p AS (SELECT entity, pattern, sum(CASE WHEN matched THEN weight ELSE 0 END) / sum(weight) AS c FROM s GROUP BY ALL)
SELECT entity, pattern, {R6.format('c')} AS confidence FROM p WHERE c >= 0.4""")
def patterns(t):
    s = t.lineitem.select(c("l_partkey").alias("entity"), F.when(c("l_linenumber") % 2 == 0, "factory").otherwise("observer").alias("pattern"), c("l_quantity").alias("weight"), (c("l_returnflag") == "N").alias("matched"))
    return X.patterns(s).withColumn("confidence", r6(c("confidence")))


@plan("x20_question_batch", "SELECT id, confidence FROM justifications WHERE pending ORDER BY confidence, id LIMIT 10")
def question_batch(t):
    return t.justifications.filter("pending").orderBy("confidence", "id").limit(10).select("id", "confidence")


@plan("x22_external_docs", "SELECT f.id, e.package, n.n_name AS place FROM functions f JOIN externals e ON e.from_id = f.id JOIN supplier s ON s.s_name = e.package JOIN nation n ON n.n_nationkey = s.s_nationkey WHERE f.is_exported")
def external_docs(t):
    ghosts = t.supplier.join(F.broadcast(t.nation), c("s_nationkey") == c("n_nationkey")).select(c("s_name").alias("package"), c("n_name").alias("place"))  # nations are 25
    used = t.externals.select(c("from_id").alias("id"), "package")
    return t.functions.filter("is_exported").select("id").join(used, "id").join(ghosts, "package").select("id", "package", "place")


@plan("x24_observed", "SELECT session_id, count(*) AS events, count(DISTINCT event_type) AS tools, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS names FROM ledger GROUP BY session_id")
def observed(t):
    return X.observed(t.ledger).withColumn("names", F.array_join("names", ","))


@plan("x25_spans", "SELECT l_returnflag AS span, count(*) AS n, quantile_disc(l_quantity, 0.5) AS p50, quantile_disc(l_quantity, 0.95) AS p95 FROM lineitem GROUP BY l_returnflag")
def spans(t):
    return L.timing(t.lineitem, "l_returnflag", "l_quantity", (0.5, 0.95)).select(c("l_returnflag").alias("span"), "n", "p50", "p95")


@plan("x26_hierarchy", """
SELECT r.r_name AS region, n.n_name AS nation, count(*) AS customers FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY ROLLUP (r.r_name, n.n_name)""")
def hierarchy(t):
    small = t.nation.join(F.broadcast(t.region), c("n_regionkey") == c("r_regionkey")).select("n_nationkey", c("n_name").alias("nation"), c("r_name").alias("region"))
    joined = t.customer.join(F.broadcast(small), c("c_nationkey") == c("n_nationkey"))  # 25 rows
    return joined.rollup("region", "nation").agg(F.count("*").alias("customers"))


@plan("r8_distribution", """
SELECT CASE WHEN n >= 5 THEN 'busy' WHEN n >= 3 THEN 'usual' ELSE 'quiet' END AS kind, count(*) AS sessions FROM (SELECT session_id, count(*) AS n FROM ledger GROUP BY session_id) x GROUP BY 1""")
def distribution(t):
    n = t.ledger.groupBy("session_id").agg(F.count("*").alias("n"))
    return n.groupBy(N.tiers(c("n"), [(5, "busy"), (3, "usual")], "quiet").alias("kind")).agg(F.count("*").alias("sessions"))


@plan("a30_relation_counts", "SELECT 'justifications' AS relation, count(*) AS n FROM justifications UNION ALL SELECT 'ledger', count(*) FROM ledger UNION ALL SELECT 'commits', count(*) FROM commits")
def relation_counts(t):
    parts = [t(n).agg(F.count("*").alias("n")).select(F.lit(n).alias("relation"), "n") for n in ("justifications", "ledger", "commits")]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


@plan("w12_running", "SELECT session_id, seq, count(*) OVER (PARTITION BY session_id ORDER BY seq) AS n FROM ledger")
def running(t):
    return t.ledger.select("session_id", "seq", F.count("*").over(Window.partitionBy("session_id").orderBy("seq")).alias("n"))
