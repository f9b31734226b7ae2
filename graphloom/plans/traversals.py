"""Graph traversal, hierarchies, vectors, fused search, request understanding."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import numeric as N
from graphloom.operators import graph as G
from graphloom.operators import search as S
from graphloom.plans.analytics import R6, r6
from graphloom.plans.registry import Plans

PLANS = Plans()
plan = PLANS.plan


@plan("g01_closure", """
WITH RECURSIVE reach AS (SELECT to_id AS id FROM calls WHERE from_id = (SELECT id FROM hub) UNION SELECT c.to_id FROM reach r JOIN calls c ON c.from_id = r.id)
SELECT id FROM reach""")
def closure(t):
    return G.reach(t.calls, t.hub).select("id")


@plan("g02_reverse_closure", """
WITH RECURSIVE reach AS (SELECT from_id AS id FROM calls WHERE to_id = (SELECT id FROM hub) UNION SELECT c.from_id FROM reach r JOIN calls c ON c.to_id = r.id)
SELECT id FROM reach""")
def reverse_closure(t):
    return G.reach(G.reverse(t.calls), t.hub).select("id")


@plan("g03_import_chain", """
WITH RECURSIVE walk AS (SELECT DISTINCT to_id AS id, 1 AS depth FROM imports WHERE from_id = 'Brand#7'
  UNION SELECT i.to_id, w.depth + 1 FROM walk w JOIN imports i ON i.from_id = w.id WHERE w.depth < 4) SELECT id, depth FROM walk""")
def import_chain(t):
    start = t.files.filter("id = 'Brand#7'").select("id")
    return G.chain(t.imports, start, 4)


@plan("g05_blast_radius", """
WITH RECURSIVE walk AS (SELECT id, 0 AS depth FROM hub UNION SELECT c.from_id, w.depth + 1 FROM walk w JOIN calls c ON c.to_id = w.id WHERE w.depth < 3),
d AS (SELECT id, min(depth) AS depth FROM walk GROUP BY id)
SELECT d.id, d.depth, min(c.to_id) AS via FROM d JOIN calls c ON c.from_id = d.id JOIN d p ON p.id = c.to_id AND p.depth = d.depth - 1 WHERE d.depth > 0 GROUP BY d.id, d.depth""")
def blast_radius(t):
    return G.blast_radius(t.calls, t.hub, 3, "callers")


@plan("g06_one_hop", "SELECT from_id, to_id FROM calls WHERE from_id = (SELECT id FROM hub) OR to_id = (SELECT id FROM hub)")
def one_hop(t):
    hub = F.broadcast(t.hub)  # one row
    return t.calls.join(hub, (F.col("from_id") == F.col("id")) | (F.col("to_id") == F.col("id"))).select("from_id", "to_id")


@plan("g07_dependency_graph", """
SELECT DISTINCT from_id, to_id FROM (
  SELECT from_id, to_id FROM calls UNION ALL SELECT a.id, b.id FROM functions a JOIN functions b ON b.id = a.id + 1 AND a.file_id = b.file_id) x
WHERE from_id IN (SELECT id FROM functions WHERE complexity > 10) AND to_id IN (SELECT id FROM functions WHERE complexity > 10)""")
def dependency_graph(t):
    a = t.functions.select(F.col("id").alias("from_id"), F.col("file_id").alias("fa"))
    b = t.functions.select((F.col("id") - 1).alias("from_id"), F.col("id").alias("to_id"), F.col("file_id").alias("fb"))
    siblings = a.join(b, "from_id").filter("fa = fb").select("from_id", "to_id")
    edges = t.calls.select("from_id", "to_id").unionAll(siblings).distinct()
    return G.valid_edges(edges, t.functions.filter("complexity > 10")).select("from_id", "to_id")


LEVELS = """
WITH RECURSIVE e AS (SELECT DISTINCT parent_id AS f, id AS t FROM justifications WHERE parent_id IS NOT NULL AND parent_id <> id),
walk AS (SELECT id, 0 AS depth FROM justifications UNION SELECT e.t, w.depth + 1 FROM walk w JOIN e ON e.f = w.id WHERE w.depth < 30)
SELECT id, CAST(max(depth) AS INT) AS level, id = 0 AND FALSE AS on_cycle FROM walk GROUP BY id"""


@plan("g08_levels", LEVELS)
def levels(t):
    j = t.justifications
    edges = j.filter("parent_id IS NOT NULL AND parent_id != id").select(F.col("parent_id").alias("from_id"), F.col("id").alias("to_id"))
    return G.topological_levels(edges, j)


CONDENSED = """
WITH RECURSIVE e AS (SELECT from_id, to_id FROM imports),
r AS (SELECT from_id AS a, to_id AS b FROM e UNION SELECT r.a, e.to_id FROM r JOIN e ON e.from_id = r.b)
SELECT f.id, least(f.id, COALESCE(min(x.b), f.id)) AS component FROM files f LEFT JOIN (SELECT r.a, r.b FROM r JOIN r q ON q.a = r.b AND q.b = r.a) x ON x.a = f.id GROUP BY f.id"""


@plan("g09_strong_components", CONDENSED)
def strong_components(t):
    return G.strong_components(t.imports, t.files)


@plan("g10_cycles")
def cycles(t):
    pairs = t.imports.select("from_id", "to_id")
    found = G.small_cycles(pairs)  # refuses more than ten thousand edges
    rows = [(i, " -> ".join([*c, c[0]]), len(c)) for i, c in enumerate(found)]
    return t.spark.createDataFrame(rows, "cycle int, path string, length int")


@plan("g11_ancestors", """
WITH RECURSIVE up AS (SELECT id, parent_id AS ancestor, 1 AS steps FROM justifications WHERE parent_id IS NOT NULL
  UNION ALL SELECT u.id, j.parent_id, u.steps + 1 FROM up u JOIN justifications j ON j.id = u.ancestor WHERE j.parent_id IS NOT NULL AND u.steps < 10)
SELECT id, ancestor, steps FROM up""")
def ancestors(t):
    return G.ancestors(t.justifications, t.justifications, 10)


@plan("g12_children", "SELECT parent_id, count(*) AS children, array_to_string(list_sort(list(id)), ',') AS ids FROM justifications WHERE parent_id IS NOT NULL GROUP BY parent_id")
def children(t):
    return t.justifications.filter("parent_id IS NOT NULL").groupBy("parent_id").agg(
        F.count("*").alias("children"), F.array_join(F.array_sort(F.collect_list("id")), ",").alias("ids")
    )


@plan("g14_propagate_down", f"""
SELECT j.id, COALESCE(NULLIF(j.feature, ''), p.feature) AS feature, {R6.format('CASE WHEN p.confidence > 0.7 THEN least(1.0, j.confidence + 0.1) ELSE j.confidence END')} AS confidence
FROM justifications j LEFT JOIN justifications p ON j.parent_id = p.id""")
def propagate_down(t):
    j = t.justifications.select("id", "parent_id", "feature", "confidence")
    return G.propagate_down(j).select("id", "feature", r6(F.col("confidence")).alias("confidence"))


@plan("g15_taint", """
WITH RECURSIVE e AS (SELECT DISTINCT from_id, to_id FROM calls WHERE is_await), src AS (SELECT DISTINCT from_id AS id FROM e WHERE from_id % 50 = 1),
walk AS (SELECT id AS source, id FROM src UNION SELECT w.source, e.to_id FROM walk w JOIN e ON e.from_id = w.id)
SELECT source, id FROM walk WHERE id NOT IN (SELECT from_id FROM e)""")
def taint(t):
    flagged = t.calls.filter("is_await")
    sources = flagged.filter("from_id % 50 = 1").select(F.col("from_id").alias("id")).distinct()
    return G.propagate(flagged, sources).select("source", "id")


@plan("g16_inputs", """
WITH RECURSIVE e AS (SELECT from_id, to_id FROM imports), back AS (SELECT id FROM files WHERE id IN ('Brand#3', 'Brand#9') UNION SELECT e.from_id FROM back b JOIN e ON e.to_id = b.id)
SELECT id FROM back WHERE id NOT IN ('Brand#3', 'Brand#9')""")
def inputs(t):
    start = t.files.filter("id IN ('Brand#3', 'Brand#9')").select("id")
    return G.blast_radius(t.imports, start, most=None, direction="callers").select("id")


@plan("g18_path", """
WITH RECURSIVE r AS (SELECT from_id AS a, to_id AS b FROM imports WHERE from_id IN ('Brand#1', 'Brand#2') UNION SELECT r.a, i.to_id FROM r JOIN imports i ON i.from_id = r.b),
p AS (SELECT a.id AS source, b.id AS target FROM files a JOIN files b ON a.id IN ('Brand#1', 'Brand#2') AND a.id <> b.id)
SELECT p.source, p.target, r.a IS NOT NULL AS found FROM p LEFT JOIN r ON r.a = p.source AND r.b = p.target""")
def path(t):
    a = t.files.filter("id IN ('Brand#1', 'Brand#2')").select(F.col("id").alias("source"))
    pairs = t.files.select(F.col("id").alias("target")).join(F.broadcast(a), F.col("source") != F.col("target")).select("source", "target")  # two rows
    return G.path_exists(t.imports, pairs)


@plan("g19_leaves", "SELECT id FROM functions WHERE id NOT IN (SELECT from_id FROM calls) AND id IN (SELECT to_id FROM calls)")
def leaves(t):
    return G.degrees(t.calls, t.functions).filter("outgoing = 0 AND incoming > 0").select("id")


@plan("g20_export", """
WITH n AS (SELECT id FROM functions ORDER BY complexity DESC, id LIMIT 200)
SELECT c.from_id, c.to_id, f.name AS from_name FROM calls c JOIN functions f ON c.from_id = f.id WHERE c.from_id IN (SELECT id FROM n) AND c.to_id IN (SELECT id FROM n)""")
def export(t):
    nodes = t.functions.orderBy(F.desc("complexity"), "id").limit(200).select("id", "name")
    return G.valid_edges(t.calls, nodes).join(nodes, F.col("from_id") == F.col("id")).select("from_id", "to_id", F.col("name").alias("from_name"))


def first_vector(t):
    return F.broadcast(t.embeddings.filter("vec_id = 0").select(F.col("embedding").alias("q")))  # one row


VECTORS = "v AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), q AS (SELECT e AS q FROM v WHERE id = 0)"


@plan("v02_knn_l2", f"WITH {VECTORS} SELECT id, {R6.format('list_distance(e, q)')} AS distance FROM v, q ORDER BY list_distance(e, q), id LIMIT 10")
def knn_l2(t):
    vectors = t.embeddings.select(F.col("vec_id").alias("id"), "embedding").crossJoin(first_vector(t))
    return S.knn(vectors, F.col("q"), 10).select("id", r6(F.col("distance")).alias("distance"))


@plan("v03_within", f"WITH {VECTORS} SELECT id FROM v, q WHERE list_distance(e, q) < 1.2 ORDER BY list_distance(e, q), id LIMIT 50")
def within(t):
    vectors = t.embeddings.select(F.col("vec_id").alias("id"), "embedding").crossJoin(first_vector(t))
    return S.knn(vectors.filter(N.l2(F.col("embedding"), F.col("q")) < 1.2), F.col("q"), 50).select("id")


@plan("v04_similar", f"""
WITH {VECTORS}, c AS (SELECT id, label, list_cosine_similarity(e, q) AS s FROM v, q ORDER BY 1 - s, id LIMIT 40)
SELECT id, {R6.format('s')} AS similarity FROM c WHERE id <> 0 AND s >= 0.1 AND label IN (0, 1, 2, 3, 4, 5) ORDER BY s DESC, id LIMIT 20""")
def similar(t):
    v = t.embeddings.select(F.col("vec_id").alias("id"), "embedding", F.col("label").alias("kind")).crossJoin(first_vector(t))
    return S.similar_entities(v, F.col("q"), 20, [0], 0.1, [0, 1, 2, 3, 4, 5]).select("id", r6(F.col("similarity")).alias("similarity"))


@plan("v05_cosine", f"WITH {VECTORS} SELECT id, {R6.format('list_cosine_similarity(e, q)')} AS similarity FROM v, q")
def cosine(t):
    v = t.embeddings.crossJoin(first_vector(t))
    return v.select(F.col("vec_id").alias("id"), r6(N.cosine(F.col("embedding"), F.col("q"))).alias("similarity"))


@plan("v06_pairs", f"""
WITH {VECTORS}, s AS (SELECT * FROM v)
SELECT a.id AS a, b.id AS b, {R6.format('list_cosine_similarity(a.e, b.e)')} AS similarity FROM s a JOIN s b ON a.id < b.id WHERE list_cosine_similarity(a.e, b.e) >= 0.3""")
def pairs(t):
    v = t.embeddings.select(F.col("vec_id").alias("id"), "embedding")
    return S.all_cosine_pairs(v, 0.3).withColumn("similarity", r6(F.col("similarity")))


@plan("v06_clusters")
def clusters(t):
    v = t.embeddings.select(F.col("vec_id").alias("id"), "embedding")
    return S.cosine_clusters(v, 0.3)


@plan("v08_lexical", """
SELECT doc_id, (length(text) - length(replace(lower(text), 'license', ''))) // 7 AS hits FROM documents WHERE contains(lower(text), 'license') ORDER BY hits DESC, doc_id LIMIT 50""")
def lexical(t):
    return S.lexical(t.documents, "license", "doc_id").limit(50)


FUSED = """
s AS (SELECT file_id AS file, row_number() OVER (ORDER BY complexity DESC, id) - 1 AS rank FROM functions QUALIFY row_number() OVER (ORDER BY complexity DESC, id) <= 30),
l AS (SELECT file_id AS file, row_number() OVER (ORDER BY price DESC, id) - 1 AS rank FROM functions WHERE contains(name, 'red') QUALIFY row_number() OVER (ORDER BY price DESC, id) <= 30),
u AS (SELECT file, rank, 'semantic' AS engine FROM s UNION ALL SELECT file, rank, 'lexical' FROM l),
f AS (SELECT file, sum(CASE WHEN engine = 'semantic' THEN 1.0 / (40 + rank) ELSE 1.0 / (80 + rank) END::DOUBLE) AS score, min(rank) FILTER (WHERE engine = 'semantic') AS sr, min(rank) FILTER (WHERE engine = 'lexical') AS lr FROM u GROUP BY file)"""


def fused(t):
    from graphloom.operators.windows import ranked

    def ranks(df, c):
        return ranked(df.orderBy(F.desc(c), "id").limit(30), [F.desc(c), F.col("id")]).select(F.col("file_id").alias("file"), "rank")

    intent = S.query_intent("where is parseConfig defined")
    return S.fuse(ranks(t.functions, "complexity"), ranks(t.functions.filter(F.col("name").contains("red")), "price"), intent)


@plan("v09_fusion", f"""WITH {FUSED} SELECT file, {R6.format('score')} AS score, CASE WHEN lr IS NULL OR sr <= lr THEN 'semantic' ELSE 'lexical' END AS source FROM f""")
def fusion(t):
    return fused(t).select("file", r6(F.col("score")).alias("score"), "source")


BOOSTED = FUSED + """,
m AS (SELECT id, members FROM files),
b AS (SELECT file, score * CASE WHEN file LIKE '%#1%' THEN 1.5 ELSE 1.0 END * CASE WHEN sr IS NOT NULL THEN 1.1 ELSE 1.0 END * (1 + 0.1 * log2(1 + members)) AS score FROM f JOIN m ON m.id = f.file)"""


@plan("v10_boosted", f"WITH {BOOSTED} SELECT file, {R6.format('score / (SELECT max(score) FROM b)')} AS score FROM b ORDER BY score DESC, file LIMIT 10")
def boosted(t):
    joined = fused(t).join(t.files.select(F.col("id").alias("file"), "members"), "file")
    b = S.boosted(joined, F.col("file").contains("#1"), F.col("members"))
    return S.normalised(b, 10).select("file", r6(F.col("score")).alias("score"))


@plan("v17_relevance", f"""
SELECT f.id, {R6.format("least(1.0, 0.5 + CASE WHEN f.name = 'red widget' THEN 0.3 ELSE 0.1 * (CASE WHEN contains(f.name, 'red') THEN 0.5 ELSE 0 END + CASE WHEN contains(f.name, 'widget') THEN 0.5 ELSE 0 END) END + CASE WHEN contains(f.file_id, '7') THEN 0.2 ELSE 0 END + CASE WHEN f.is_exported THEN 0.05 ELSE 0 END + least(0.3, f.complexity / 50.0) + least(0.3, COALESCE(c.callers, 0) / 100.0))")} AS score
FROM functions f LEFT JOIN callers c ON f.id = c.id""")
def relevance(t):
    f = t.functions.join(t.callers, "id", "left")
    words = F.array(F.lit("red"), F.lit("widget"))
    share = F.size(F.filter(words, lambda w: F.contains(F.col("name"), w))) / F.size(words)
    score = S.relevance(
        F.col("name") == "red widget", share, F.col("file_id").contains("7"), F.col("is_exported"), F.col("complexity"), F.coalesce("callers", F.lit(0))
    )
    return f.select("id", r6(score).alias("score"))


@plan("v20_similarity", f"WITH {VECTORS} SELECT id, {R6.format('1 / (1 + list_distance(e, q))')} AS similarity FROM v, q")
def similarity(t):
    v = t.embeddings.crossJoin(first_vector(t))
    return v.select(F.col("vec_id").alias("id"), r6(1 / (1 + N.l2(F.col("embedding"), F.col("q")))).alias("similarity"))


@plan("v21_mrr", f"""
WITH e AS (SELECT seq AS query, CASE WHEN seq % 10 = 0 THEN [] ELSE files END AS paths FROM ledger),
r AS (SELECT e.query, k.rank, concat('src/f', CAST((e.query + k.rank * 3) % 53 AS VARCHAR)) AS path FROM e, (SELECT unnest(range(0, 8)) AS rank) k),
h AS (SELECT e.query, min(r.rank + 1) AS first FROM e JOIN r ON r.query = e.query WHERE len(list_filter(e.paths, lambda p: contains(p, r.path) OR contains(r.path, p))) > 0 GROUP BY e.query)
SELECT e.query, {R6.format('CASE WHEN len(e.paths) = 0 THEN 1.0 ELSE COALESCE(1.0 / h.first, 0) END')} AS reciprocal_rank FROM e LEFT JOIN h ON h.query = e.query""")
def mrr(t):
    empty = F.array().cast("array<string>")
    e = t.ledger.select(F.col("seq").alias("query"), F.when(F.col("seq") % 10 == 0, empty).otherwise(F.col("files")).alias("paths"))
    r = e.select("query", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k")).select(
        "query", (F.col("k") + 1).alias("rank"), F.concat(F.lit("src/f"), ((F.col("query") + F.col("k") * 3) % 53).cast("string")).alias("path")
    )
    return S.mean_reciprocal_rank(r, e).select("query", r6(F.col("reciprocal_rank")).alias("reciprocal_rank"))


@plan("v22_test_match", """
SELECT d.doc_id, CASE WHEN contains(text, 'license') THEN 'high' WHEN contains(text, 'the') THEN 'medium' WHEN contains(source, 'license') THEN 'low' END AS confidence FROM documents d""")
def test_match(t):
    return t.documents.select("doc_id", S.test_match(F.col("source"), F.col("text"), F.lit("the"), F.lit("license")).alias("confidence"))


@plan("v24_memories", """
WITH m AS (SELECT id, confidence, 0 AS list, row_number() OVER (ORDER BY confidence DESC, id) AS rank FROM justifications WHERE list_contains(tags, 't1')
  UNION ALL SELECT id, confidence, 1, row_number() OVER (ORDER BY confidence DESC, id) FROM justifications WHERE feature = 'src2' UNION ALL SELECT id, confidence, 2, row_number() OVER (ORDER BY confidence DESC, id) FROM justifications WHERE kind = 'es')
SELECT id, confidence FROM (SELECT DISTINCT id, confidence FROM m) x ORDER BY confidence DESC, id LIMIT 20""")
def memories(t):
    j = t.justifications
    kinds = [F.array_contains("tags", "t1"), F.col("feature") == "src2", F.col("kind") == "es"]
    found = j.filter(kinds[0] | kinds[1] | kinds[2])  # the lists' union, each row once
    return found.orderBy(F.desc("confidence"), "id").limit(20).select("id", "confidence")


@plan("v16_most_complex", "SELECT id, name, complexity FROM functions ORDER BY complexity DESC, id LIMIT 20")
def most_complex(t):
    from graphloom.operators.language import answer

    return answer("what are the most complex functions", t).select("id", "name", "complexity")


@plan("v16_callers_of", "SELECT DISTINCT a.id, a.name FROM calls c JOIN functions a ON c.from_id = a.id JOIN functions b ON c.to_id = b.id WHERE contains(lower(b.name), 'red widget')")
def callers_of(t):
    from graphloom.operators.language import answer

    return answer("who calls red widget", t).select("id", "name")
