"""Readings of code, learnt rules, answers, dependency orders, merged clusters and retention."""

import pytest
from pyspark.sql import functions as F

from graphloom.operators import code as K
from graphloom.operators import graph as G
from graphloom.operators import ledger as L
from graphloom.operators import memory as M
from graphloom.operators import search as S
from graphloom.sources.tables import Catalog


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    "body, score",
    [
        (None, 1),
        ("", 1),
        ("return a", 1),
        ("if (a && b || c) {}", 4),
        ("do { x() } while (y)", 2),
        ("x?.y ?? z", 1),
        ("a ? b : c", 2),
        ("p.catch(e => 1)", 1),
        ("try { f() } catch (e) { }", 2),
        ("switch (x) { case 1: break; case 2: }", 3),
        ("// if while\n/* for\ncase */ g('if && \\' for')", 1),
        ("const $if = 1; a.while; notfor(b)", 1),
        ("if (a) " * 20_000, 20_001),
        ("s = \"" + "\\n" * 50_000 + "\"; if (a) {}", 2),
    ],
)
def test_complexity(spark, body, score):
    assert one(spark, body, K.complexity) == score


@pytest.mark.parametrize(
    "body, want",
    [
        (None, (0, "void", False, False)),
        ("throw new Error()", (0, "void", False, True)),
        ("return;", (1, "void", True, False)),
        ("return f(); }", (1, "unknown", False, False)),
        ("if (a) return null\nreturn { a: 1 }", (2, "null | object", True, False)),
        ("return true; return false", (2, "boolean", False, False)),
        ("return x; return 'a'", (2, "string", False, False)),
        ("returned = 1 // throw", (0, "void", False, False)),
    ],
)
def test_returns(spark, body, want):
    row = K.returns(spark.createDataFrame([(body,)], "body string")).first()
    assert (row.points, row.inferred_type, row.can_be_null, row.always_throws) == want


def test_declared_type_stands(spark):
    rows = spark.createDataFrame([("return 1", "Foo"), ("return 1", ""), ("return 1", None)], "body string, kind string")
    assert [r.inferred_type for r in K.returns(rows, declared="kind").collect()] == ["Foo", "number", "number"]


@pytest.mark.parametrize(
    "call, want",
    [
        (None, None),
        ("add(1)", None),
        ("FS.ReadFile(p)", ("io-file", "high")),
        ("axios.get(u)", ("io-network", "high")),
        ("db.findOne()", ("io-database", "high")),
        ("this.setName(n)", ("mutation-this", "medium")),
        ("storeAll()", ("io-file", "low")),
        ("bus.emit('x')", ("event-emission", "medium")),
    ],
)
def test_effect(spark, call, want):
    got = one(spark, call, K.effect)
    assert (got and tuple(got)) == want


def test_dependency_order(spark):
    pairs = [(0, 1), (1, 2), (2, 1), (3, 0), (2, 4), (5, 5)]
    nodes = spark.createDataFrame([(i,) for i in range(7)], "id long")
    rows = {r.id: r for r in G.dependency_order(spark.createDataFrame(pairs, "from_id long, to_id long"), nodes).collect()}
    assert sorted(r.place for r in rows.values()) == list(range(1, 8))
    assert {i for i, r in rows.items() if r.on_cycle} == {1, 2, 5}
    for a, b in [(0, 1), (3, 0), (2, 4), (0, 2), (1, 4)]:
        assert rows[b].place < rows[a].place
    assert rows[1].level == rows[2].level


def test_clusters_limit_and_cohesion(spark):
    pairs = spark.createDataFrame([(1, 2, 0.8), (1, 3, 0.6), (4, 5, 0.9), (2, 4, 0.9)], "a long, b long, similarity double")
    members = spark.createDataFrame([(i,) for i in range(7)], "id long")
    every = S.greedy_clusters(pairs, members)
    assert {(r.cluster, r.members, round(r.cohesion, 6)) for r in S.cohesion(every).collect()} == {(1, 3, 0.7), (4, 2, 0.9)}
    assert {r.cluster for r in S.greedy_clusters(pairs, members, most=1).collect()} == {1}
    alone = S.cohesion(S.greedy_clusters(pairs, members, smallest=1)).filter("cluster = 0").first()
    assert (alone.members, alone.cohesion) == (1, None)


def test_merge_similar(spark):
    clusters = spark.createDataFrame([(1, "a", 0.2, 3), (2, "b", 0.9, 4), (3, "c", 0.5, 5)], "id long, intent string, confidence double, events long")
    pairs = spark.createDataFrame([(1, 2, 0.8), (2, 3, 0.9), (1, 3, 0.1)], "a long, b long, similarity double")
    got = {tuple(r) for r in L.merge_similar(clusters, pairs, 0.5).select("id", "intent", "members", "events", "confidence").collect()}
    assert got == {(1, "a", 2, 7, 0.9), (3, "c", 1, 5, 0.5)}


def test_maintain(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path / "catalog"))
    schema = "seq long, at double, session_id long, event_type string, source string, files array<string>, entity_ids array<long>"
    events = [(i, float(i), i // 5, "click", "change", [f"f{i}.ts"], [i]) for i in range(20)]
    catalog.replace("ledger", spark.createDataFrame(events, schema))
    L.maintain(catalog, "ledger", "compacted", 10.0)
    assert {r.session_id for r in catalog("ledger").collect()} == {2, 3}
    assert {(r.session_id, r.events, r.files) for r in catalog("compacted").collect()} == {(0, 5, 5), (1, 5, 5)}
    L.maintain(catalog, "ledger", "compacted", 10.0)  # once more changes nothing
    assert catalog("ledger").count() == 10 and catalog("compacted").count() == 2


def test_learnt_rules(spark):
    rows = spark.createDataFrame(
        [(1, "a\nvar x\nb", "a\nlet x\nc", "p/q.r/s.ts"), (2, "a", "a", "x.py"), (3, None, "a", "x"), (4, "\n", "x\ny", "x"), (5, "f(a)  + 1", "g", "Makefile")],
        "id long, before string, after string, path string",
    )
    got = {r.id: r for r in M.from_changes(rows, ["id"]).collect()}
    assert set(got) == {1, 5}
    assert (got[1].trigger, got[1].rule, got[1].confidence) == ("*.ts", 'Prefer "let x" over "var x"', 0.6)
    assert got[5].trigger == "*"
    refactor = {r.id: r for r in M.from_changes(rows, ["id"], refactor=True).collect()}
    assert refactor[5].trigger == r"f\(a\)\s*\+\s*1" and refactor[5].scope == "project"
    messages = spark.createDataFrame([(1, "Cannot find module 'x'"), (2, "other"), (3, None)], "id long, message string")
    assert [(r.id, r.trigger) for r in M.from_failures(messages, ["id"]).collect()] == [(1, "import.*from")]
    told = spark.createDataFrame([(1, "Never use the default export", "file", "style"), (2, "", "file", "style")], "id long, instruction string, scope string, category string")
    assert [r.trigger for r in M.from_instructions(told, ["id"]).orderBy("id").collect()] == ["default|export", ""]


def test_answers(spark):
    rows = spark.createDataFrame(
        [("a-b", None, "v", "f", "d", 0.3, True), ("c", None, None, "f", None, 0.9, True), ("e", "p", "v", "f", None, 0.1, True)],
        "id string, purpose string, business_value string, feature string, detail string, confidence double, pending boolean",
    )
    answers = spark.createDataFrame(
        [("a-b-purpose", "x"), ("a-b-purpose", "x"), ("a-b-naming", "n"), ("c-feature_context", "g"), ("nobody-purpose", "y")], "question string, answer string"
    )
    got = {r.id: r for r in M.apply_answers(rows, answers).collect()}
    assert (got["a-b"].purpose, got["a-b"].detail, round(got["a-b"].confidence, 6), got["a-b"].pending) == ("x", "d\nnaming: n", 0.9, False)
    assert (got["c"].feature, got["c"].confidence, got["c"].pending) == ("g", 1.0, True)
    assert (got["e"].confidence, got["e"].level, got["e"].pending) == (0.1, "uncertain", True)


@pytest.mark.parametrize(
    "condition, rule",
    [(None, None), ("!x || x == null", "non-null"), ("typeof x !== 'number'", "must be number"), ("Array.isArray(x)", "must be array"), ("x.length === 0", "must be empty"), ("x < 0", "negative"), ("x >= 0", "non-negative"), ("x", None)],
)
def test_validation_rule(spark, condition, rule):
    assert one(spark, condition, K.validation_rule) == rule
