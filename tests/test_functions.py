"""Expressions with the values that they must give."""

import pytest
from pyspark.sql import functions as F

from graphloom.functions import numeric as N
from graphloom.functions import text as T
from graphloom.operators import ledger as L
from graphloom.operators import predicates as P
from graphloom.operators import reports as R
from graphloom.operators import search as S
from graphloom.operators import store, windows
from graphloom.operators.builder import Query
from graphloom.operators.language import understand


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize("x, want", [(2.5, 3), (-2.5, -2), (0.49, 0), (-0.5, 0)])
def test_half_up(spark, x, want):
    assert value(spark, N.half_up(F.lit(x))) == want


def test_vectors(spark):
    a, b = F.array(*map(F.lit, [1.0, 0.0])), F.array(*map(F.lit, [3.0, 4.0]))
    assert value(spark, N.cosine(a, b)) == pytest.approx(0.6)
    assert value(spark, N.l2(a, b)) == pytest.approx(20**0.5)
    assert value(spark, N.cosine(a, F.array(F.lit(0.0), F.lit(0.0)))) == 0 == value(spark, N.cosine(a, F.array(F.lit(1.0))))


@pytest.mark.parametrize(
    "path, want",
    [("src/core/graph/x.ts", "src/core/graph"), ("src/x.ts", "src"), ("a/src/b/c/d.ts", "src/b/c"), ("docs/a/b.md", "docs/a"), ("x.ts", "x.ts"), ("", "root")],
)
def test_module_path(spark, path, want):
    assert value(spark, T.module_path(F.lit(path))) == want


@pytest.mark.parametrize("spec, want", [("node:fs", "fs"), ("@a/b/c", "@a/b"), ("lodash/fp", "lodash"), ("x", "x")])
def test_package(spark, spec, want):
    assert value(spark, T.package_name(F.lit(spec))) == want


def test_ids_skip_empty_parts(spark):
    import hashlib

    want = hashlib.sha256(b"a.ts:function:f").hexdigest()[:16]
    assert value(spark, T.entity_id(F.lit("a.ts"), F.lit("function"), F.lit(""), F.lit("f"))) == want
    assert (T.snake("startLineNo"), T.camel("start_line_no")) == ("start_line_no", "startLineNo")


@pytest.mark.parametrize("m, want", [("feat: add user authentication", "feature-development"), ("core(fix): x", "bug-fix"), ("misc", "unknown")])
def test_commit_intent(spark, m, want):
    assert value(spark, T.commit_intent(F.lit(m))) == want


@pytest.mark.parametrize(
    "name, lines, want",
    [("getName", 3, "simple_getter"), ("getName", 4, None), ("isAuthorized", 2, None), ("setValue", None, "simple_setter"), ("toJSON", 90, "standard_accessor"),
     ("constructor", 5, "simple_constructor"), ("run", 1, "very_short_function"), ("_helper", 40, "trivial_utility"), ("compute", 20, None), ("checkToken", 1, None)],
)
def test_trivial(spark, name, lines, want):
    assert value(spark, P.trivial_function(F.lit(name), F.lit(lines).cast("int"))) == want


@pytest.mark.parametrize(
    "q, want",
    [("where is parseConfig defined", "definition"), ("class UserService", "definition"), ("who calls foo", "usage"), ("where is foo used", "usage"),
     ("how does login work", "conceptual"), ("Where is the authentication logic?", "conceptual"), ("parseConfig", "keyword"), ("what now?", "conceptual"), ("go to definition", "definition"), ("references to parse", "usage"), ("class usage in app", "keyword"),
     ("where is it", "conceptual"), ("design of the store", "conceptual"), ("", "keyword")],
)
def test_query_intent(q, want):
    assert S.query_intent(q) == want


@pytest.mark.parametrize(
    "q, intent, target",
    [("what calls parse", "show_callers", "parse"), ("what does main call", "show_callees", "main"), ("files that import utils", "show_importers", "utils"),
     ("most complex functions", "rank_complexity", None), ("largest files", "rank_size", None), ("where is login", "find_location", "login"),
     ("methods of User", "show_methods", "User"), ("interface Shape", "find_class", "Shape"), ("callers stuff", "show_callers", None), ("foo bar", "find_location", "foo bar"), ("", "unknown", None)],
)
def test_understand_said_plainly(q, intent, target):
    test_understand(q, intent, target)


@pytest.mark.parametrize(
    "q, intent, target",
    [("callers of createParser", "show_callers", "createParser"), ("what does index.ts import", "show_imports", "index.ts"), ("what imports UserService", "show_importers", "UserService"),
     ("main calls what", "show_callees", "main"), ("classes that extend Error", "show_hierarchy", "Error"), ("what implements IParser", "show_hierarchy", "IParser"),
     ("implementations of Store", "show_hierarchy", "Store"), ("UserService methods", "show_methods", "UserService"), ("how does authentication work", "explain", "authentication"),
     ("explain the parser?", "explain", "the parser"), ("where is login implemented", "find_location", "login"), ("find @decorator function", "find_location", "@decorator function"),
     ("complexity over 10", "rank_complexity", "10"), ("most called functions", "rank_calls", None), ("functions in src/core/parser/", "filter_scope", "src/core/parser/"),
     ("external dependencies", "find_dependencies", None), ("what uses lodash", "find_dependencies", "lodash"), ("dependencies of app", "find_dependencies", "app"),
     ("functions like parse", "semantic_search", "parse"), ("function createParser", "find_function", "createParser"), ("class UserService", "find_class", "UserService"),
     ("file index", "find_file", "index"), ("imports analysis", "show_imports", None), ("extends BaseClass", "show_hierarchy", None), ("top used things", "rank_calls", None),
     ("all interfaces", "find_class", None), ("authentication functions", "find_function", None)],
)
def test_understand(q, intent, target):
    got = understand(q)
    assert (got.intent, got.target) == (intent, target)


def test_scores(spark):
    n = lambda x: F.lit(x)
    assert value(spark, R.risk_score(n(True), n(40), n(50), n(20), n(0.1))) == 92
    assert value(spark, R.return_on_effort(n(2), n(4.0))) == 3.0 and value(spark, R.return_on_effort(n(0), n(4.0))) == 0
    assert value(spark, R.test_quality(n(0.1), n(0.9), n(0.1), n(False), n(True))) == 0
    assert value(spark, R.pull_request_score(n(90), n(1.5), n(1.5))) == 100
    assert value(spark, R.god_class(n(60), n(15))) == "CRITICAL" and value(spark, R.change_frequency(n(30))) == "Daily or more"
    assert value(spark, L.impact(n(1), n(4), n(0))) == "medium" and value(spark, L.impact(n(0), n(5), n(0))) == "low"
    assert value(spark, L.reinforced(n(0.95), n(1), n(1))) == pytest.approx(0.85)


def test_nearest_rank(spark):
    rows = spark.createDataFrame([(float(i),) for i in range(1, 11)] , "v double").withColumn("k", F.lit(1))
    r = L.timing(rows, "k", "v").first()
    assert (r.p50, r.p90, r.p95, r.p99) == (5, 9, 10, 10)


def test_bus_factor(spark):
    counts = [("m", "a", 50), ("m", "b", 30), ("m", "c", 20), ("one", "a", 5), ("even", "a", 1), ("even", "b", 1)]
    got = {r.g: r for r in windows.bus_factor(spark.createDataFrame(counts, "g string, who string, n long"), "g", "who", "n").collect()}
    assert (got["m"].bus_factor, got["m"].evenness) == (2, 0.8) and (got["one"].bus_factor, got["one"].evenness) == (1, 0.0) and got["even"].evenness == 1.0


def test_conditions(spark):
    df = spark.createDataFrame([(1, "a", ["x"]), (2, "b", ["y"]), (3, None, [])], "id int, name string, tags array<string>")
    w = P.where
    assert [r.id for r in df.filter(P.any_of(w("name", "null"), w("tags", "has", "x")).column()).collect()] == [1, 3]
    assert df.filter(P.all_of().column()).count() == 3
    with pytest.raises(ValueError):
        w("id", "near", 1).column()
    q = Query(lambda n: df).from_("t").where("id", ">", 1).order("id", desc=True)
    assert [r.id for r in q.page(1, 5).frame().collect()] == [2]


def test_hash_diff(spark):
    s = lambda *r: spark.createDataFrame(r, "id string, h string")
    got = {r.id: r.change for r in store.hash_diff(s(("a", "1"), ("b", "1"), ("c", "1")), s(("b", "1"), ("c", "2"), ("d", "1")), "id", "h").collect()}
    assert got == {"a": "deleted", "b": "unchanged", "c": "modified", "d": "added"}


def test_linker(spark):
    from graphloom.operators.joins import resolve_calls

    sites = spark.createDataFrame([("caller1", "f1", "myFunc", 5), ("caller1", "f1", "utilFunc", 10), ("caller1", "f1", "parseInt", 11)], "caller_id string, file_id string, callee string, line_number int")
    functions = spark.createDataFrame([("fn1", "myFunc", "f1", False), ("utilFn1", "utilFunc", "f2", True), ("p", "parseInt", "f1", False)], "id string, name string, file_id string, is_exported boolean")
    imports = spark.createDataFrame([("f1", "f2", ["utilFunc"])], "from_id string, to_id string, imported_symbols array<string>")
    got = {(r.from_id, r.to_id, r.line_number) for r in resolve_calls(sites, functions, imports, ["parseInt"]).collect()}
    assert got == {("caller1", "fn1", 5), ("caller1", "utilFn1", 10)}


def test_fusion(spark):
    rows = lambda *r: spark.createDataFrame(r, "file string, rank int")
    f = S.fuse(rows(("auth", 0), ("parser", 1)), rows(("auth", 0), ("other", 1)), "keyword")
    got = [(r.file, r.score) for r in S.normalised(f, 5).collect()]
    assert got[0] == ("auth", 1.0) and len(got) == 3
    assert {r.file: r.source for r in f.collect()} == {"auth": "semantic", "parser": "semantic", "other": "lexical"}


def test_anchored_sessions(spark):
    ev = [("s", i, float(a), k) for i, (a, k) in enumerate([(0, "x"), (1000, "x"), (1900, "x"), (3000, "x"), (3100, "system:startup"), (3200, "x")])]
    got = {r.seq: r.part for r in L.anchored_sessions(spark.createDataFrame(ev, "session_id string, seq long, at double, event_type string"), 1800.0).collect()}
    # newest 3200; a startup marker begins a part; its own anchor is 3100; 1300 is the farthest it reaches
    assert got == {5: 0, 4: 1, 3: 1, 2: 1, 1: 2, 0: 2}


def test_token_batches(spark):
    rows = spark.createDataFrame([("a", i, t) for i, t in enumerate([60, 50, 40, 200, 1])], "g string, i int, t int")
    assert [r.batch for r in L.token_batches(rows, "g", ["i"], "t", 100).orderBy("i").collect()] == [0, 1, 1, 2, 3]
