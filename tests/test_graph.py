"""Traversals on small graphs with known answers."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.operators import graph as G


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "from_id long, to_id long")


def ids(spark, values):
    return spark.createDataFrame([(v,) for v in values], "id long")


def brute_reach(pairs, start):
    found, todo = set(), list(start)
    while todo:
        at = todo.pop()
        for a, b in pairs:
            if a == at and b not in found:
                found.add(b)
                todo.append(b)
    return found


CHAIN = [(i, i + 1) for i in range(12)]
DIAMOND = [(0, 1), (0, 2), (1, 3), (2, 3)]
CYCLE = [(0, 1), (1, 0), (1, 2), (2, 2), (2, 9)]


@pytest.mark.parametrize("pairs", [CHAIN, DIAMOND, CYCLE, [(5, 6), (5, 6)]])
def test_reach(spark, pairs):
    got = G.reach(edges(spark, pairs), ids(spark, [0])).collect()
    assert {r.id for r in got} == brute_reach(pairs, [0]) and len(got) == len({r.id for r in got})


def test_depth_and_via(spark):
    got = {r.id: (r.depth, r.via) for r in G.reach(edges(spark, DIAMOND), ids(spark, [0])).collect()}
    assert got == {1: (1, 0), 2: (1, 0), 3: (2, 1)}
    assert {r.id for r in G.reach(edges(spark, CHAIN), ids(spark, [0]), 10).collect()} == set(range(1, 11))
    assert G.reach(edges(spark, CHAIN), ids(spark, [])).collect() == []


def test_blast_radius_lies_in_the_closure(spark):
    both = {r.id for r in G.blast_radius(edges(spark, CYCLE), ids(spark, [1]), 3, "both").collect()}
    assert both == {0, 2, 9}
    callers = {r.id for r in G.blast_radius(edges(spark, CHAIN), ids(spark, [5]), 3).collect()}
    assert callers == {2, 3, 4}


def test_chain_keeps_all_depths(spark):
    got = sorted((r.id, r.depth) for r in G.chain(edges(spark, [(0, 1), (1, 2), (0, 2), (2, 0)]), ids(spark, [0]), 3).collect())
    assert got == [(0, 2), (0, 3), (1, 1), (1, 3), (2, 1), (2, 2), (2, 3)]


def brute_components(nodes, pairs):
    reach = {n: brute_reach(pairs, [n]) for n in nodes}
    return {n: min([n, *(m for m in nodes if m in reach[n] and n in reach[m])]) for n in nodes}


def test_strong_components(spark):
    pairs = [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 3), (4, 5), (6, 6), (7, 0)]
    nodes = list(range(9))
    got = {r.id: r.component for r in G.strong_components(edges(spark, pairs), ids(spark, nodes)).collect()}
    assert got == brute_components(nodes, pairs)


def test_levels(spark):
    pairs = [(0, 1), (1, 2), (2, 1), (2, 3), (0, 3), (4, 4), (9, 0)]
    got = {r.id: (r.level, r.on_cycle) for r in G.topological_levels(edges(spark, pairs), ids(spark, range(6))).collect()}
    assert got == {0: (0, False), 1: (1, True), 2: (1, True), 3: (2, False), 4: (0, True), 5: (0, False)}


def test_levels_respect_edges(spark):
    rng = random.Random(3)
    pairs = sorted({(rng.randrange(30), rng.randrange(30)) for _ in range(40)})
    parts = brute_components(list(range(30)), pairs)
    got = {r.id: r.level for r in G.topological_levels(edges(spark, pairs), ids(spark, range(30))).collect()}
    assert len(got) == 30
    assert all(got[a] < got[b] if parts[a] != parts[b] else got[a] == got[b] for a, b in pairs)


def test_taint_ends_at_sinks(spark):
    got = {(r.source, r.id) for r in G.propagate(edges(spark, [(0, 1), (1, 2), (1, 3), (3, 1)]), ids(spark, [0])).collect()}
    assert got == {(0, 2)}


def test_taint_held_or_by_rounds(spark, monkeypatch):
    """The same walks either way, with cycles, a source without edges and a limit; held, without a round for each step."""
    e = edges(spark, [(i, i + 1) for i in range(60)] + [(60, 5), (30, 100), (7, 101), (101, 7), (101, 102)])
    start = ids(spark, [0, 31, 101, 500])
    rows = lambda most: {tuple(r) for r in G.propagate(e, start, most=most).select("source", "id", "depth").collect()}
    rounds = []
    real = G.durable
    monkeypatch.setattr(G, "durable", lambda df: rounds.append(1) or real(df))
    held = rows(None), rows(9)
    assert held[0] == {(0, 100, 31), (0, 102, 9), (31, 100, 56), (31, 102, 34), (101, 102, 1), (101, 100, 25), (500, 500, 0)}
    assert held[1] == {(0, 102, 9), (101, 102, 1), (500, 500, 0)}
    assert len(rounds) == 2
    monkeypatch.setattr(G, "HELD_EDGES", 3)
    assert (rows(None), rows(9)) == held


def test_small_cycles(spark):
    assert G.small_cycles(edges(spark, [(3, 1), (1, 2), (2, 3), (2, 4), (5, 5)])) == [[1, 2, 3], [5]]
    with pytest.raises(ValueError):
        G.small_cycles(edges(spark, CHAIN), 5)


def test_dangling_edges(spark):
    assert G.valid_edges(edges(spark, [(0, 1), (1, 99)]), ids(spark, [0, 1])).collect() == [(0, 1)]


@settings(max_examples=3, deadline=None)
@given(st.sets(st.tuples(st.integers(0, 7), st.integers(0, 7)), min_size=1, max_size=12))
def check_reach(pairs):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    got = {r.id for r in G.reach(edges(spark, sorted(pairs)), ids(spark, [0])).collect()}
    assert got == brute_reach(pairs, [0])


def test_reach_property(spark):
    check_reach()
