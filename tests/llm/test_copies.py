"""Near copies against brute force over all pairs."""

import random

import corpus_pipeline
from graphloom.llm import copies
from tests.llm.helpers import documents, empty


def brute_set(text):
    w = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_kept(rows):
    sets, root = [brute_set(r.text) for r in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i), []).append((r.doc_id is None, r.doc_id))
    return sorted(str(min(g)[1]) for g in groups.values())


def test_stage_removes_near_copies(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    texts = []
    for _ in range(12):
        now = [word() for _ in range(200)]
        for changes in (0, 1, 3, 4, 5, 6, 9):  # chains of copies on both sides of the share
            now = list(now)
            for i in rng.sample(range(len(now)), changes):
                now[i] = word()
            texts.append(" ".join(now))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute_kept(docs.collect())
    assert 12 < len(want) < 60
    assert sorted(str(r.doc_id) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == want


def test_oddities(spark):
    docs = documents(spark)
    out = copies.one_of_each(docs)
    assert out.columns == docs.columns and sorted(str(r.doc_id) for r in out.collect()) == brute_kept(docs.collect())
    assert copies.one_of_each(empty(spark)).collect() == []


def test_copies_at_the_share_are_found(spark):
    """Pairs that share 80 to 86 % of their shingles, each with its own base text: nine of ten at least."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    texts, pairs = [], 0
    for _ in range(400):
        base = [word() for _ in range(rng.choice([60, 150, 400]))]
        near = list(base)
        while True:
            i = rng.randrange(len(near))
            changed = [*near[:i], word(), *near[i + 1 :]]
            a, b = brute_set(" ".join(base)), brute_set(" ".join(changed))
            if 5 * len(a & b) < 4 * len(a | b):
                break
            near = changed
        texts += [" ".join(base), " ".join(near)]
        pairs += 1
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in copies.one_of_each(docs).collect()}
    assert {2 * i for i in range(pairs)} <= kept
    assert len(texts) - len(kept) >= 0.93 * pairs


def test_large_classes_are_cut(spark, monkeypatch):
    """A class of many parts gives the groups that one of a single part gives."""
    rng = random.Random(10)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    base = [word() for _ in range(120)]
    texts = []
    for _ in range(150):
        now = list(base)
        for i in rng.sample(range(len(now)), rng.randint(0, 4)):
            now[i] = word()
        texts.append(" ".join(now))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    at_once = sorted(r.doc_id for r in copies.one_of_each(docs).collect())
    monkeypatch.setattr(copies, "PART_TEXTS", 20)
    assert sorted(r.doc_id for r in copies.one_of_each(docs).collect()) == at_once
    assert len(set(map(str, at_once)) ^ set(brute_kept(docs.collect()))) <= 3  # what ten fingerprints may miss
