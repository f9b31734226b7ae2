"""Near copies at a share of common shingles: the balls of ``simhash`` over several fingerprints.

A text is the set of its five-word shingles, A-Z lowered, as 64-bit hashes.  Two texts link
if they share at least 4/5 of the shingles that either has; components of links are groups.

At that share SimHash's own bits differ in about ten places of 64, and no ball of three bits
gets there.  So the bits here are parities of the shingles' minima under as many hashes,
which differ in one place of ten, and a text has ten fingerprints of 48 bits.  Each goes
through the same balls that meet half-way; colliding pairs are held against a further
fingerprint of 64 bits (16 may differ, six do on average), so that chance collisions among
very many texts don't chain.  Two texts at exactly 0.8 meet directly in one of the ten with
a probability of 0.967, at 0.85 of 0.999, and more often over a third one.

What meets, directly or over others, is a class, and within classes nothing is left to
chance: all pairs are compared on their whole sets.  A small class is solved where it lands,
together with others; a large one is cut into parts by a hash, and each two of its parts
meet in a task of bounded bytes.  Only links come out, as stars.  Equal texts are one vertex
throughout, and the rows of texts that meet nothing are never shuffled.

Nulls, empty texts and texts of white space are equal.  Texts of fewer words than a shingle
have one shingle, the whole sequence.  Repeated rows are copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import arrow_texts, durable, if_few, mix64, of_group, release
from graphloom.llm.simhash import _LOWER, SEED, _components, components, known_texts, links, survivors, text_key

WORDS = 5
TABLES, WIDTH, CHECK = 10, 48, 64
#: The least share of common shingles that links, as a fraction in whole numbers.
SHARE = (4, 5)
#: Bytes of hashes and texts that a part of a class should hold.
PART_BYTES, PART_TEXTS = 8 << 20, 1024
#: Shingles whose presence is multiplied at once.
COLUMNS = 2048
_BITS = TABLES * WIDTH + CHECK
_FACTORS = np.random.default_rng(5).integers(1 << 30, 1 << 32, _BITS).astype(np.uint32) | np.uint32(1)
_SALTS = mix64(np.arange(1, _BITS + 1, dtype=np.uint64))


def shingles(data: bytes) -> np.ndarray:
    """Distinct hashes, sorted, of UTF-8 bytes."""
    import xxhash

    words = data.translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    found = [b" ".join(words)] if len(words) < WORDS else map(b" ".join, zip(*(words[i:] for i in range(WORDS)), strict=False))
    digest = xxhash.xxh64_digest
    return np.unique(np.frombuffer(b"".join([digest(s, SEED) for s in found]), np.uint64))


def fingerprints(hashes: np.ndarray) -> tuple[np.ndarray, int]:
    """One number a table, which stands above the fingerprint's bits, and the check."""
    least = np.full(_BITS, 0xFFFFFFFF, np.uint32)
    high = (hashes >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(high), 256):
        np.minimum(least, (high[at : at + 256, None] * _FACTORS).min(axis=0), out=least)
    bits = mix64(least.astype(np.uint64) + _SALTS) & np.uint64(1)
    tables = (bits[:-CHECK].reshape(TABLES, WIDTH) << np.arange(WIDTH, dtype=np.uint64)).sum(axis=1)
    check = (bits[-CHECK:] << np.arange(CHECK, dtype=np.uint64)).sum()
    tables |= np.arange(TABLES, dtype=np.uint64) << np.uint64(WIDTH)
    return tables.view(np.int64), int(check.astype(np.uint64).view(np.int64))


def alike(sets: list[np.ndarray], other: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of all sets that link: i < j among the sets, or i in them and j in the others."""
    every = sets + (other or [])
    sizes = np.array([len(s) for s in every])
    owner = np.repeat(np.arange(len(every), dtype=np.int32), sizes)
    _, term, counts = np.unique(np.concatenate([*every, np.zeros(0, np.uint64)]), return_inverse=True, return_counts=True)
    shared = counts[term] > 1
    owner, term = owner[shared], (np.cumsum(counts > 1) - 1)[term[shared]]
    order = np.argsort(term, kind="stable")
    owner, term = owner[order], term[order]
    n = len(sets)
    both = np.zeros((n, len(every) - n if other is not None else n), np.float32)
    for at in range(0, int(term[-1]) + 1 if len(term) else 0, COLUMNS):
        low, high = np.searchsorted(term, [at, at + COLUMNS])
        has = np.zeros((len(every), COLUMNS), np.float32)
        has[owner[low:high], term[low:high] - at] = 1
        both += has[:n] @ (has[n:] if other is not None else has).T
    right = sizes[n:] if other is not None else sizes
    either = sizes[:n, None] + right - both
    i, j = np.nonzero(SHARE[1] * both >= SHARE[0] * either)
    return (i, j) if other is not None else (i[i < j], j[i < j])


def signatures(docs: DataFrame) -> DataFrame:
    """key, own, rows, n (shingles), fps and check of every distinct text."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t or b"") for t in arrow_texts(b.column("text"))]
            found = [fingerprints(s) for s in sets]
            flat = np.concatenate([f for f, _ in found]) if found else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, TABLES), pa.int32()), pa.array(flat, pa.int64()))
            numbers = [pa.array([len(s) for s in sets], pa.int64()), lists, pa.array([c for _, c in found], pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("doc_id"), *numbers], names=["key", "doc_id", "n", "fps", "check"])
            release()

    of_doc = docs.select(text_key().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        each, "key long, doc_id long, n long, fps array<long>, check long"
    )
    return known_texts(of_doc, "n", "fps", "check")


def classes(known: DataFrame) -> DataFrame:
    """key, class, own and n of the texts that meet others, not yet held against each other."""
    # Vertices are the checks; texts that share one have nearly equal sets and are a class at any rate.
    shapes = durable(known.groupBy("check").agg(F.first("fps").alias("fps"), F.count("*").alias("texts")))
    tied = components(links(shapes.select(F.explode("fps").alias("fp"), "check"), WIDTH, shapes.count()))
    member = tied.select(F.col("id").alias("check"), F.col("root").alias("class")).unionAll(tied.select("root", "root").distinct())
    alone = shapes.filter("texts > 1").join(member, "check", "left_anti").select("check", F.col("check").alias("class"))
    return known.join(member.unionAll(alone), "check").select("key", "class", "own", "n")


def verified(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Links (a, b) between keys whose components are those of all pairs in a class that are alike."""
    members = durable(classes(known))
    weight = F.sum(F.col("n") * 8 + 64)
    sizes = members.groupBy("class").agg(
        F.ceil(F.greatest(weight / PART_BYTES, F.count("*") / PART_TEXTS)).cast("long").alias("parts")
    )
    bins = max(1, (members.agg(weight).first()[0] or 0) // PART_BYTES)
    part = F.pmod(F.xxhash64(F.lit(3), "key"), F.col("parts"))
    placed = durable(members.join(sizes, "class").select(F.col("key").alias("_key"), F.col("own").alias("_own"), "class", "parts", part.alias("part")))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # rows that repeat in a task; the few of other tasks meet in a cell
        for b in batches:
            fresh = [k not in seen and not seen.add(k) for k in b.column("key").to_pylist()]
            b = b.filter(pa.array(fresh, pa.bool_()))
            found = [shingles(t or b"").tobytes() for t in arrow_texts(b.column("text"))]
            columns = [b.column(c) for c in ("key", "class", "parts", "part")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.binary())], names=["key", "class", "parts", "part", "hashes"])
            release()

    sets = (
        docs.select(text_key().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text")
        .join(if_few(placed), F.expr("key = _key AND doc_id <=> _own"))
        .select("key", "class", "parts", "part", "text")
        .mapInArrow(whole, "key long, class long, parts long, part long, hashes binary")
    )
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other")
    cells = sets.select("key", "class", "parts", "part", "hashes", other).select(
        "key",
        "class",
        "part",
        F.least("part", "other").alias("low"),
        F.greatest("part", "other").alias("high"),
        "hashes",
        F.when(F.col("parts") == 1, F.pmod(F.xxhash64("class"), F.lit(bins))).otherwise(F.xxhash64("class", F.least("part", "other"), F.greatest("part", "other"))).alias("cell"),
    )

    def solve(group: pa.Table) -> pa.Table:
        by: dict[tuple, tuple[dict, dict]] = {}
        columns = (group.column(c).to_pylist() for c in ("key", "class", "part", "low", "high", "hashes"))
        for key, name, part, low, high, hashes in zip(*columns, strict=True):
            by.setdefault((name, low, high), ({}, {}))[part != low][key] = np.frombuffer(hashes, np.uint64)
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for low, high in by.values():
            keys = np.array([*low, *high], np.int64)
            i, j = alike(list(low.values()), list(high.values()) if high else None)
            root = _components(i, j + len(low) if high else j, len(keys))
            linked = np.flatnonzero(root != np.arange(len(keys)))
            left.append(keys[linked])
            right.append(keys[root[linked]])
        return pa.Table.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], names=["a", "b"])

    return cells.groupBy("cell").applyInArrow(of_group(solve), "a long, b long")


def groups(docs: DataFrame) -> DataFrame:
    """key, own, rows and root, the group, of every distinct text."""
    known = durable(signatures(docs))
    tied = components(verified(docs, known))
    return known.join(tied, known.key == tied.id, "left").select("key", "own", "rows", F.coalesce("root", "key").alias("root"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs, unchanged, less all but one of each group of near copies: one with the smallest doc_id."""
    return survivors(docs, groups(docs))
