"""SimHash near-duplicates by meet-in-the-middle ball hashing, and their components.

A fingerprint bit is set if it is set in over half of the hashes of the text's word
shingles.  Two fingerprints link if they differ in at most three bits.  Every fingerprint
emits all its variants within half the radius, rounded so that two balls meet: 1 + 2 = 3.
Only variants with an even number of set bits are needed: a fingerprint with an odd
number emits its 64 one-bit variants, one with an even number emits itself and its 2016
two-bit variants.  Any two within three bits then have a variant in common (for one or
three differing bits one of the two is even, the other odd; for two, both emit a variant
between them or one emits the other), and whoever emits a variant lies within three bits
of each odd or equal one that emits it too.  So a variant gives a star around such a
member, never all pairs, and the components of the stars are those of all links.

Variants are shuffled by their leading bits.  All variants of a fingerprint that share
these travel as the one fingerprint and unfold where they meet, which is 37 rows for the
2017 variants at eight leading bits.

Nulls, empty texts and texts of white space have fingerprint zero and link like others.
Texts of fewer words than a shingle have one shingle, the whole sequence.  Repeated rows
each get a row.  Rows without doc_id get the component of their fingerprint.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import arrow_texts, durable, if_few, of_group, release

SEED = 42
RADIUS = 3
#: Variants that a bucket of leading bits should take, and that a task unfolds of it at once.
BUCKET_VARIANTS, UNFOLDED = 1 << 26, 1 << 21
#: Bits that second fingerprints may be apart.
FAR = 16
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(data: bytes, words_in_shingle: int = 3) -> int:
    """Of UTF-8 bytes; signed, as Spark's long."""
    import xxhash

    words = data.translate(_LOWER).split()
    if not words:
        return 0
    k = words_in_shingle
    shingles = [b" ".join(words)] if len(words) < k else map(b" ".join, zip(*(words[i:] for i in range(k)), strict=False))
    digest = xxhash.xxh64_digest
    hashes = np.frombuffer(b"".join([digest(s, SEED) for s in shingles]), np.uint8).reshape(-1, 8)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 255):  # sums of up to 255 bits fit a byte
        counts += np.unpackbits(hashes[at : at + 255], axis=1).sum(axis=0, dtype=np.uint8)
    return int(np.packbits(counts * 2 > len(hashes)).view(">i8")[0])


def fingerprints(docs: DataFrame, words_in_shingle: int = 3) -> DataFrame:
    """doc_id and fp (long) of every row."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [fingerprint(t or b"", words_in_shingle) for t in arrow_texts(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, pa.int64())], names=["doc_id", "fp"])
            release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(each, "doc_id long, fp long")


def _components(left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """The smallest member of the component of each of 0..n-1."""
    root = np.arange(n)
    while True:
        a, b = root[left], root[right]
        low, high = np.minimum(a, b), np.maximum(a, b)
        apart = low < high
        if not apart.any():
            return root
        np.minimum.at(root, high[apart], low[apart])
        while (jumped := root[root]).tobytes() != root.tobytes():
            root = jumped


def star_pairs(fps: np.ndarray, bucket: int, bits: int, width: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Places (member, hub) of unsigned fingerprints that meet in a variant with these leading bits.

    A fingerprint is the low ``width`` bits of its number; what stands above them is compared
    as it is.  All pairs lie within the radius, and equal fingerprints are pairs too.
    """
    low_bits = width - bits
    one = np.uint64(1)
    mask = np.uint64((1 << low_bits) - 1)
    away = np.bitwise_count((fps >> np.uint64(low_bits)) ^ np.uint64(bucket))
    odd = np.bitwise_count(fps) & 1 == 1
    low = fps & mask
    flips = one << np.arange(low_bits, dtype=np.uint64)

    def pick(which: np.ndarray) -> np.ndarray:
        return np.flatnonzero(which)

    home, near = pick(odd & (away == 0)), pick(odd & (away == 1))
    selves = pick(~odd & (away == 0))
    keys = np.concatenate([low[selves], (low[home][:, None] ^ flips).ravel(), low[near]])
    owner = np.concatenate([selves, np.repeat(home, low_bits), near])
    order = np.argsort(keys, kind="stable")
    keys, owner = keys[order], owner[order]
    new = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
    hubs, hub_of = keys[new], owner[new]
    left, right = [owner], [hub_of[np.cumsum(new) - 1]]

    # Most variants of even fingerprints meet nothing: a table of hashed keys says so at once.
    wide = np.uint64(64 - max(10, int(len(hubs) * 16).bit_length()))
    there = np.zeros(1 << int(np.uint64(64) - wide), bool)
    odd_factor = np.uint64(0x9E3779B97F4A7C15)
    there[(hubs * odd_factor) >> wide] = True

    def probe(which: np.ndarray, flip: np.ndarray) -> None:
        if not len(hubs) or not len(flip):
            return
        step = max(1, (1 << 21) // len(flip))
        for at in range(0, len(which), step):
            rows = which[at : at + step]
            variants = (low[rows][:, None] ^ flip).ravel()
            hits = np.flatnonzero(there[(variants * odd_factor) >> wide])
            place = np.searchsorted(hubs, variants[hits])
            met = hubs[np.minimum(place, len(hubs) - 1)] == variants[hits]
            left.append(rows[hits[met] // len(flip)])
            right.append(hub_of[place[met]])

    i, j = np.triu_indices(low_bits, 1)
    probe(selves, flips[i] | flips[j])
    probe(pick(~odd & (away == 1)), flips)
    probe(pick(~odd & (away == 2)), np.zeros(1, np.uint64))
    a, b = np.concatenate(left), np.concatenate(right)
    fine = (a != b) & (np.bitwise_count(fps[a] ^ fps[b]) <= RADIUS)
    return a[fine], b[fine]


def stars(
    fps: np.ndarray, bucket: int, bits: int, width: int = 64, checks: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (name, the smallest name of its component here) of those linked in this bucket.

    Names are the fingerprints themselves, or ``checks``: second fingerprints, and pairs
    whose checks are over FAR bits apart don't link.  A bucket of too many variants is
    solved in halves, by one more leading bit.
    """
    names = fps if checks is None else checks
    if len(fps) * width > UNFOLDED and width - bits > 16:
        found = []
        for half in (2 * bucket, 2 * bucket + 1):
            near = np.flatnonzero(np.bitwise_count((fps >> np.uint64(width - bits - 1)) ^ np.uint64(half)) <= 2)
            found.append(stars(fps[near], half, bits + 1, width, None if checks is None else checks[near]))
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
    order = np.argsort(names, kind="stable")
    fps, names = fps[order], names[order]
    a, b = star_pairs(fps, bucket, bits, width)
    if checks is not None:
        fine = np.bitwise_count(names[a] ^ names[b]) <= FAR
        a, b = a[fine], b[fine]
    root = _components(a, b, len(fps))
    linked = np.flatnonzero(root != np.arange(len(fps)))
    return names[linked], names[root[linked]]


def links(rows: DataFrame, width: int = 64, n: int | None = None) -> DataFrame:
    """Stars of linked fingerprints, a and b, from distinct ones (fp), or of their checks.

    All links within the radius run along the stars of one bucket.  Where there is a column
    check (long) its values are linked, and rows are distinct in both; ``n`` is the number of rows that share what
    stands above the fingerprint's ``width`` bits, else all.
    """
    n = rows.count() if n is None else n
    variants = (width * width / 2 + width) / 2
    bits = min(24, max(5, math.ceil(math.log2(max(1, n) * variants / BUCKET_VARIANTS))))
    masks = [0, *(1 << i for i in range(bits))]
    pairs = [1 << i | 1 << j for i in range(bits) for j in range(i)]
    home = F.shiftrightunsigned("fp", width - bits)
    checked = "check" in rows.columns

    def places(flips: list[int]) -> F.Column:
        return F.array(*[home.bitwiseXOR(F.lit(m)) for m in flips])

    odd = F.bit_count("fp") % 2 == 1
    routed = rows.select(*rows.columns, F.explode(F.when(odd, places(masks)).otherwise(places(masks + pairs))).alias("bucket"))

    def meet(group: pa.Table) -> pa.Table:
        column = lambda c: group.column(c).to_numpy().view(np.uint64)
        a, b = stars(column("fp"), group.column("bucket")[0].as_py(), bits, width, column("check") if checked else None)
        return pa.Table.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return routed.groupBy("bucket").applyInArrow(of_group(meet), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """id and root, the smallest id of its component, for all ids of the edges (a, b) but roots.

    Alternates two steps until nothing changes, which takes rounds in the order of the
    logarithm of the ids: each vertex ties its larger neighbours to the smallest one, then
    its smaller ones and itself.  Minima are pre-aggregated and joined back, so that a
    vertex with very many neighbours can be split.  The edges of each round are checkpointed.
    """
    both = lambda e: e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def step(e: DataFrame, large: bool) -> DataFrame:
        sided = both(e) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = sided.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        joined = sided.join(least, "a")
        if large:
            out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        return out.filter("a != b").distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = durable(edges.filter("a != b").distinct())
    seen = state(now)
    while True:
        now = durable(step(step(now, True), False))
        if (found := state(now)) == seen:
            return now.select(F.col("a").alias("id"), F.col("b").alias("root"))
        seen = found


def groups(of_doc: DataFrame) -> DataFrame:
    """fp, root (its component) and least, the smallest doc_id of the component; one row a fingerprint."""
    distinct = of_doc.groupBy("fp").agg(F.min("doc_id").alias("own"))
    tied = components(links(distinct.select("fp")))
    rooted = distinct.join(tied, distinct.fp == tied.id, "left").select("fp", "own", F.coalesce("root", "fp").alias("root"))
    return rooted.join(rooted.groupBy("root").agg(F.min("own").alias("least")), "root").select("fp", "root", "least")


def near_duplicates(docs: DataFrame, words_in_shingle: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id reachable by links."""
    of_doc = durable(fingerprints(docs, words_in_shingle))
    return of_doc.join(groups(of_doc), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("least").alias("component_id")
    )


def text_key() -> F.Column:
    """A hash of the text, the same for null and empty ones."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def known_texts(of_doc: DataFrame, *features: str) -> DataFrame:
    """key, own (the smallest doc_id), rows (how many have the text) and the features of every distinct text."""
    return of_doc.groupBy("key").agg(F.min("doc_id").alias("own"), F.count("*").alias("rows"), *[F.first(c).alias(c) for c in features])


def survivors(docs: DataFrame, rooted: DataFrame) -> DataFrame:
    """The rows of docs, unchanged, less all but one of each group: a row with its smallest doc_id.

    ``rooted`` has key, own, rows and root (the group) of every distinct text.  Texts that
    are alone in their group stay where they are; only keys of the others are looked up,
    and only their first rows are shuffled.  Nulls come after all doc_ids.
    """
    first = F.struct(F.col("own").isNull().alias("z"), "own", "key")
    groups = rooted.groupBy("root").agg(F.sum("rows").alias("total"), F.min(first).alias("first")).filter("total > 1")
    special = durable(
        rooted.join(groups, "root").select(F.col("key").alias("_key"), "root", F.col("first.own").alias("_own"), (F.col("first.key") == F.col("key")).alias("_first"))
    )
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("rest")
    joined = docs.select(rest, text_key().alias("key")).join(if_few(special), F.col("key") == F.col("_key"), "left")
    ones = joined.filter("_first AND rest.doc_id <=> _own").select("rest", "root").dropDuplicates(["root"])
    return joined.filter("_key IS NULL").select("rest.*").unionByName(ones.select("rest.*"))


def one_of_each(docs: DataFrame, words_in_shingle: int = 3) -> DataFrame:
    """The rows of docs, unchanged, less all but one of each component of fingerprints."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [fingerprint(t or b"", words_in_shingle) for t in arrow_texts(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("doc_id"), pa.array(found, pa.int64())], names=["key", "doc_id", "fp"])

    of_doc = docs.select(text_key().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(each, "key long, doc_id long, fp long")
    known = durable(known_texts(of_doc, "fp"))
    tied = components(links(known.select("fp").distinct()))
    return survivors(docs, known.join(tied, known.fp == tied.id, "left").select("key", "own", "rows", F.coalesce("root", "fp").alias("root")))


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    from graphloom.llm.common import table

    return near_duplicates(table(spark, sf_dir, "documents"))
