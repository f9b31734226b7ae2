"""Approximate nearest neighbours by inner product with a permutation index.

Every vector is represented by the order in which a fixed set of pivots is near to it,
cut after ``prefix`` pivots.  The rows are spread over shards; in a shard each pivot has an
inverted file that gives the pivot's place in the order of each row, one byte a row (the
prefix length where the pivot isn't among the first).  A query reads the files of its own
first ``read`` pivots, adds up how far its places and the rows' are apart (Spearman's
footrule) and reranks the part ``reranked`` of the shard with the least sums by the true
measure.  A shard reranks ten times the wanted number at least.

Long orders and many reads are what vectors without clusters need: with short ones, or
with rows posted under their first pivots only, recall falls under a half on such data.
There an exact product of all pairs costs less than the index.

Pivots are a bounded sample of the vectors, by a hash of them; every vector is indexed.
Copies of a vector are one row of the index that lists its smallest ids, and equal queries
are one query.  Shards have a fixed number of rows, a task holds a few of them, and the
queries pass by it a few at a time, so its memory doesn't grow with rows or queries.

Vectors that are null, zero, empty or hold null or non-finite components take no part;
neither do vectors of another length than the commonest of the pivots' sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import durable, release, single_thread
from graphloom.llm.vectors import answers, clean, from_raw, merge_copies, query_keys, top

PIVOTS = 384
PREFIX = 192
READ = 96
RERANKED = 0.08
#: Rows of a shard that are reranked at least, for each one that is wanted.
LEAST = 10
SHARD_ROWS = 16_384
#: Shards that one task searches at most, if there are this many tasks.
SHARDS_A_TASK = 8
LEAST_TASKS = 12
#: Queries that a task answers at a time.
QUERIES = 512


#: Rows whose nearness to all pivots is held at once.
TOGETHER = 4096


def places(vectors: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """(pivots, rows): the place of each pivot among those nearest to the row, at most ``prefix``."""
    out = np.empty((len(pivots), len(vectors)), np.uint8)
    for s in range(0, len(vectors), TOGETHER):
        order = np.argsort(-(vectors[s : s + TOGETHER] @ pivots.T), axis=1, kind="stable")[:, :prefix]
        some = np.full((len(order), len(pivots)), prefix, np.uint8)
        np.put_along_axis(some, order, np.arange(order.shape[1], dtype=np.uint8)[None, :], axis=1)
        out[:, s : s + TOGETHER] = some.T
    return out


def spread_pivots(sample: np.ndarray, pivots: int, alike: float = 0.7) -> np.ndarray:
    """The first vectors of the sample of which no two point the same way; then the rest, if they are too few.

    A dense cluster would else give many pivots that all order the rows in one way.
    """
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    chosen: list[int] = []
    for i in range(len(unit)):
        if len(chosen) < pivots and (not chosen or (unit[chosen] @ unit[i]).max() < alike):
            chosen.append(i)
    taken = set(chosen)
    return sample[(chosen + [i for i in range(len(unit)) if i not in taken])[:pivots]]


def search_shard(files: np.ndarray, own: np.ndarray, levels: np.ndarray, wanted: int) -> Iterator[np.ndarray]:
    """For each query the rows whose orders are nearest to its own, ``wanted`` and those that tie with the last.

    With a place a of the query and b of the row, |a - b| is 2 max(a, b) - a - b.  The a are
    the same for all rows, and a pivot that only the row has counts with its b, so the sums
    of max(a, b) give the order.  ``levels`` has a row of each a that is read, as numpy is
    much faster at the larger of two arrays than of an array and a number.
    """
    n = files.shape[1]
    larger, total = np.empty(n, np.uint8), np.empty(n, np.uint16)
    for mine in own.T:
        total[:] = 0
        for p in np.flatnonzero(mine < len(levels)).tolist():
            np.maximum(files[p], levels[mine[p], :n], out=larger)
            np.add(total, larger, out=total)
        yield np.flatnonzero(total <= np.partition(total, wanted - 1)[wanted - 1]) if wanted < n else np.arange(n)


class Shards:
    """The rows of some shards, and the search of all of them for a few queries at a time."""

    def __init__(self, pivots: np.ndarray, prefix: int, read: int, reranked: float, least: int):
        self.pivots, self.prefix, self.read, self.reranked, self.least = pivots, prefix, read, reranked, least
        self.rows: dict[int, list[np.ndarray]] = {}
        self.ids: dict[int, list[list[int]]] = {}
        self.files: dict[int, np.ndarray] = {}
        self.levels = np.zeros((read, 0), np.uint8)

    def add(self, shard: int, rows: np.ndarray, ids: list[list[int]]) -> None:
        self.rows.setdefault(shard, []).append(rows)
        self.ids.setdefault(shard, []).extend(ids)

    def build(self) -> None:
        for shard, parts in self.rows.items():
            if shard not in self.files:
                parts[:] = [np.concatenate(parts)]
                self.files[shard] = places(parts[0], self.pivots, self.prefix)
        longest = max(f.shape[1] for f in self.files.values())
        if self.levels.shape[1] < longest:
            self.levels = np.repeat(np.arange(self.read, dtype=np.uint8)[:, None], longest, axis=1)

    def search(self, queries: np.ndarray, k: int) -> Iterator[list[tuple[float, int]]]:
        """For each query the k best (score, vec_id) of what the shards rerank."""
        self.build()
        own = places(queries, self.pivots, self.prefix)
        best: list[list[tuple[float, int]]] = [[] for _ in queries]
        for shard, (rows,) in self.rows.items():
            lists, wanted = self.ids[shard], min(len(rows), max(self.least, int(np.ceil(self.reranked * len(rows)))))
            for q, some in enumerate(search_shard(self.files[shard], own, self.levels, wanted)):
                scores = rows[some] @ queries[q]
                if len(scores) > k:
                    keep = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
                    some, scores = some[keep], scores[keep]
                best[q] += top(scores, [lists[r] for r in some.tolist()], k)
        for found in best:
            yield sorted(found, key=lambda x: (-x[0], x[1]))[:k]


def nearest(
    table: DataFrame,
    is_query: str,
    k: int = 20,
    pivots: int = PIVOTS,
    prefix: int = PREFIX,
    read: int = READ,
    reranked: float = RERANKED,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row for which the SQL condition holds."""
    vectors = clean(table).filter(F.exists("vector", lambda v: v != 0))
    index = durable(merge_copies(vectors, k + 1).select(F.md5("raw").alias("key"), "raw", "ids"))
    n = index.count()
    sample = index.orderBy("key").limit(8 * pivots).select("raw").collect()  # bounded by the parameter
    lengths = [len(r.raw) for r in sample]
    size = max(set(lengths), key=lambda x: (lengths.count(x), x)) if lengths else 0
    marks = np.array([np.frombuffer(r.raw, np.float64) for r in sample if len(r.raw) == size])
    marks = spread_pivots(marks, pivots) if len(marks) else marks
    index = index.filter(F.octet_length("raw") == size)
    ids = query_keys(vectors.filter(is_query))
    shards = max(1, -(-n // shard_rows))
    groups = -(-shards // min(SHARDS_A_TASK, max(1, shards // LEAST_TASKS)))
    shard = F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")
    rows = index.select((shard % groups).alias("grp"), F.lit(False).alias("asks"), shard.alias("shard"), "key", "raw", "ids")
    asked = index.join(ids.select("key").distinct(), "key", "left_semi").select(
        F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("grp"), F.lit(True).alias("asks"), F.lit(0).alias("shard"), "key", "raw",
        F.array().cast("array<long>").alias("ids"),
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of a group come before its queries, which pass by a few at a time."""
        single_thread()
        group, held = None, Shards(marks, prefix, read, reranked, LEAST * (k + 1))
        for b in batches:
            at = np.stack([b.column(c).cast(pa.int32()).to_numpy() for c in ("grp", "asks", "shard")], axis=1)
            ends = [*(np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1).tolist(), len(at)] if len(at) else []
            for start, end in zip([0, *ends], ends, strict=False):
                g, asks, shard = at[start].tolist()
                if g != group:
                    group, held = g, Shards(marks, prefix, read, reranked, LEAST * (k + 1))
                if not asks:
                    some = b.slice(start, end - start)
                    held.add(shard, from_raw(some.column("raw")), some.column("ids").to_pylist())
                    continue
                for s in range(start, end if held.rows else start, QUERIES):
                    some = b.slice(s, min(QUERIES, end - s))
                    out = [(name, i, v) for name, found in zip(some.column("key").to_pylist(), held.search(from_raw(some.column("raw")), k + 1), strict=True) for v, i in found]
                    columns = zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.float64()), strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], names=["key", "vec_id", "score"])
        del held
        release()

    # more partitions than groups, so that few tasks have two
    dealt = rows.unionAll(asked).repartition(4 * groups, "grp").sortWithinPartitions("grp", "asks", "shard")
    return answers(dealt.mapInArrow(search, "key string, vec_id long, score double"), ids, k, "double")


def op5_ann(spark, sf_dir: str) -> DataFrame:
    from graphloom.llm.common import table

    return nearest(table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0")
