"""What the vector searches share: clean vectors, copies merged, and the last step of a top-k."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def clean(table: DataFrame) -> DataFrame:
    """vec_id and vector (array of double) without nulls, empty vectors, null or non-finite components."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return table.filter("vec_id IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), F.when(F.size(x) > 0, x).alias("vector")).filter(
        F.col("vector").isNotNull() & fine
    )


def matrix(column) -> np.ndarray:
    """An Arrow list column of equally long vectors as rows of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(column), -1)


def _raws(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes]]:
    """vec_id and the little-endian doubles of each row, -0 as 0."""
    rows = batch.column("vector")
    data, ends = memoryview((rows.flatten().to_numpy(zero_copy_only=False) + 0.0).tobytes()), np.cumsum(rows.value_lengths().to_numpy()) * 8
    at = 0
    for i, end in zip(batch.column("vec_id").to_pylist(), ends.tolist(), strict=True):
        yield i, bytes(data[at:end])
        at = end


def query_keys(vectors: DataFrame) -> DataFrame:
    """query_id and key, the MD5 of the vector's bytes, of each row."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(i, hashlib.md5(raw).hexdigest()) for i, raw in _raws(b)]
            columns = list(zip(*found, strict=True)) or [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string())], names=["query_id", "key"])

    return vectors.select("vec_id", "vector").mapInArrow(keys, "query_id long, key string")


#: Bytes of distinct vectors that a task holds before it sends them.
HELD_BYTES = 32 << 20


def merge_copies(vectors: DataFrame, most: int) -> DataFrame:
    """One row for each distinct vector: raw (its bytes) and ids, its ``most`` smallest vec_ids.

    With ties going to smaller ids, no others can be among the first most - 1 of any
    query.  Each task merges the copies that it sees before the shuffle, so the commonest
    vector sends a few rows for each task and not one for each copy.
    """

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[bytes, list[int]] = {}

        def flush() -> pa.RecordBatch:
            ids = [i for v in least.values() for i in v]
            keys = [k for k, v in least.items() for _ in v]
            least.clear()
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary())], names=["vec_id", "raw"])

        held = 0
        for b in batches:
            for i, raw in _raws(b):
                if (ids := least.get(raw)) is None:
                    ids = least[raw] = []
                    held += len(raw)
                if i not in ids:
                    ids.append(i)
                    if len(ids) > most:
                        ids.remove(max(ids))
                if held > HELD_BYTES:
                    yield flush()
                    held = 0
        yield flush()

    first = Window.partitionBy("raw").orderBy("vec_id")
    kept = (
        vectors.select("vec_id", "vector")
        .mapInArrow(merged, "vec_id long, raw binary")
        .distinct()
        .withColumn("n", F.row_number().over(first))
        .filter(F.col("n") <= most)
    )
    return kept.groupBy("raw").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def from_raw(column) -> np.ndarray:
    """Rows of doubles from the merged vectors' bytes."""
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1) if raw else np.zeros((0, 0))


def top(
    scores: np.ndarray, ids: list[list[int]], k: int
) -> list[tuple[float, int]]:
    """The k best (score, vec_id) where row i of the scores stands for ids[i]."""
    if len(scores) > k:
        # All rows that tie with the k-th stay until their ids have been compared.
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        rows = np.flatnonzero(scores >= edge)
    else:
        rows = np.arange(len(scores))
    found = sorted((-scores[r].item(), i) for r in rows.tolist() for i in ids[r])
    return [(-s, i) for s, i in found[:k]]


def answers(found: DataFrame, queries: DataFrame, k: int, score_type: str, by: str = "score") -> DataFrame:
    """query_id, rank, vec_id, score from partial results (key, vec_id, score) of distinct query vectors.

    ``by`` is a column that orders them as their exact scores do.

    ``queries`` has key and query_id.  A query's own row is no candidate, which is why
    partial results hold k + 1.
    """
    best = Window.partitionBy("key").orderBy(F.col(by).desc(), "vec_id")
    kept = found.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k + 1)
    lists = kept.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("place", "vec_id", "score"))).alias("found"))
    others = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return (
        queries.join(lists, "key")
        .select("query_id", F.posexplode(others))
        .select("query_id", (F.col("pos") + 1).alias("rank"), "col.vec_id", F.col("col.score").cast(score_type).alias("score"))
    )
