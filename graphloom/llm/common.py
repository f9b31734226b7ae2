"""What several operators share: reading tables, cutting a corpus into blocks, checkpoints."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.storage import durable, written  # noqa: F401  for the operators

#: Characters that end a word in the contracts: space and the controls 9 to 13.
#: ``bytes.split()`` without arguments splits at exactly these.
WORD = r"[^\x20\x09-\x0D]+"

#: Text bytes that one block of documents should hold.
BLOCK_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: What a row costs a block besides its text.
ROW_BYTES = 512


def _weight() -> F.Column:
    """Bytes of rows with their texts."""
    return F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + ROW_BYTES)


def block_count(total_bytes: int, block_bytes: int = BLOCK_BYTES) -> int:
    return max(1, -(-total_bytes // block_bytes))


def hash_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, text and a block number from a hash of doc_id and text.

    Rows that repeat both land together; the number of blocks follows the bytes, so
    that a block stays the same size on any corpus.
    """
    n = block_count(docs.agg(_weight()).first()[0] or 0, block_bytes)  # one narrow scan, one number to the driver
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(n)).cast("int").alias("block")
    )


#: Pieces of the doc_ids' range whose sizes the driver learns.
PIECES = 4096


def range_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES, whole: bool = False) -> DataFrame:
    """doc_id, text, place and a block number that never falls along (doc_id, nulls last; place).

    place is a hash of the text, so that rows which share a doc_id, or have none, can be cut
    too.  ``whole`` adds the struct rest of all columns but text.

    The ids' range is cut into at most PIECES pieces of about as many rows, and at an id that
    is a piece's worth of rows by itself.  The driver learns each piece's bytes.  A piece is
    cut further into blocks of equal parts of its ids, one of a single id by place.
    """
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("rest")
    columns = ["doc_id", "text", "place", *["rest"] * whole]
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("place"), *[rest] * whole)
    size = docs.agg(_weight()).first()[0] or 0
    pieces = min(PIECES, 4 * block_count(size, block_bytes))
    edges: list[float] = []
    if pieces > 4:
        cuts = [k / pieces for k in range(1, pieces)]
        found = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), cuts, 4 * PIECES)).first()[0] or []
        often = {a for a, b in zip(found, found[1:], strict=False) if a == b}
        edges = sorted({float(x) for x in [*found, *often, *(x + 1 for x in often)]})
    # A binary search in the JVM.  Doubles keep the order of longs, which is all that matters.
    at = Bucketizer(splits=[float("-inf"), *(edges or [0.0]), float("inf")], inputCol="_at", outputCol="_piece")
    pieced = at.transform(narrow.withColumn("_at", F.col("doc_id").cast("double"))).withColumn("_piece", F.coalesce("_piece", F.lit(1e6)).cast("int"))
    sizes = pieced.groupBy("_piece").agg(_weight().alias("bytes"), F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).orderBy("_piece").collect()
    # A piece of more than a block is cut into parts; smaller ones share blocks as they follow each other.
    plan, block, room = [], -1, 0
    for r in sizes:
        parts = block_count(r.bytes, block_bytes)
        if r.bytes > room:
            block, room = block + 1, block_bytes
        plan.append((r._piece, r.least, r.most, parts, block))
        block, room = block + parts - 1, 0 if parts > 1 else room - r.bytes
    schema = "_piece int, _least long, _most long, _parts int, _first int"
    lookup = F.broadcast(docs.sparkSession.createDataFrame(plan, schema))  # a row a piece
    share = F.when(
        F.col("_least") < F.col("_most"),
        (F.col("doc_id").cast("double") - F.col("_least")) / (F.col("_most").cast("double") - F.col("_least") + 1),
    ).otherwise(F.col("place") / F.lit(2.0**64) + 0.5)
    part = F.least(F.floor(share * F.col("_parts")), F.col("_parts") - 1)
    return pieced.join(lookup, "_piece").select(*columns, (F.col("_first") + F.greatest(part, F.lit(0))).cast("int").alias("block"))


#: Rows of a few numbers that are sent to every task; more are shuffled.
FEW = 400_000


def if_few(rows: DataFrame, most: int = FEW) -> DataFrame:
    """Marked for a broadcast if there are no more than ``most``; counts no further than that."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def single_thread() -> None:
    """One task, one core: native libraries must not start pools of their own."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ.setdefault("OMP_NUM_THREADS", "1")


def release() -> None:
    """Memory that is free goes back to the system: a worker is kept, and its next task may need little."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def of_group(f: Callable) -> Callable:
    """A function of one table for ``applyInArrow`` that leaves nothing behind."""

    def each(group):
        out = f(group)
        release()
        return out

    return each


def of_groups(f: Callable) -> Callable:
    """The same of two tables."""

    def each(left, right):
        out = f(left, right)
        release()
        return out

    return each


def arrow_texts(column) -> list[bytes | None]:
    """An Arrow string column as UTF-8 bytes, without decoding."""
    import pyarrow as pa

    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser for 64-bit hashes: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))
