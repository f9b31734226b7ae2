"""Sharding: indivisible groups of equal texts, packed into shards best fit first, largest first.

``best_fit`` is the packing: groups by falling size enter the open bin with the tightest
room that still holds them, found in a balanced tree of rooms; if none does, a bin opens.
``even_shards`` finds the least capacity at which that fills a fixed number of bins.

The driver packs a bounded number of items whatever the corpus: groups over a small
share of a shard are items of their own, and all smaller ones are merged by hash into
pellets of about that share, which keeps every group whole.  Both numbers are at most a
few thousand for each shard.

Sizes are UTF-8 bytes plus a fixed cost a row.  A null text has no bytes and is grouped
with empty ones, its checksum is zero.  Repeated rows are copies and stay together; rows
without doc_id are placed like others.  Only columns doc_id and text are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import durable

SHARDS = 24
ROW_BYTES = 8
#: Pellets for each shard, and the part of a shard from which a group is an item of its own.
GRAIN = 1024
#: Rows of a shard that one task numbers.
SLOT_ROWS = 100_000


class Rooms:
    """A treap of (room, bin): insert, and take the least room of at least a size."""

    def __init__(self):
        self.root = None
        self.seed = 1

    def _split(self, node, key):
        """Nodes below the key, and the others."""
        if node is None:
            return None, None
        if node[0] < key:
            node[3], high = self._split(node[3], key)
            return node, high
        low, node[2] = self._split(node[2], key)
        return low, node

    def _merge(self, low, high):
        if low is None or high is None:
            return low or high
        if low[1] > high[1]:
            low[3] = self._merge(low[3], high)
            return low
        high[2] = self._merge(low, high[2])
        return high

    def insert(self, room: int, bin_: int) -> None:
        self.seed = (self.seed * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        low, high = self._split(self.root, (room, bin_))
        self.root = self._merge(self._merge(low, [(room, bin_), self.seed >> 20, None, None]), high)

    def take(self, size: int) -> tuple[int, int] | None:
        low, high = self._split(self.root, (size, -1))
        if high is None:
            self.root = low
            return None
        node, above = high, None
        while node[2] is not None:
            above, node = node, node[2]
        if above is None:
            high = node[3]
        else:
            above[2] = node[3]
        self.root = self._merge(low, high)
        return node[0]


def best_fit(sizes: list[int], capacity: int, most: int | None = None) -> list[int] | None:
    """The bin of each size; sizes must fall.  None if more than ``most`` bins would open.

    A size over the capacity gets a bin for itself.
    """
    rooms, bins, out = Rooms(), 0, []
    for size in sizes:
        found = rooms.take(size)
        if found is None:
            if most is not None and bins >= most:
                return None
            room, bin_ = max(capacity, size), bins
            bins += 1
        else:
            room, bin_ = found
        out.append(bin_)
        if room > size:
            rooms.insert(room - size, bin_)
    return out


def even_shards(sizes: list[int], shards: int) -> list[int]:
    """The shard of each size (falling), with the least capacity at which best fit needs no more shards.

    What is as large as the mean of what is left gets a shard of its own first: no
    capacity could even that out.
    """
    alone, left = 0, sum(sizes)
    while alone < len(sizes) and alone < shards - 1 and sizes[alone] * (shards - alone) >= left and sizes[alone]:
        left -= sizes[alone]
        alone += 1
    rest, bins = sizes[alone:], shards - alone
    if not rest:
        return list(range(alone))
    low, high = -(-sum(rest) // bins), max(1, sum(rest))
    best = None
    # Best fit isn't monotone in capacity; the search keeps the least that worked.
    step = max(1, low // 4096)
    at = low
    while best is None:
        best = best_fit(rest, at, bins)
        if best is None:
            at, step = at + step, step * 2
    high = at
    while high - low > max(1, low // 100_000):
        middle = (low + high) // 2
        if (found := best_fit(rest, middle, bins)) is not None:
            best, high = found, middle
        else:
            low = middle
    return [*range(alone), *(alone + b for b in best)]


def shard(docs: DataFrame, shards: int = SHARDS, grain: int = GRAIN) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (from 0 in its shard) and grown_shard (null under this law)."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = durable(
        docs.select(
            "doc_id",
            (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.md5(text.cast("binary")).alias("copy"),
        )
    )
    groups = rows.groupBy("copy").agg(F.sum("size").alias("bytes"))
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    share = max(1, total // (shards * grain))
    pellets = shards * grain
    # Either a group's own name or that of its pellet.  At most shards * grain of each.
    pellet = F.concat(F.lit("p"), F.pmod(F.xxhash64("copy"), F.lit(pellets)).cast("string"))
    items = groups.groupBy(F.when(F.col("bytes") >= share, F.col("copy")).otherwise(pellet).alias("item")).agg(
        F.sum("bytes").alias("bytes")
    )
    packed = sorted(((r.bytes, r.item) for r in items.collect()), reverse=True)
    places = even_shards([b for b, _ in packed], shards)
    plan = spark.createDataFrame(
        [(name, place) for (_, name), place in zip(packed, places, strict=True)], "item string, shard int"
    )
    # Rows look their group up as an item first, else go where its pellet goes.
    own = plan.filter("item NOT LIKE 'p%'").select(F.col("item").alias("copy"), F.col("shard").alias("own"))
    merged = plan.filter("item LIKE 'p%'").select(F.col("item").alias("pellet"), F.col("shard").alias("merged"))
    placed = (
        rows.withColumn("pellet", pellet)
        .join(F.broadcast(own), "copy", "left")
        .join(F.broadcast(merged), "pellet", "left")
        .select("doc_id", "size", "text_crc32", "copy", F.coalesce("own", "merged").alias("shard"))
    )
    return number(placed).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def number(placed: DataFrame, rows_each: int = SLOT_ROWS) -> DataFrame:
    """Adds slot, from 0 without gaps in each shard, in the order of a hash of doc_id.

    A shard's rows are cut by that hash into pieces small enough for a task; a piece
    starts where the ones before it end.
    """
    pieces = max(1, -(-placed.count() // rows_each))
    order = F.xxhash64("doc_id", "copy")
    cut = placed.withColumn("order", order).withColumn("piece", F.pmod(F.col("order"), F.lit(pieces)))
    before = Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        cut.groupBy("shard", "piece")
        .agg(F.count("*").alias("n"))
        .select("shard", "piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    )
    inside = Window.partitionBy("shard", "piece").orderBy("order", "doc_id", "copy", "size")
    return cut.withColumn("at", F.row_number().over(inside) - 1).join(starts, ["shard", "piece"]).select(
        *placed.columns, (F.col("start") + F.col("at")).cast("long").alias("slot")
    )


def op7_sharding(spark, sf_dir: str) -> DataFrame:
    from graphloom.llm.common import table

    return shard(table(spark, sf_dir, "documents"))
