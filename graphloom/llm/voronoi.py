"""Exact top-k by integer inner product: a Voronoi kNN join.

Pivots, found on a bounded sample of the rows, cut the space into Voronoi cells, for rows
and queries alike.  Summaries of a cell are its number of rows, the largest distance from
its pivot and the range of norms; for queries the same of them.  With them a score between
a cell of queries and a cell of rows is bounded on both sides, by the angle between the
pivots and by their distance (q.x is half of |q|^2 + |x|^2 - |q - x|^2):

- the lower bounds of the best cells say which score each query of a cell reaches k + 1
  times, its own row included; rows of the cells that are still in question raise it,
- a cell of rows whose upper bound is below that is left out for the cell of queries,
- and so is each row of the other cells whose own upper bound is below.

Cells of queries that lie near each other form groups of a fixed size, large ones are cut,
and a row travels to a group once if any of its cells needs it.  A group's rows are cut into
splits of a fixed size and each pair is solved by one matrix product.

Components are floor(scale * x).  Scores are whole numbers and exact: doubles hold them as
long as no product of norms exceeds 2^52, past that Python's integers are used.  Rows rank
by their exact scores; one that a long can't hold is given as the nearest long.

Copies of a vector are one row that lists its k + 1 smallest ids, and equal queries are one
query.  Vectors that are null, empty or hold null or non-finite components take no part,
and neither do those of another length than the commonest; zero vectors do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import durable, if_few, of_groups
from graphloom.llm.vectors import answers, clean, from_raw, merge_copies, query_keys, top

SCALE = 256
#: Queries of a group, rows of a split, rows for each cell, cells at most.
GROUP_QUERIES = 256
SPLIT_ROWS = 16_384
CELL_ROWS = 64
CELLS = 512
#: Queries whose scores against a split a task holds at once.
TOGETHER = 128
_LONGEST = (1 << 63) - 1


def quantised(table: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and vector, its components floor(scale * x), as doubles."""
    whole = lambda v: F.when(F.abs(v) < 2.0**52, F.floor(v).cast("double")).otherwise(v)  # noqa: E731  larger ones are whole
    return clean(table).select("vec_id", F.transform("vector", lambda v: whole(v * F.lit(float(scale)))).alias("vector"))


def products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact scores, as floats if these hold them, else as Python integers."""
    biggest = np.sqrt((queries**2).sum(1).max()) * np.sqrt((rows**2).sum(1).max())
    if biggest < 2**52:
        return queries @ rows.T
    whole = [[int(v) for v in r] for r in rows]
    out = np.empty((len(queries), len(rows)), object)
    for i, q in enumerate([[int(v) for v in r] for r in queries]):
        out[i] = [sum(a * b for a, b in zip(q, r, strict=True)) for r in whole]
    return out


def best(scores: np.ndarray, ids: list[list[int]], k: int) -> list[tuple]:
    if scores.dtype != object:
        return [(int(s), i) for s, i in top(scores, ids, k)]
    found = sorted((-s, i) for s, own in zip(scores, ids, strict=True) for i in own)[:k]
    return [(-s, i) for s, i in found]


def in_order(score: int) -> str:
    """A text that sorts as the number does."""
    digits = str(abs(score))
    if score >= 0:
        return f"1{len(digits):04d}{digits}"
    return f"0{9999 - len(digits):04d}{digits.translate(str.maketrans('0123456789', '9876543210'))}"


def pivots(sample: np.ndarray, most: int, rounds: int = 4) -> np.ndarray:
    """Centres of cells: points far from each other, moved to the middle of what is near them."""
    chosen = [0]
    apart = ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < most and apart.max() > 0:
        chosen.append(int(apart.argmax()))
        apart = np.minimum(apart, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    centres = sample[chosen].copy()
    for _ in range(rounds):
        cell = nearest(sample, centres)
        counts = np.bincount(cell, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, sample)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1) - 2 * (x @ centres.T)).argmin(axis=1)


class Cells:
    """What is known of the cells of queries (a) and of rows (c), and the bounds that follow."""

    def __init__(self, centres: np.ndarray, queries: dict, rows: dict, k: int):
        def column(of: dict, i: int) -> np.ndarray:
            return np.array([of[c][i] if c in of else 0.0 for c in range(len(centres))], float)

        self.centres, self.k = centres, k
        self.norm = np.sqrt((centres**2).sum(1))
        self.asked, self.reach, self.least, self.most = (column(queries, i) for i in range(4))
        self.count, radius, low, high = (column(rows, i) for i in range(4))
        dot = centres @ centres.T
        apart = np.sqrt(np.maximum(0, self.norm[:, None] ** 2 + self.norm**2 - 2 * dot))
        off = self.reach[:, None] * self.norm + self.norm[:, None] * radius + self.reach[:, None] * radius
        slack = self.slack(high)
        near, far = np.maximum(0, apart - self.reach[:, None] - radius), apart + self.reach[:, None] + radius
        upper = np.minimum(dot + off, (self.most[:, None] ** 2 + high**2 - near**2) / 2) + slack
        lower = np.maximum(dot - off, (self.least[:, None] ** 2 + low**2 - far**2) / 2) - slack
        self.floor = np.full(len(centres), -np.inf)
        for a in np.flatnonzero(self.asked):
            order = np.argsort(-lower[a])
            enough = np.flatnonzero(np.cumsum(self.count[order]) >= k)
            if len(enough):
                self.floor[a] = lower[a, order[enough[0]]]
        self.upper = upper
        self.needed = self.need()

    def slack(self, norm: np.ndarray) -> np.ndarray:
        """More than rounding can be off by."""
        return 1e-9 * (self.most[:, None] + self.norm[:, None]) * (norm + self.norm.max(initial=0)) + 1e-6

    def need(self) -> np.ndarray:
        """(cells of queries, cells of rows)."""
        return (self.asked > 0)[:, None] & (self.count > 0) & (self.upper >= self.floor[:, None])

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cells of queries, rows): the lower and the upper bound of the scores."""
        norm = np.sqrt((x**2).sum(1))
        dot = self.centres @ x.T
        apart = np.sqrt(np.maximum(0, self.norm[:, None] ** 2 + norm**2 - 2 * dot))
        wide = 1e-7 * (self.norm[:, None] + norm)  # a difference of squares is less sure than its root
        reach, off, slack = self.reach[:, None], self.reach[:, None] * norm, self.slack(norm)
        near, far = np.maximum(0, apart - reach - wide), apart + reach + wide
        upper = np.minimum(dot + off, (self.most[:, None] ** 2 + norm**2 - near**2) / 2) + slack
        lower = np.maximum(dot - off, (self.least[:, None] ** 2 + norm**2 - far**2) / 2) - slack
        return lower, upper

    def groups(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The first group and the number of groups of each cell of queries, near ones together."""
        first, parts = np.zeros(len(self.centres), np.int64), np.ones(len(self.centres), np.int64)
        left = set(np.flatnonzero(self.asked).tolist())
        at, group, room = (min(left) if left else 0), 0, size
        while left:
            at = min(left, key=lambda c: (((self.centres[c] - self.centres[at]) ** 2).sum(), c))
            left.discard(at)
            asked = int(self.asked[at])
            if asked > room and room < size:
                group, room = group + 1, size
            first[at], parts[at] = group, -(-asked // size)
            room -= asked
            if room <= 0:
                group, room = group + int(parts[at]), size
        return first, parts


def top_scores(
    table: DataFrame,
    is_query: str,
    k: int = 5,
    scale: int = SCALE,
    group_queries: int = GROUP_QUERIES,
    split_rows: int = SPLIT_ROWS,
    sent: Accumulator | None = None,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest of each row for which the SQL condition holds.

    ``sent`` counts the rows that are sent to groups of queries.
    """
    vectors = quantised(table, scale)
    index = durable(merge_copies(vectors, k + 1).select(F.md5("raw").alias("key"), "raw", "ids"))
    lengths = index.groupBy(F.octet_length("raw").alias("size")).count().orderBy(F.desc("count"), "size").first()
    size, n = (lengths[0], lengths[1]) if lengths is not None else (0, 0)
    index = index.filter(F.octet_length("raw") == size)
    ids = query_keys(vectors.filter(is_query))
    asked = durable(index.join(ids.select("key").distinct(), "key", "left_semi").select(F.col("key").alias("name"), F.col("raw").alias("query")))

    wanted = min(CELLS, max(1, n // CELL_ROWS))
    sample = [np.frombuffer(r.raw, np.float64) for r in index.orderBy("key").limit(8 * wanted).select("raw").collect()]  # bounded by CELLS
    centres = pivots(np.array(sample), wanted) if sample else np.zeros((1, size // 8))

    def summed(column: str, weight: str) -> dict[int, tuple]:
        """Of each cell: how many, the largest distance from the pivot, the least and the largest norm."""

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = from_raw(b.column("raw"))
                if len(x):
                    cell = nearest(x, centres)
                    apart, norm = np.sqrt(((x - centres[cell]) ** 2).sum(1)), np.sqrt((x**2).sum(1))
                    columns = [pa.array(cell, pa.int32()), b.column("n"), pa.array(apart), pa.array(norm)]
                    yield pa.RecordBatch.from_arrays(columns, names=["cell", "n", "apart", "norm"])

        source = asked if column == "query" else index
        placed = source.select(F.col(column).alias("raw"), F.expr(weight).cast("long").alias("n")).mapInArrow(place, "cell int, n long, apart double, norm double")
        found = placed.groupBy("cell").agg(F.sum("n"), F.max("apart"), F.min("norm"), F.max("norm")).collect()  # a row a cell
        return {r[0]: (r[1], r[2] * (1 + 1e-9), r[3] * (1 - 1e-9), r[4] * (1 + 1e-9)) for r in found}

    cells = Cells(centres, summed("query", "1"), summed("raw", "size(ids)"), k + 1)

    def lower(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The highest lower bounds of each cell of queries among the rows here that it may need."""
        least: dict[int, np.ndarray] = {}
        for b in batches:
            x = from_raw(b.column("raw"))
            if not len(x):
                continue
            bound, cell = cells.bounds(x)[0], nearest(x, centres)
            copies = b.column("n").to_numpy()
            for a in np.flatnonzero(cells.needed.any(axis=1)):
                mine = np.flatnonzero(cells.needed[a, cell])
                both = np.concatenate([least.get(a, np.zeros(0)), np.repeat(bound[a, mine], copies[mine])])
                least[a] = np.sort(both)[-k - 1 :]
        found = [(int(a), v) for a, x in least.items() for v in x.tolist()]
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int32()), pa.array([v for _, v in found], pa.float64())], names=["cell", "bound"])

    at = F.row_number().over(Window.partitionBy("cell").orderBy(F.desc("bound")))
    reached = index.select("raw", F.size("ids").cast("long").alias("n")).mapInArrow(lower, "cell int, bound double")
    for r in reached.withColumn("at", at).filter(F.col("at") == k + 1).collect():  # a row a cell
        cells.floor[r.cell] = max(cells.floor[r.cell], r.bound)
    cells.needed = cells.need()
    first, parts = cells.groups(group_queries)

    def pairs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of rows and the groups that need them."""
        a, row = np.nonzero(cells.needed[:, nearest(x, centres)])
        keep = cells.bounds(x)[1][a, row] >= cells.floor[a]
        a, row = a[keep], row[keep]
        times = parts[a]
        group = np.repeat(first[a], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        most = int(group.max(initial=0)) + 1
        both = np.unique(np.repeat(row, times) * most + group)
        return both // most, both % most

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, int] = {}
        for b in batches:
            x = from_raw(b.column("raw"))
            for g, m in zip(*np.unique(pairs(x)[1] if len(x) else np.zeros(0, np.int64), return_counts=True), strict=True):
                found[int(g)] = found.get(int(g), 0) + int(m)
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], names=["grp", "n"])

    sizes = index.select("raw").mapInArrow(count, "grp long, n long").groupBy("grp").agg(F.sum("n").alias("n"))
    splits = durable(sizes.select(F.col("grp").alias("g"), F.ceil(F.col("n") / split_rows).cast("long").alias("splits")))

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = from_raw(b.column("raw"))
            row, group = pairs(x) if len(x) else (np.zeros(0, np.int64),) * 2
            if sent is not None:
                sent.add(len(row))
            for s in range(0, len(row), 4096):
                some = pa.array(row[s : s + 4096])
                columns = [pa.array(group[s : s + 4096]), *(b.column(c).take(some) for c in ("key", "raw", "ids"))]
                yield pa.RecordBatch.from_arrays(columns, names=["grp", "key", "raw", "ids"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q = from_raw(b.column("query"))
            cell = nearest(q, centres) if len(q) else np.zeros(0, np.int64)
            turn = np.array([int(x[:15], 16) for x in b.column("name").to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([b.column("name"), b.column("query"), pa.array(first[cell] + turn % parts[cell])], names=["name", "query", "grp"])

    needed = index.mapInArrow(replicate, "grp long, key string, raw binary, ids array<long>").join(if_few(splits), F.col("grp") == F.col("g"))
    needed = needed.select("grp", F.pmod(F.xxhash64("key"), F.col("splits")).alias("split"), "raw", "ids")
    queries = asked.mapInArrow(place, "name string, query binary, grp long").join(if_few(splits), F.col("grp") == F.col("g"))
    queries = queries.select("name", "query", "grp", F.explode(F.sequence(F.lit(0).cast("long"), F.col("splits") - 1)).alias("split"))

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        rows, q = from_raw(left.column("raw")), from_raw(right.column("query"))
        lists, names, out = left.column("ids").to_pylist(), right.column("name").to_pylist(), []
        for s in range(0, len(q) if len(rows) else 0, TOGETHER):
            for name, scores in zip(names[s : s + TOGETHER], products(q[s : s + TOGETHER], rows), strict=True):
                out += [(name, i, max(-_LONGEST - 1, min(_LONGEST, v)), in_order(v)) for v, i in best(scores, lists, k + 1)]
        columns = list(zip(*out, strict=True)) or [[], [], [], []]
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["key", "vec_id", "score", "order"])

    found = needed.groupBy("grp", "split").cogroup(queries.groupBy("grp", "split")).applyInArrow(of_groups(solve), "key string, vec_id long, score long, order string")
    return answers(found, ids, k, "long", "order")


def op8_topk(spark, sf_dir: str) -> DataFrame:
    from graphloom.llm.common import table

    return top_scores(table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0")


OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""
