"""Mixing sources to target weights.

Each document gets a random key, the MD5 of its doc_id.  Keys are even over their range,
so equal ranges of it are a range sort within each source whose pieces are all alike, and
a source with a third of all rows has as many pieces as its rows ask for.  Prefix sums
run in three parts: sums of pieces, sums over the pieces of a source, and sums inside a
piece.  A source takes whole epochs and then cuts at its budget to the word.

Targets: the sources share the total by weight, and a target stops at ``most`` times its
source's size.  With sources in the order of the ratio at which they stop, the share of
those that don't follows from sums, without repeating until nothing is left over.

Null and empty texts have size zero and take nothing; null sources are one source, the
last; rows without doc_id share a key and stand in the order of their size.  Repeated
rows each take their own.  Only columns doc_id, text and source are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import WORD, durable, if_few

WEIGHTS = (3.0, 1.0, 2.0)
SHARE, MOST = 1.5, 2.0
#: Rows that a piece of a source's key range should hold.
PIECE_ROWS = 50_000
#: Bits of the key that number its pieces.
_PIECE_BITS = 32


def weights_in_turn(ranks: Column, weights: tuple[float, ...] = WEIGHTS) -> Column:
    """The weight of the source with this rank (from 0), repeating."""
    return F.element_at(F.array(*[F.lit(w) for w in weights]), (ranks % len(weights) + 1).cast("int"))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source and source_size to source, source_size and target; one row a source.

    Sources are groups already, so the windows run over one row for each.
    """
    # All windows here span the table of sources, not the documents.
    ranked = sizes.withColumn(
        "weight", weights_in_turn(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, weights)
    )
    all_rows = Window.partitionBy()
    by_stop = Window.orderBy(F.col("stop") / F.col("weight"), F.col("source").asc_nulls_last())
    upto = by_stop.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_stop.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (
        ranked.withColumn("stop", F.col("source_size") * F.lit(most))
        .withColumn("all", F.sum("source_size").over(all_rows) * F.lit(share))
        # What each unit of weight would get if all that stop earlier have stopped.
        .withColumn(
            "unit", (F.col("all") - F.coalesce(F.sum("stop").over(upto), F.lit(0.0))) / F.sum("weight").over(onward)
        )
        .withColumn("place", F.row_number().over(by_stop))
    )
    # The first source that doesn't stop has the unit of all that don't.
    free = F.col("unit") * F.col("weight") < F.col("stop")
    unit = F.min(F.when(free, F.struct("place", "unit"))).over(all_rows)["unit"]
    return level.select(
        "source", "source_size", F.least(F.col("stop"), F.coalesce(F.col("weight") * unit, F.col("stop"))).alias("target")
    )


def mix(
    docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST
) -> DataFrame:
    """doc_id, source, size, copy (MD5 of the text), source_size, target and taken, the words the mix takes of the row."""
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    sized = durable(
        docs.select(
            "doc_id",
            "source",
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            key.alias("key"),
            F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("copy"),
        )
    )
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    aims = targets(sources.select("source", "source_size"), weights, share, most).withColumnRenamed("source", "_s")
    aims = aims.join(sources.select(F.col("source").alias("_t"), "n"), F.expr("_s <=> _t")).drop("_t")
    # One row for each source.  Documents are joined by source; a hot one is split.
    pieces = F.greatest(F.lit(1), F.ceil(F.col("n") / PIECE_ROWS)).cast("long")
    lead = F.conv(F.substring("key", 1, _PIECE_BITS // 4), 16, 10).cast("long")
    placed = (
        sized.join(F.broadcast(aims) if _few(aims) else aims, F.expr("source <=> _s"))
        .withColumn("piece", F.shiftright(lead * pieces, _PIECE_BITS))
        .drop("_s", "n")
    )
    group = ["source", "piece"]
    before = Window.partitionBy("_s").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sums = (
        placed.groupBy(*group).agg(F.sum("size").alias("piece_size"))
        .withColumnsRenamed({"source": "_s", "piece": "_p"})
        .withColumn("earlier", F.coalesce(F.sum("piece_size").over(before), F.lit(0)))
        .drop("piece_size")
    )
    inside = (
        Window.partitionBy(*group)
        .orderBy("key", F.col("doc_id").asc_nulls_last(), "size", "copy")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    summed = placed.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(
        sums, F.expr("source <=> _s AND piece = _p")
    )
    budget = F.floor(F.col("target") + F.lit(0.5))
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - whole * F.col("source_size") - F.col("earlier") - F.col("inside")
    taken = whole * F.col("size") + F.least(F.col("size"), F.greatest(F.lit(0), rest))
    return summed.select("doc_id", "source", "size", "copy", "source_size", "target", taken.cast("long").alias("taken"))


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """The rows of docs, each as often as the mix takes it; the one at the cut comes whole.

    Rows with the same doc_id, source and text share what the mix takes of all of them,
    each with its own other columns: so many times each, and one more of some.  Rows of
    size zero are taken never.
    """
    times = F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(0)
    plan = durable(
        mix(docs, weights, share, most)
        .groupBy(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("copy").alias("_c"))
        .agg(F.sum(times).cast("long").alias("_times"), F.count("*").alias("_rows"))
        .filter("_times > 0")
    )
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_rest")
    keyed = docs.select(
        rest,
        F.col("doc_id").alias("_i"),
        F.col("source").alias("_o"),
        F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("_t"),
    )
    same = F.expr("_i <=> _d AND _o <=> _s AND _t = _c")
    # A row that stands alone needs no number among its like.
    alone = keyed.join(plan.filter("_rows = 1"), same).select("_rest", "_times")
    nth = F.row_number().over(Window.partitionBy("_i", "_o", "_t").orderBy(F.xxhash64("_rest"))) - 1
    others = keyed.join(if_few(plan.filter("_rows > 1")), same).withColumn("_n", nth).select(
        "_rest", (F.floor(F.col("_times") / F.col("_rows")) + F.when(F.col("_n") < F.col("_times") % F.col("_rows"), 1).otherwise(0)).alias("_times")
    )
    return (
        alone.unionAll(others)
        .filter("_times > 0")
        .select("_rest", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times"))))
        .select("_rest.*")
    )


def _few(aims: DataFrame, most: int = 20_000) -> bool:
    """Whether the sources are few enough to broadcast; counts no further than that."""
    return aims.limit(most + 1).count() <= most


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    from graphloom.llm.common import table

    return mix(table(spark, sf_dir, "documents")).drop("source", "copy")


OP4_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, md5(COALESCE(CAST(doc_id AS VARCHAR), '')) AS k,
         COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents
), sources AS (
  SELECT source, SUM(size)::BIGINT AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT *, (CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END)::DOUBLE AS w,
         source_size * 2.0::DOUBLE AS stop
  FROM sources
), level AS (
  SELECT *, ((SUM(source_size) OVER ()) * 1.5::DOUBLE
            - COALESCE(SUM(stop) OVER (ORDER BY stop / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / SUM(w) OVER (ORDER BY stop / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS unit,
         row_number() OVER (ORDER BY stop / w, source NULLS LAST) AS place
  FROM ranked
), aims AS (
  SELECT source, source_size,
         LEAST(stop, COALESCE(w * (SELECT unit FROM level WHERE unit * w < stop ORDER BY place LIMIT 1), stop)) AS target
  FROM level
), summed AS (
  SELECT s.doc_id, s.size, a.source_size, a.target,
         COALESCE(SUM(s.size) OVER (PARTITION BY s.source ORDER BY k, s.doc_id NULLS LAST, s.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before,
         FLOOR(a.target + 0.5)::BIGINT AS budget
  FROM sized s JOIN aims a ON s.source IS NOT DISTINCT FROM a.source
)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0
            ELSE (budget // source_size) * size + LEAST(size, GREATEST(0, budget % source_size - before)) END::BIGINT AS taken
FROM summed
"""
