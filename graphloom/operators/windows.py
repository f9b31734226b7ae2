"""Ranks, shares and trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.numeric import half_up_to


def top_per_group(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """Spark keeps n rows of a group in each task before the shuffle (WindowGroupLimit)."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("rank") <= n)


def ranked(df: DataFrame, order: list[Column], name: str = "rank", first: int = 0) -> DataFrame:
    """A global rank.  Meant for results that a limit has bounded already."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)) - 1 + first)


def over_max(df: DataFrame, column: str, out: str) -> DataFrame:
    """The column divided by its maximum, which is aggregated and joined back as one row."""
    most = df.agg(F.max(column).alias("_max"))
    return df.crossJoin(F.broadcast(most)).withColumn(out, F.when(F.col("_max") > 0, F.col(column) / F.col("_max")).otherwise(0.0)).drop("_max")


def over_mean(df: DataFrame, column: str, out: str) -> DataFrame:
    mean = df.agg(F.avg(column).alias("_avg"))
    return df.crossJoin(F.broadcast(mean)).withColumn(out, F.when(F.col("_avg") > 0, F.col(column) / F.col("_avg")).otherwise(0.0)).drop("_avg")


def shares(counts: DataFrame, group: str, who: str, n: str) -> DataFrame:
    total = F.sum(n).over(Window.partitionBy(group))
    return counts.withColumn("share", F.col(n) / total)


def bus_factor(counts: DataFrame, group: str, who: str, n: str, share: float = 0.8) -> DataFrame:
    """group, contributors, bus_factor and evenness (1 - Gini, 2 digits) from counts of each contributor.

    bus_factor: how many of the largest contributors it takes to reach the share.
    evenness is 0 for one contributor.
    """
    g = Window.partitionBy(group)
    falling = g.orderBy(F.col(n).desc(), who).rowsBetween(Window.unboundedPreceding, -1)
    at = F.row_number().over(g.orderBy(n, who))
    rows = counts.withColumns(
        {
            "_before": F.coalesce(F.sum(n).over(falling), F.lit(0)),
            "_all": F.sum(n).over(g),
            "_at": at,
            "_n": F.count("*").over(g),
        }
    )
    # Whole numbers on both sides: nobody is lost or gained to the last digit of a share.
    needed = F.count_if(F.col("_before") * 100 < F.col("_all") * int(round(share * 100)))
    gini = F.sum((2 * F.col("_at") - F.col("_n") - 1) * F.col(n)) / (F.max("_n") * F.max("_all"))
    return rows.groupBy(group).agg(
        F.count("*").alias("contributors"),
        needed.alias("bus_factor"),
        F.when(F.count("*") <= 1, F.lit(0.0)).otherwise(half_up_to(1 - gini, 2)).alias("evenness"),
    )


def gap_trend(events: DataFrame, key: str, at: str, last: int = 10, rising: float = 0.7, falling: float = 1.3) -> DataFrame:
    """rising, falling or stable by the last gap between a key's accesses against the one before."""
    newest = Window.partitionBy(key).orderBy(F.col(at).desc())
    rows = events.select(key, at, F.row_number().over(newest).alias("_n")).filter(F.col("_n") <= last)
    t = lambda i: F.max(F.when(F.col("_n") == i, F.col(at)))
    now, before = t(1) - t(2), t(2) - t(3)
    label = F.when(before.isNull(), "stable").when(now < before * rising, "rising").when(now > before * falling, "falling").otherwise("stable")
    return rows.groupBy(key).agg(F.count("*").alias("accesses"), label.alias("trend"))


def bucket_trend(buckets: DataFrame, key: str, at: str, value: str, last: int = 10, ends: int = 3) -> DataFrame:
    """Mean of the last three of up to ten buckets against the first three: up, down or flat."""
    w = Window.partitionBy(key)
    rows = (
        buckets.withColumn("_back", F.row_number().over(w.orderBy(F.col(at).desc())))
        .filter(F.col("_back") <= last)
        .withColumn("_n", F.count("*").over(w))
        .withColumn("_ahead", F.col("_n") - F.col("_back") + 1)
    )
    # Both ends have equally many buckets, so sums compare as means do, and exactly so.
    new = F.sum(F.when(F.col("_back") <= ends, F.col(value))) * 10
    old = F.sum(F.when(F.col("_ahead") <= ends, F.col(value)))
    label = F.when(new > old * 12, "up").when(new < old * 8, "down").otherwise("flat")
    return rows.groupBy(key).agg(F.max("_n").alias("buckets"), label.alias("trend"))
