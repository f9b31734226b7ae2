"""Keyed tables on plain files: upserts, deletes and diffs as set operations."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_last(rows: DataFrame, key: list[str], *version: Column) -> DataFrame:
    """Of the rows with one key the one with the highest version, compared column by column.

    One aggregate with map-side combine: a key with very many versions sends one row for
    each task.
    """
    rest = [c for c in rows.columns if c not in key]
    last = F.max_by(F.struct(*rest), F.struct(*version)).alias("_last")
    return rows.groupBy(*key).agg(last).select(*key, *[F.col("_last")[c].alias(c) for c in rest]).select(*rows.columns)


def upsert(table: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """Rows of changes replace those of the table with their key; both must be unique by it."""
    return table.join(changes.select(*key), key, "left_anti").unionByName(changes)


def delete(table: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return table.join(keys.select(*on).distinct(), on, "left_anti")


def delete_files(
    tables: dict[str, DataFrame], files: DataFrame, nodes: dict[str, str], edges: list[str], file_table: str = "file"
) -> dict[str, DataFrame]:
    """Removes files, the nodes in them and all edges that touch one of these.

    ``nodes`` gives the column that names the file; files has one column, id.
    """
    gone = files.select("id").distinct()
    lost = [
        t.join(gone, t[column] == gone.id, "left_semi").select(t["id"])
        for name, column in nodes.items()
        for t in [tables[name]]
    ]
    dead = functools.reduce(DataFrame.union, [*lost, gone]).distinct()
    out = dict(tables)
    for name, column in nodes.items():
        out[name] = tables[name].join(gone, tables[name][column] == gone.id, "left_anti")
    for name in edges:
        e = tables[name]
        out[name] = e.join(dead, e.from_id == dead.id, "left_anti").join(
            dead.withColumnRenamed("id", "_to"), F.col("to_id") == F.col("_to"), "left_anti"
        )
    out[file_table] = tables[file_table].join(gone, "id", "left_anti")
    return out


def replace_files(table: DataFrame, fresh: DataFrame, column: str = "file_id") -> DataFrame:
    """All rows of the files that fresh has are replaced by its rows."""
    return table.join(fresh.select(column).distinct(), column, "left_anti").unionByName(fresh)


def hash_diff(stored: DataFrame, current: DataFrame, key: str, value: str) -> DataFrame:
    """key, old and new hash and added, modified, deleted or unchanged."""
    s = stored.select(key, F.col(value).alias("old"))
    c = current.select(key, F.col(value).alias("new"))
    change = (
        F.when(F.col("old").isNull(), "added")
        .when(F.col("new").isNull(), "deleted")
        .when(F.col("old") != F.col("new"), "modified")
        .otherwise("unchanged")
    )
    return s.join(c, key, "full_outer").withColumn("change", change)


def missing(expected: DataFrame, present: DataFrame, on: list[str]) -> DataFrame:
    return expected.join(present.select(*on).distinct(), on, "left_anti")


def first_seen(lists: list[DataFrame], key: str) -> DataFrame:
    """Concatenates ranked lists (column rank); of rows with one key the first list's first stays."""
    joined = functools.reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True),
        [d.withColumn("list", F.lit(i)) for i, d in enumerate(lists)],
    )
    at = F.row_number().over(Window.partitionBy(key).orderBy("list", "rank"))
    return joined.withColumn("_at", at).filter("_at = 1").drop("_at")


def older_than(table: DataFrame, column: str, cutoff) -> DataFrame:
    """What a retention rule keeps."""
    return table.filter(F.col(column) >= F.lit(cutoff))
