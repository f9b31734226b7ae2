"""Relationship lookups: edges joined to the entities at their ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _side(nodes: DataFrame, prefix: str, columns: list[str]) -> DataFrame:
    return nodes.select(*[F.col(c).alias(f"{prefix}_{c}") for c in columns])


def with_path(entities: DataFrame, files: DataFrame) -> DataFrame:
    """Adds file_path; entities without a known file go."""
    return entities.join(files.select(F.col("id").alias("file_id"), F.col("path").alias("file_path")), "file_id")


def neighbours(edges: DataFrame, nodes: DataFrame, at: Column, outgoing: bool, columns: list[str]) -> DataFrame:
    """The nodes at the other end of the edges whose near end satisfies ``at`` (on from_id and to_id)."""
    far = "to_id" if outgoing else "from_id"
    return edges.filter(at).join(nodes.select(F.col("id").alias(far), *columns), far)


def link(edges: DataFrame, left: DataFrame, right: DataFrame, left_columns: list[str], right_columns: list[str]) -> DataFrame:
    """Both ends' columns, with from_ and to_ before their names, and the edge's own."""
    a = _side(left, "from", ["id", *left_columns])
    b = _side(right, "to", ["id", *right_columns])
    return edges.join(a, "from_id").join(b, "to_id")


def by_name(left: DataFrame, right: DataFrame, left_column: str, right_columns: list[str]) -> DataFrame:
    """Resolves a column that holds a name; all bearers of the name match."""
    other = right.select(F.col("name").alias("_n"), *[F.col(c).alias(f"resolved_{c}") for c in right_columns])
    return left.join(other, left[left_column] == other["_n"]).drop("_n")


def split_dependencies(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges that start in the members (id), with internal or external by where they end."""
    ids = members.select("id").distinct()
    inside = ids.select(F.col("id").alias("_to"))
    return (
        edges.join(ids, edges.from_id == ids.id, "left_semi")
        .join(inside, F.col("to_id") == F.col("_to"), "left")
        .withColumn("kind", F.when(F.col("_to").isNotNull(), "internal").otherwise("external"))
        .drop("_to")
    )


def across(edges: DataFrame, assigned: DataFrame) -> DataFrame:
    """Edges between different features (assigned: id, feature) counted by pair."""
    a = assigned.select(F.col("id").alias("from_id"), F.col("feature").alias("from_feature"))
    b = assigned.select(F.col("id").alias("to_id"), F.col("feature").alias("to_feature"))
    return (
        edges.join(a, "from_id").join(b, "to_id").filter("from_feature != to_feature")
        .groupBy("from_feature", "to_feature").agg(F.count("*").alias("edges"))
    )


def resolve_calls(unresolved: DataFrame, functions: DataFrame, imports: DataFrame, builtins: list[str]) -> DataFrame:
    """Call sites to edges, by the first way that finds a target.

    An exported function of an imported file that names it; any function of an imported
    file; else none for built-ins; else a function of the same file.  Several candidates
    of one way: the smallest id.  Columns: caller_id, file_id, callee, line_number.
    """
    here, name = F.col("file_id"), F.col("callee")
    best = functions.groupBy(F.col("file_id").alias("ffile"), F.col("name").alias("callee")).agg(
        F.min("id").alias("any"), F.min(F.when(F.col("is_exported"), F.col("id"))).alias("open")
    )
    # a row of each name that a file calls, however many sites and functions there are of it
    wanted = unresolved.select("file_id", "callee").distinct()
    seen = imports.select(F.col("from_id").alias("file_id"), F.col("to_id").alias("ffile"), "imported_symbols")
    imported = (
        wanted.join(seen, "file_id").join(best, ["ffile", "callee"]).groupBy("file_id", "callee")
        .agg(F.min(F.when(F.array_contains("imported_symbols", name), F.col("open"))).alias("exported"), F.min("any").alias("imported"))
    )
    local = wanted.join(best.select(F.col("ffile").alias("file_id"), "callee", F.col("any").alias("local")), ["file_id", "callee"])
    own = F.when(~name.isin(builtins), F.col("local"))
    found = (
        imported.join(local, ["file_id", "callee"], "full_outer")
        .select("file_id", "callee", F.coalesce("exported", "imported", own).alias("to_id"))
        .filter("to_id IS NOT NULL")
    )
    return (
        unresolved.select("caller_id", here, name, "line_number").join(found, ["file_id", "callee"])
        .groupBy(F.col("caller_id").alias("from_id"), "to_id")
        .agg(F.max("line_number").alias("line_number"))
    )


def overlap_in_time(
    queries: DataFrame, changes: DataFrame, within_seconds: float, session: str = "session_id", shared: str | None = None
) -> DataFrame:
    """Changes up to ``within_seconds`` after a query of the same session: q_seq, c_seq, gap in seconds.

    With ``shared`` (an array column of both) they must also have an element in common;
    it then becomes part of the join key, which keeps the join an equi-join.
    """
    q = queries.select(F.col(session).alias("s"), F.col("seq").alias("q_seq"), F.col("at").alias("q_at"), *([F.explode(F.array_distinct(shared)).alias("e")] if shared else []))
    c = changes.select(F.col(session).alias("s"), F.col("seq").alias("c_seq"), F.col("at").alias("c_at"), *([F.explode(F.array_distinct(shared)).alias("e")] if shared else []))
    # The time band as buckets of its own width: an event meets those of its bucket and the next.
    width = F.lit(float(within_seconds))
    q = q.withColumn("b", F.explode(F.array(F.floor(F.col("q_at") / width), F.floor(F.col("q_at") / width) + 1)))
    c = c.withColumn("b", F.floor(F.col("c_at") / width))
    keys = ["s", "b"] + (["e"] if shared else [])
    gap = F.col("c_at") - F.col("q_at")
    joined = q.join(c, keys).filter((gap > 0) & (gap <= width))
    if shared:
        return joined.groupBy("q_seq", "c_seq").agg(F.first(gap).alias("gap"), F.count("*").alias("shared"))
    return joined.select("q_seq", "c_seq", gap.alias("gap"))
