"""Traversals over edge tables (from_id, to_id).

Loops run on the driver, each round is one distributed step, and each frontier is cut
from its lineage by a reliable checkpoint, so that plans stay short and a lost executor
costs one round.  The edges of a loop are kept partitioned by the end that it follows;
lost parts are computed again.  No vertex set is collected unless its size has been checked.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.storage import durable


@contextmanager
def resident(edges: DataFrame, key: str = "from_id") -> Iterator[DataFrame]:
    """Distinct edges, dealt out by key once for all rounds of a loop."""
    held = edges.select("from_id", "to_id").distinct().repartition(key).persist()
    try:
        yield held
    finally:
        held.unpersist()


class Seen:
    """Vertices found so far, round by round; written together now and then, so that plans stay short."""

    def __init__(self, every: int = 8):
        self.parts: list[DataFrame] = []
        self.every = every

    def add(self, hop: DataFrame) -> None:
        self.parts.append(hop)
        if len(self.parts) > self.every:
            spark = hop.sparkSession
            self.parts = [durable(self.frame().coalesce(int(spark.conf.get("spark.sql.shuffle.partitions"))))]

    def frame(self) -> DataFrame:
        out = self.parts[0]
        for p in self.parts[1:]:
            out = out.unionAll(p)
        return out


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"))


def reach(edges: DataFrame, start: DataFrame, most: int | None = None) -> DataFrame:
    """id and depth (from 1) of all vertices that the start's (column id) edges lead to, and via.

    via is the smallest parent at the least depth.  A start on a cycle is found again.
    """
    frontier = start.select("id").distinct()
    found = Seen()
    depth = 0
    with resident(edges) as step:
        while most is None or depth < most:
            depth += 1
            hop = (
                frontier.join(step, F.col("id") == F.col("from_id"))
                .groupBy(F.col("to_id").alias("next"))
                .agg(F.min("from_id").alias("via"))
            )
            if found.parts:
                hop = hop.join(found.frame().select(F.col("id").alias("next")), "next", "left_anti")
            hop = durable(hop.select(F.col("next").alias("id"), F.lit(depth).alias("depth"), "via"))
            if hop.isEmpty():
                break
            found.add(hop)
            frontier = hop.select("id")
    return found.frame() if found.parts else hop


def blast_radius(edges: DataFrame, start: DataFrame, most: int = 3, direction: str = "callers") -> DataFrame:
    """Who is affected within ``most`` hops: callers, callees or both; the start itself left out."""
    sides = {"callers": reverse(edges), "callees": edges.select("from_id", "to_id")}
    used = sides["callers"].unionAll(sides["callees"]) if direction == "both" else sides[direction]
    return reach(used, start, most).join(start.select("id"), "id", "left_anti")


def chain(edges: DataFrame, start: DataFrame, most: int = 10) -> DataFrame:
    """All (id, depth) at which a vertex lies on some walk from the start, up to ``most`` steps."""
    frontier, found = start.select("id").distinct(), None
    with resident(edges) as step:
        for depth in range(1, most + 1):
            frontier = durable(
                frontier.join(step, F.col("id") == F.col("from_id")).select(F.col("to_id").alias("id")).distinct()
            )
            level = frontier.withColumn("depth", F.lit(depth))
            found = level if found is None else found.unionAll(level)
    return found


def ancestors(nodes: DataFrame, start: DataFrame, most: int = 10) -> DataFrame:
    """id, ancestor and steps up the parent pointers (columns id, parent_id)."""
    up = nodes.select(F.col("id").alias("_c"), F.col("parent_id").alias("_p")).filter("_p IS NOT NULL")
    at = start.select("id", F.col("id").alias("ancestor"))
    found = None
    for steps in range(1, most + 1):
        at = durable(at.join(up, F.col("ancestor") == F.col("_c")).select("id", F.col("_p").alias("ancestor")))
        if at.isEmpty():
            break
        level = at.withColumn("steps", F.lit(steps))
        found = level if found is None else found.unionAll(level)
    return found if found is not None else at.withColumn("steps", F.lit(0))


def valid_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both of whose ends are nodes."""
    ids = nodes.select("id").distinct()
    return edges.join(ids, edges.from_id == ids.id, "left_semi").join(
        ids.select(F.col("id").alias("_to")), F.col("to_id") == F.col("_to"), "left_semi"
    )


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, outgoing and incoming edges of every node."""
    out = edges.groupBy(F.col("from_id").alias("id")).agg(F.count("*").alias("outgoing"))
    back = edges.groupBy(F.col("to_id").alias("id")).agg(F.count("*").alias("incoming"))
    joined = nodes.select("id").join(out, "id", "left").join(back, "id", "left")
    return joined.select("id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("outgoing", "incoming")])


def strong_components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """id and component (its smallest member) of strongly connected components.

    Colouring: the smallest id that reaches a vertex spreads forward until it settles; in
    each colour whatever reaches its root backward is one component and leaves.  Vertices
    without a way in or out leave first, alone.
    """
    left, e = durable(nodes.select("id").distinct()), durable(edges.select("from_id", "to_id").filter("from_id != to_id").distinct())
    done: DataFrame | None = None

    def leave(found: DataFrame) -> None:
        nonlocal left, e, done
        done = found if done is None else done.unionAll(found)
        gone = found.select("id")
        left = durable(left.join(gone, "id", "left_anti"))
        e = durable(valid_edges(e, left))

    while not left.isEmpty():
        while True:  # trim
            live = e.select(F.col("from_id").alias("id")).intersect(e.select(F.col("to_id").alias("id")))
            alone = durable(left.join(live, "id", "left_anti").select("id", F.col("id").alias("component")))
            if alone.isEmpty():
                break
            leave(alone)
        if left.isEmpty():
            break
        colour = durable(left.withColumn("c", F.col("id")))
        while True:
            came = e.join(colour, F.col("from_id") == F.col("id")).groupBy(F.col("to_id").alias("_t")).agg(F.min("c").alias("_c"))
            new = durable(
                colour.join(came, F.col("id") == F.col("_t"), "left").select(
                    "id", F.least("c", F.coalesce("_c", "c")).alias("c"), (F.col("_c") < F.col("c")).alias("moved")
                )
            )
            colour = new.select("id", "c")
            if new.filter("moved").isEmpty():
                break
        inside = (
            e.join(colour.withColumnsRenamed({"id": "from_id", "c": "cf"}), "from_id")
            .join(colour.withColumnsRenamed({"id": "to_id", "c": "ct"}), "to_id")
            .filter("cf = ct")
            .select("from_id", "to_id")
        )
        roots = colour.filter("id = c").select("id")
        back = reach(reverse(inside), roots).select("id").union(roots).distinct()
        leave(durable(back.join(colour, "id").select("id", F.col("c").alias("component"))))
    return done if done is not None else nodes.select("id", F.col("id").alias("component")).limit(0)


def topological_levels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, level and whether the node lies on a cycle.

    Cycles count as one: components are condensed, and a level is the longest way to a
    component from one without incoming edges.
    """
    parts = durable(strong_components(edges, nodes))
    loops = edges.filter("from_id = to_id").select(F.col("from_id").alias("id")).distinct()
    between = durable(
        valid_edges(edges, nodes)
        .join(parts.withColumnsRenamed({"id": "from_id", "component": "f"}), "from_id")
        .join(parts.withColumnsRenamed({"id": "to_id", "component": "t"}), "to_id")
        .filter("f != t")
        .select("f", "t")
        .distinct()
    )
    level = durable(parts.select("component").distinct().withColumn("level", F.lit(0)))
    depth = 0
    while True:  # everything below the frontier moves down one level, as often as the longest way asks
        depth += 1
        pushed = (
            level.filter(F.col("level") == depth - 1).join(between, F.col("component") == F.col("f")).select(F.col("t")).distinct()
        )
        new = durable(
            level.join(pushed, F.col("component") == F.col("t"), "left").select(
                "component", F.when(F.col("t").isNotNull(), depth).otherwise(F.col("level")).alias("level")
            )
        )
        moved = not new.filter(F.col("level") == depth).isEmpty()
        level = new
        if not moved:
            break
    size = Window.partitionBy("component")
    return (
        parts.join(level, "component")
        .withColumn("n", F.count("*").over(size))
        .join(loops.withColumn("loop", F.lit(True)), "id", "left")
        .select("id", "level", ((F.col("n") > 1) | F.coalesce("loop", F.lit(False))).alias("on_cycle"))
    )


def placed(levels: DataFrame, level: str, descending: bool = False) -> DataFrame:
    """Adds place: 1, 2, ... by level, then id.

    Places run on from the number of rows of the levels before, so no window spans all rows.
    """
    sizes = levels.groupBy(level).agg(F.count("*").alias("_n"))
    order = F.desc(level) if descending else F.asc(level)
    up_to = F.sum("_n").over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    before = sizes.select(level, F.coalesce(up_to, F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(level).orderBy("id"))
    return levels.withColumn("_at", inside).join(before, level).withColumn("place", F.col("_before") + F.col("_at")).drop("_at", "_before")


def dependency_order(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, level, on_cycle and place: what a node points to comes before it; cycles share a level."""
    return placed(topological_levels(reverse(edges), nodes), "level")


#: Edges that a task may hold: 4 bytes each, and their ends' ids.
HELD_EDGES = 4_000_000
#: Sources of a task, rows of a batch.
TASK_SOURCES = 64
BATCH_ROWS = 50_000


def _held(edges: DataFrame) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Vertices, where each one's targets begin, the targets, and which vertices have an edge out."""
    table = edges.toArrow()  # counted before
    start, end = (table.column(c).combine_chunks() for c in ("from_id", "to_id"))
    vertices = pa.concat_arrays([start, end.cast(start.type)]).unique().drop_null()
    f, t = (pc.index_in(x, vertices).fill_null(-1).to_numpy() for x in (start, end.cast(start.type)))
    out = np.zeros(len(vertices), bool)
    out[f[f >= 0]] = True
    whole = (f >= 0) & (t >= 0)
    f, t = f[whole], t[whole]
    return vertices, np.concatenate([[0], np.cumsum(np.bincount(f, minlength=len(vertices)))]), t[np.argsort(f, kind="stable")], out


def _walk(at: int, begins: np.ndarray, targets: np.ndarray, seen: np.ndarray, most: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Vertices that a walk from one reaches, itself first, and their depths; ``seen`` is left as it was."""
    levels = [np.array([at])]
    seen[at] = True
    while len(levels[-1]) and (most is None or len(levels) <= most):
        first, many = begins[levels[-1]], begins[levels[-1] + 1] - begins[levels[-1]]
        hop = targets[np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())]
        levels.append(np.unique(hop[~seen[hop]]))
        seen[levels[-1]] = True
    found = np.concatenate(levels)
    seen[found] = False
    return found, np.repeat(np.arange(len(levels), dtype=np.int32), [len(x) for x in levels])


def _propagate_held(step: DataFrame, sources: DataFrame, most: int | None) -> DataFrame:
    """The same with the edges in every task: each source's walk is its own."""
    graph = step.sparkSession.sparkContext.broadcast(_held(step))
    starts = durable(sources.select(F.col("id").alias("source")).distinct())
    kind = starts.schema["source"].dataType.simpleString()

    def walks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vertices, begins, targets, out = graph.value
        seen = np.zeros(len(vertices), bool)
        for b in batches:
            column = b.column("source")
            rows, held = [], 0
            for i, at in enumerate(pc.index_in(column.cast(vertices.type), vertices).to_pylist()):
                if at is None:  # a source without edges is its own sink
                    names, depths = column.slice(i, 1), np.zeros(1, np.int32)
                else:
                    found, depths = _walk(at, begins, targets, seen, most)
                    found, depths = found[~out[found]], depths[~out[found]]
                    names = vertices.take(pa.array(found)).cast(column.type)
                rows.append((column.take(pa.array(np.full(len(names), i))), names, pa.array(depths)))
                held += len(names)
                if held >= BATCH_ROWS or i == len(column) - 1:
                    yield pa.RecordBatch.from_arrays([pa.concat_arrays(list(c)) for c in zip(*rows, strict=True)], names=["source", "id", "depth"])
                    rows, held = [], 0

    tasks = max(1, -(-starts.count() // TASK_SOURCES))
    return starts.repartition(min(tasks, 1000), "source").mapInArrow(walks, f"source {kind}, id {kind}, depth int")


def propagate(edges: DataFrame, sources: DataFrame, flag: Column | None = None, most: int | None = None) -> DataFrame:
    """The sinks (no edge out) that flagged edges lead to from each source: source, id, depth.

    Edges that a task can hold, as counted, go to every task, and the sources are dealt out;
    more of them are walked along by rounds.
    """
    with resident(edges if flag is None else edges.filter(flag)) as step:
        if step.count() <= HELD_EDGES:
            return _propagate_held(step, sources, most)
        at = sources.select(F.col("id").alias("source"), "id").distinct()
        seen, depth = durable(at.withColumn("depth", F.lit(0))), 0
        frontier = at
        while most is None or depth < most:
            depth += 1
            hop = frontier.join(step.filter("to_id IS NOT NULL"), F.col("id") == F.col("from_id")).select("source", F.col("to_id").alias("id")).distinct()
            hop = durable(hop.join(seen.select("source", "id"), ["source", "id"], "left_anti").withColumn("depth", F.lit(depth)))
            if hop.isEmpty():
                break
            seen, frontier = seen.unionAll(hop), hop.select("source", "id")
        sinks = seen.join(step.select(F.col("from_id").alias("id")).distinct(), "id", "left_anti")
        return durable(sinks.select("source", "id", "depth"))


def path_exists(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """source, target and whether a way leads from one to the other."""
    starts = pairs.select(F.col("source").alias("id")).distinct()
    frontier = starts.select(F.col("id").alias("source"), "id")
    seen: DataFrame | None = None
    with resident(edges) as step:
        while True:
            hop = frontier.join(step, F.col("id") == F.col("from_id")).select("source", F.col("to_id").alias("id")).distinct()
            if seen is not None:
                hop = hop.join(seen, ["source", "id"], "left_anti")
            hop = durable(hop)
            if hop.isEmpty():
                break
            seen = hop if seen is None else seen.unionAll(hop)
            frontier = hop
    found = (seen if seen is not None else hop).select("source", F.col("id").alias("target"), F.lit(True).alias("found"))
    return pairs.join(found, ["source", "target"], "left").select("source", "target", F.coalesce("found", F.lit(False)).alias("found"))


def small_cycles(edges: DataFrame, most_edges: int = 10_000) -> list[list]:
    """Cycles of a small graph (features, modules), each from its smallest member; refuses larger ones."""
    rows = edges.select("from_id", "to_id").distinct().orderBy("from_id", "to_id").limit(most_edges + 1).collect()
    if len(rows) > most_edges:
        raise ValueError(f"more than {most_edges} edges; use strong_components")
    after: dict = {}
    for r in rows:
        after.setdefault(r.from_id, []).append(r.to_id)
    found, state = set(), {}
    for start in sorted(after):
        if start in state:
            continue
        path, stack = [], [(start, iter(after.get(start, [])))]
        state[start] = 1
        path.append(start)
        while stack:
            node, following = stack[-1]
            nxt = next(following, None)
            if nxt is None:
                state[node] = 2
                stack.pop()
                path.pop()
            elif state.get(nxt) == 1:
                cycle = path[path.index(nxt) :]
                low = cycle.index(min(cycle))
                found.add(tuple(cycle[low:] + cycle[:low]))
            elif nxt not in state:
                state[nxt] = 1
                path.append(nxt)
                stack.append((nxt, iter(after.get(nxt, []))))
    return [list(c) for c in sorted(found)]


def propagate_down(nodes: DataFrame) -> DataFrame:
    """Children without a feature take their parent's, and gain 0.1 (to 1) under a parent above 0.7.

    Columns id, parent_id, feature, confidence; one level.
    """
    up = nodes.select(F.col("id").alias("_p"), F.col("feature").alias("_f"), F.col("confidence").alias("_c"))
    joined = nodes.join(up, F.col("parent_id") == F.col("_p"), "left")
    return joined.select(
        *[c for c in nodes.columns if c not in ("feature", "confidence")],
        F.coalesce(F.nullif("feature", F.lit("")), "_f").alias("feature"),
        F.when(F.col("_c") > 0.7, F.least(F.lit(1.0), F.col("confidence") + 0.1)).otherwise(F.col("confidence")).alias("confidence"),
    )


def roll_up(nodes: DataFrame) -> DataFrame:
    """Parents with children: union of tags, one feature or all of them joined, larger of own and mean confidence."""
    child = nodes.filter("parent_id IS NOT NULL").groupBy(F.col("parent_id").alias("_p")).agg(
        F.count("*").alias("children"),
        F.avg("confidence").alias("_avg"),
        F.array_sort(F.collect_set(F.nullif("feature", F.lit("")))).alias("_features"),
        F.array_distinct(F.flatten(F.collect_set("tags"))).alias("_tags"),
    )
    return nodes.join(child, nodes.id == child["_p"]).select(
        "id",
        "children",
        F.when(F.size("_features") == 1, F.col("_features")[0]).otherwise(F.array_join("_features", ", ")).alias("feature"),
        F.greatest("confidence", "_avg").alias("confidence"),
        F.array_sort(F.array_union("tags", "_tags")).alias("tags"),
    )
