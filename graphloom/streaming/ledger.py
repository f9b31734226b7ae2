"""The ledger as a stream: subscriptions, time buckets, sessions, correlations, keyed state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LATE = "10 minutes"


def read(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """New files of a folder; batches are bounded by their number."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def subscribe(stream: DataFrame, wanted: Column) -> DataFrame:
    return stream.filter(wanted)


def once(stream: DataFrame, key: str = "event_id", at: str = "ts", late: str = LATE) -> DataFrame:
    """Repeated events within the lateness go; state is dropped behind the watermark."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def buckets(stream: DataFrame, width: str, by: str, value: str, at: str = "ts", late: str = LATE) -> DataFrame:
    """Counts and means by tumbling windows of event time."""
    return (
        stream.withWatermark(at, late)
        .groupBy(F.window(at, width), by)
        .agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.max(value).alias("most"))
    )


def sliding(stream: DataFrame, width: str, step: str, by: str, value: str, at: str = "ts", late: str = LATE) -> DataFrame:
    return stream.withWatermark(at, late).groupBy(F.window(at, width, step), by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def sessions(stream: DataFrame, gap: str, session: str, least: int = 3, at: str = "ts", late: str = LATE) -> DataFrame:
    """Sessions that end at a pause, with at least so many events."""
    return (
        stream.withWatermark(at, late)
        .groupBy(F.session_window(at, gap), session)
        .agg(F.count("*").alias("events"), F.collect_set("event_type").alias("types"))
        .filter(F.col("events") >= least)
    )


def correlate(queries: DataFrame, changes: DataFrame, within: str, session: str = "user_id", at: str = "ts", late: str = LATE) -> DataFrame:
    """Changes up to ``within`` after a query of the same session; both sides' state is bounded by watermarks."""
    q = queries.select(F.col(session).alias("s"), F.col("event_id").alias("query_id"), F.col(at).alias("q_ts")).withWatermark("q_ts", late)
    c = changes.select(F.col(session).alias("s2"), F.col("event_id").alias("change_id"), F.col(at).alias("c_ts")).withWatermark("c_ts", late)
    bound = F.expr(f"s = s2 AND c_ts > q_ts AND c_ts <= q_ts + INTERVAL {within}")
    return q.join(c, bound).select("s", "query_id", "change_id")


def heat(stream: DataFrame, entity: str = "entity", at: str = "ts", factor: float = 0.95, interval_seconds: float = 3600.0, forget_after: str = "7 days") -> DataFrame:
    """Heat by entity: each access adds 0.1 to what is left of it, at most 1; entities without access are forgotten.

    State is one number and a time for each entity, dropped behind the watermark.
    """
    wait = int(pd.Timedelta(forget_after).total_seconds() * 1000)

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(parts)).sort_values("at", kind="stable")
        value, last = state.get if state.exists else (0.0, float(rows["at"].iloc[0]))
        for t in rows["at"]:
            value = min(1.0, value * factor ** (max(0.0, t - last) / interval_seconds) + 0.1)
            last = max(last, float(t))
        state.update((float(value), last))
        state.setTimeoutTimestamp(max(int(last * 1000), state.getCurrentWatermarkMs()) + wait)
        yield pd.DataFrame({"entity": [key[0]], "heat": [value], "at": [last]})

    rows = stream.withWatermark(at, LATE).select(F.col(entity).alias("entity"), at, F.col(at).cast("double").alias("at"))
    return rows.groupBy("entity").applyInPandasWithState(
        update, f"entity {dict(rows.dtypes)['entity']}, heat double, at double", "value double, last double", "update", GroupStateTimeout.EventTimeTimeout
    )


def last_per_path(batch: DataFrame, path: str = "path", at: str = "ts") -> DataFrame:
    """Of a micro-batch of file events the last of each path."""
    rest = [c for c in batch.columns if c != path]
    return batch.groupBy(path).agg(F.max_by(F.struct(*rest), at).alias("e")).select(path, "e.*")


def write_batches(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Hands each micro-batch to a function; without ``every`` it takes what there is and stops."""
    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
