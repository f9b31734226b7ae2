import pytest
from pyspark.sql import functions as F

from graphloom.streaming import ledger as S


@pytest.fixture
def stream(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.statefulOperator.checkCorrectness.enabled", "false")
    return S.read(spark, str(tmp_path / "in"), events.schema), events


def run(spark, tmp_path, df, mode="append"):
    q = df.writeStream.format("memory").queryName("out").outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return spark.table("out").collect()


def test_subscription(spark, stream, tmp_path):
    live, events = stream
    got = run(spark, tmp_path, S.subscribe(live, F.col("event_type") == "purchase"))
    assert {r.event_id for r in got} == {r.event_id for r in events.filter("event_type = 'purchase'").collect()}


def test_buckets(spark, stream, tmp_path):
    live, events = stream
    got = {(r.window.start, r.event_type): r.n for r in run(spark, tmp_path, S.buckets(live, "1 day", "event_type", "value"))}
    want = {(r.window.start, r.event_type): r.n for r in events.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n")).collect()}
    assert got and all(want[k] == n for k, n in got.items()) and len(got) >= len(want) - 10


def test_sessions(spark, stream, tmp_path):
    live, _ = stream
    assert all(r.events >= 2 for r in run(spark, tmp_path, S.sessions(live, "12 hours", "user_id", 2)))


def test_correlation(spark, stream, tmp_path):
    live, events = stream
    got = {(r.query_id, r.change_id) for r in run(spark, tmp_path, S.correlate(live.filter("event_type = 'view'"), live.filter("event_type = 'purchase'"), "12 HOURS"))}
    v = events.filter("event_type = 'view'").select(F.col("user_id").alias("u"), F.col("event_id").alias("q"), F.col("ts").alias("a"))
    p = events.filter("event_type = 'purchase'").select(F.col("user_id").alias("u"), F.col("event_id").alias("c"), F.col("ts").alias("b"))
    want = {(r.q, r.c) for r in v.join(p, "u").filter("b > a AND b <= a + INTERVAL 12 HOURS").collect()}
    assert got == want and got


def test_heat(spark, stream, tmp_path):
    live, events = stream
    got = run(spark, tmp_path, S.heat(live.withColumn("entity", F.col("user_id"))), "update")
    assert {r.entity for r in got} == {r.user_id for r in events.select("user_id").distinct().collect()}
    assert all(0 < r.heat <= 1 for r in got)


def test_repeats_and_batches(spark, stream, tmp_path):
    live, events = stream
    assert len(run(spark, tmp_path, S.once(live))) == events.count()
    seen = []
    S.write_batches(live.withColumnRenamed("event_type", "path"), lambda b, i: seen.append(S.last_per_path(b).count()), str(tmp_path / "cp2")).awaitTermination(60)
    assert seen == [events.select("event_type").distinct().count()]
