"""Ledger entries to and from JSON lines; commits from a log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEDGER = "seq long, ts timestamp, session_id string, event_type string, source string, entity_ids array<string>, files array<string>, payload string"
COMMIT = "sha string, message string, author string, at timestamp, files array<struct<path:string,status:string,additions:int,deletions:int>>"


def export(ledger: DataFrame, path: str) -> None:
    ledger.write.mode("errorifexists").json(path)


def load(spark: SparkSession, path: str, schema: str = LEDGER) -> DataFrame:
    return spark.read.schema(schema).json(path)


def commit_files(commits: DataFrame) -> DataFrame:
    """One row for each file of a commit, with its place in it."""
    return commits.select("sha", "author", "at", F.posexplode("files").alias("place", "f")).select("sha", "author", "at", "place", "f.*")
