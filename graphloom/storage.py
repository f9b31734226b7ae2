"""Cutting lineage so that a lost executor costs one step: files in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` as the session has it.

    Without it a session in one process, as in tests, gets a local folder; one on a cluster
    is refused, since its executors couldn't read the driver's.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        given = spark.conf.get("spark.checkpoint.dir", None)
        if not given and not (sc.master or "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(given or tempfile.mkdtemp(prefix="graphloom-"))
    return sc.getCheckpointDir().rstrip("/")


def durable(df: DataFrame) -> DataFrame:
    """A reliable checkpoint.  For narrow rows: it stores them uncompressed."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Written as Parquet and read again, for rows with texts."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
