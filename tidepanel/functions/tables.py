"""Intermediate tables written to the shared folder of the session."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder the session names for checkpoints.

    Only a local session, whose driver and executors are one process, gets a temporary one; on a
    cluster such a folder would be another on every machine.
    """
    set_by_session = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not set_by_session:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        set_by_session = tempfile.mkdtemp(prefix="checkpoint-")
        spark.sparkContext.setCheckpointDir(set_by_session)
    return set_by_session.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str = "table") -> DataFrame:
    """Write a table that several later steps read, and go on from the files.

    Unlike a cache it survives lost executors, and unlike repeating the plan its input is
    computed once; readers still prune columns.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
