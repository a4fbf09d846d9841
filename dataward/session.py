"""Shared-storage helpers: where lineage is cut and scratch tables are written."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@cache
def _local_dir() -> str:
    return tempfile.mkdtemp(prefix="dataward-")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temp folder only in local mode without one."""
    configured = (spark.conf.get("spark.checkpoint.dir", None)
                  or spark.sparkContext.getCheckpointDir())
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    return _local_dir()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark)}/dataward/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write once as parquet and read back: cuts lineage, survives lost executors, and
    keeps column pruning and filter pushdown for the readers that follow."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
