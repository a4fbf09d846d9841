"""The operators' registered queries (production parameters, whole tables) and their SQL."""

from __future__ import annotations

import importlib
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
MODULES = ["queries"]


def importable(spark: SparkSession) -> SparkSession:
    """Lets Python workers of this session import the package from where the driver has it,
    where they see that folder; elsewhere it has to be installed or shipped with the job."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    known = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in known:
        env["PYTHONPATH"] = os.pathsep.join([*known, root])
    return spark


def query(name: str, sql: str | None = None):
    """Register a (spark, sf_dir) -> DataFrame function, with its SQL where there is one."""
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def all_queries():
    for name in MODULES:
        importlib.import_module(f"dataward.llm.{name}")
    return QUERIES, ORACLES
