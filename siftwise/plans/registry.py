"""Query registry: name -> (Spark builder, oracle SQL or None)."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import bounded_batches, ensure_checkpoint_dir

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name`` with its oracle SQL.

    The registered callable first makes sure the session has a checkpoint
    folder (the cluster's shared ``spark.checkpoint.dir`` when set) and sends texts to
    Python workers in bounded batches.
    """
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ensure_checkpoint_dir(spark)
            bounded_batches(spark)
            return fn(spark, sf_dir.rstrip("/"))

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco
