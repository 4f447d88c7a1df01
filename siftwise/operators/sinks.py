"""Sinks and persisted state."""

from __future__ import annotations

import hashlib
import json
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import model_slug
from ..sources.tables import VERDICT_SCHEMA
from . import versions as VS
from .metrics import LEADERBOARD_HEADER

SOURCES = ("hub", "local")


def source_path(source: str, hub_path: str, local_path: str) -> str:
    """Pick the item feed location; an unknown source is an error."""
    if source not in SOURCES:
        raise ValueError(f"unsupported source {source!r}; use one of {SOURCES}")
    return hub_path if source == "hub" else local_path


def write_verdicts(verdicts: DataFrame, path: str, run_ts: datetime | None = None, fmt: str = "json", run: str | None = None) -> str:
    """K1/K2: one row per item with the full untruncated text, as one committed run of the table
    at ``path``, in folders by language and model slug; ``run_ts`` (to the minute) tells runs apart.

    The run is named after its models' slugs and the time (or ``run``); writing it again
    after a failure replaces what was left of it, and does nothing once it is committed.
    Returns the name."""
    ts = (run_ts or datetime.now(timezone.utc)).strftime("%Y%m%d-%H%M")
    out = verdicts.withColumn("model_slug", model_slug("model")).withColumn("run_ts", F.lit(ts))
    if run is None:
        slugs = sorted(r[0] or "" for r in out.select("model_slug").distinct().collect())       # the run's models
        run = VS.run_name(*(slugs if len(slugs) < 3 else [f"{len(slugs)}-models-{config_key({'models': slugs})}"]), ts)
    VS.write(out, path, run, partition_by=tuple(c for c in ("lang", "model_slug") if c in out.columns), fmt=fmt)
    return run


def read_verdict_runs(spark: SparkSession, path: str, version: int | None = None, fmt: str = "json", extra: str | None = None) -> DataFrame:
    """The verdicts of all committed runs (as of ``version``), with ``run``, ``run_ts`` and
    ``file_order``: by the order of commits, then by file and position in it."""
    more = "run_ts string, lang string, model_slug string" + (f", {extra}" if extra else "")
    schema = T.StructType([*VERDICT_SCHEMA.fields, *T.StructType.fromDDL(more).fields])
    entries = VS.log(spark, path, version)
    rows = VS.read(spark, path, schema, version, fmt)
    if not entries:
        return rows.withColumn("file_order", F.lit(None).cast("struct<version:bigint>"))
    order = spark.createDataFrame([(e.version, e.run) for e in entries], "version long, run string")      # one row a run
    return (VS.positions(rows).join(F.broadcast(order), "run")
            .withColumn("file_order", F.struct("version", "run", "file_order")).drop("version"))


def write_leaderboard_csv(board: DataFrame, path: str) -> None:
    """K4: the leaderboard as one CSV with the display header (the table is one
    row per model or ensemble, so a single output file is bounded)."""
    named = board.select(*[F.col(c).alias(LEADERBOARD_HEADER.get(c, c)) for c in board.columns])
    named.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def config_key(config: dict) -> str:
    """K5: stable hash of a feature configuration, used as the cache folder name."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()[:16]


def cached_features(spark: SparkSession, base: str, config: dict, build) -> DataFrame:
    """K5: reuse features written for the same configuration, else build and write them."""
    path = f"{base.rstrip('/')}/features-{config_key(config)}"
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":      # a broken or unreadable cache is not rebuilt over
            raise
        build().write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)


def save_tables(tables: dict[str, DataFrame], path: str) -> None:
    """K6: relational model state (vocabulary, log-probabilities, priors) as Parquet."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}")


def load_tables(spark: SparkSession, path: str, names) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path.rstrip('/')}/{n}") for n in names}
