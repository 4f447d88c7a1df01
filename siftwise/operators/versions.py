"""Tables as committed runs (K1, K7): what a run wrote is seen whole or not at all.

A table is a folder: ``data/run=<name>/`` holds what a run wrote, ``log/<name>`` one JSON row
for every run that is part of the table.  A run first writes its data (a repeated attempt
overwrites its own folder only) and then its log row, a single file that appears by one
rename; readers look at the log first and at nothing that is not in it.  So a run that
fails in between is not seen, one that is repeated after it was committed does nothing,
and two writers never touch each other's files.

The rows of the log are ordered by version (one more than the highest that the writer saw)
and run name.  A reader may ask for an older version.  A run either adds to the table or
replaces what was there before; replaced data stays readable under its version.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

LOG = "version long, run string, action string, note string"
APPEND, REPLACE = "append", "replace"


@dataclass(frozen=True)
class Entry:
    """A committed run; ``note`` is the writer's own."""
    version: int
    run: str
    action: str
    note: str | None = None


def log(spark: SparkSession, path: str, version: int | None = None) -> list[Entry]:
    """The committed runs up to ``version``, in order (one row a run)."""
    try:
        rows = spark.read.schema(LOG).json(f"{path.rstrip('/')}/log/*").collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = []
    entries = [Entry(*r) for r in rows if r["run"] is not None]
    return sorted((e for e in entries if version is None or e.version <= version), key=lambda e: (e.version, e.run))


def live(entries: list[Entry]) -> list[Entry]:
    """Of ordered entries, those whose data make up the table: the last replacement and what came after."""
    last = max((k for k, e in enumerate(entries) if e.action == REPLACE), default=0)
    return entries[last:]


def committed(spark: SparkSession, path: str, run: str) -> bool:
    return any(e.run == run for e in log(spark, path))


def stage(df: DataFrame, path: str, run: str, partition_by: tuple[str, ...] = (), fmt: str = "parquet") -> None:
    """First step of a run: its data, which nobody sees yet."""
    df.write.mode("overwrite").partitionBy(*partition_by).format(fmt).save(f"{path.rstrip('/')}/data/run={run}")


def commit(spark: SparkSession, path: str, run: str, action: str = APPEND, note: str | None = None) -> int:
    """Second step: the run becomes part of the table.  Returns its version; a run that is already
    part of it keeps the one it has."""
    entries = log(spark, path)
    for e in entries:
        if e.run == run:
            return e.version
    version = max((e.version for e in entries), default=0) + 1
    row = spark.createDataFrame([(version, run, action, note)], LOG).coalesce(1)
    row.write.mode("overwrite").json(f"{path.rstrip('/')}/log/{run}")
    return version


def write(df: DataFrame, path: str, run: str, action: str = APPEND, partition_by: tuple[str, ...] = (), fmt: str = "parquet", note: str | None = None) -> int:
    """Both steps; nothing is written again for a run that is part of the table."""
    spark = df.sparkSession
    if not committed(spark, path, run):
        stage(df, path, run, partition_by, fmt)
    return commit(spark, path, run, action, note)


def read(spark: SparkSession, path: str, schema: StructType | str, version: int | None = None, fmt: str = "parquet") -> DataFrame:
    """The table (with a column ``run``) as of ``version`` or now.  ``schema`` holds the data columns;
    a table without a run is empty."""
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    schema = StructType([f for f in schema.fields if f.name != "run"]).add("run", "string")
    base = f"{path.rstrip('/')}/data"
    runs = live(log(spark, path, version))
    if not runs:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", base).format(fmt).load([f"{base}/run={e.run}" for e in runs])


def run_name(*parts: str) -> str:
    """A name that can be a folder: parts joined by ``-``, anything but letters, digits, ``.``, ``_`` and ``-`` as ``-``."""
    return "-".join("".join(c if c.isalnum() or c in "._-" else "-" for c in p) for p in parts)


def positions(df: DataFrame) -> DataFrame:
    """``df`` as read from files, with ``file_order``: by file, then block, then row within the task's block."""
    return df.withColumn("file_order", F.struct(
        F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")))
