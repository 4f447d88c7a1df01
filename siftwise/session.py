"""SparkSession construction and small session helpers."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "siftwise", cpus: int | str | None = None,
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """A session with the library's SQL settings.

    Under spark-submit (or with a ``--master`` in PYSPARK_SUBMIT_ARGS) master, memory,
    shuffle partitions and the checkpoint folder come from the cluster's own
    configuration; otherwise it is a local session tuned like a small cluster.
    """
    cpus = cpus or os.environ.get("BENCH_CPUS") or "*"
    parts = shuffle_partitions or (int(cpus) if str(cpus).isdigit() else 8)
    b = SparkSession.builder.appName(app)
    if not launched_by_cluster():
        b = (b.master(f"local[{cpus}]")
             .config("spark.driver.memory", os.environ.get("SIFTWISE_DRIVER_MEMORY", "16g"))
             .config("spark.sql.shuffle.partitions", str(parts))
             # small files with one row group each are read by one task each: split what can be split
             .config("spark.sql.files.maxPartitionBytes", "16m"))
    b = (
        b.config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    )
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def launched_by_cluster() -> bool:
    """True when spark-submit (or submit arguments with a master) started this program."""
    return "PYSPARK_GATEWAY_PORT" in os.environ or "--master" in os.environ.get("PYSPARK_SUBMIT_ARGS", "")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder; only a one-machine session may get one by default.

    On a cluster ``spark.checkpoint.dir`` names a shared (HDFS/S3) folder and is
    used as is; without it there is no folder that all executors see, which is an error.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors share (master {master})")
        d = tempfile.mkdtemp(prefix="siftwise-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Whole texts travel to the Python workers in batches of at most ``rows``, unless the session says otherwise:
    the default of 10,000 rows is tens of megabytes a batch, several times over."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) == 10_000:
        spark.conf.set(key, str(rows))


def bounded_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast ``df`` only when it provably holds at most ``max_rows`` rows.

    The check reads at most ``max_rows + 1`` rows (the limit stops the scan),
    so it is cheap; beyond the bound the plain frame is returned and Spark
    plans a shuffle join (AQE may still convert it at runtime).
    """
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df

