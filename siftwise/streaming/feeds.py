"""Structured Streaming versions of bulk classification and verdict ingest.

Both are file-source streams with a checkpoint in the shared folder, written
with ``foreachBatch`` so every micro-batch is an ordinary batch write:
restarting after a failure resumes from the checkpoint without re-scoring
processed files.  ``trigger(availableNow=True)`` drains what is there and stops.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import has_text
from ..operators import classify as C
from ..operators.vote_table import VoteTable
from ..sources.tables import ITEM_SCHEMA, VERDICT_SCHEMA

def classify_stream(spark: SparkSession, source_dir: str, model, out_dir: str, checkpoint: str,
                    file_glob: str = "*.json", bytes_per_batch: int = 64 << 30, encoder=None, dim: int | None = None) -> None:
    """Arriving NDJSON item files (``id, text``) -> F1 -> encode -> model ->
    relevant/irrelevant/quarantine.

    ``foreachBatch`` runs at least once, so each micro-batch owns the folder
    ``batch=<epoch>`` and overwrites it: a batch that is run again replaces itself."""
    stream = (spark.readStream.schema(ITEM_SCHEMA).option("maxBytesPerTrigger", bytes_per_batch)
              .option("pathGlobFilter", file_glob).json(source_dir)
              .where(has_text("text")).select("id", "text"))

    def write(batch: DataFrame, epoch: int) -> None:
        # K8: per-batch totals observed while the batch is written (no second pass)
        obs = Observation(f"routes_{epoch}")
        routed = C.classify(model, C.encode(batch, encoder=encoder), dim).observe(
            obs, F.count(F.lit(1)).alias("processed"),
            F.sum(F.when(F.col("route") == "relevant", 1).otherwise(0)).alias("relevant"),
            F.sum(F.when(F.col("route") == "quarantine", 1).otherwise(0)).alias("quarantine"))
        C.write_routes(routed.select("id", "text", "route"), f"{out_dir}/batch={epoch}")
        m = obs.get
        spark.createDataFrame([(m.get("processed", 0), m.get("relevant") or 0, m.get("quarantine") or 0)],
                              "processed long, relevant long, quarantine long") \
            .write.mode("overwrite").parquet(f"{out_dir}_progress/batch={epoch}")

    q = (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def verdict_stream(spark: SparkSession, source: str, table_dir: str, checkpoint: str, extra: str | None = None) -> None:
    """Verdict files appear as runs finish; each micro-batch becomes one folder of the
    votes table (``batch=<epoch>``, overwritten when the batch is run again).  Duplicates
    are resolved on read by the first-vote rule over ``file_order``; ``extra`` adds DDL
    fields next to those of the format."""
    schema = VERDICT_SCHEMA if not extra else T.StructType(VERDICT_SCHEMA.fields + T.StructType.fromDDL(extra).fields)
    stream = spark.readStream.schema(schema).json(source).withColumn("run_file", F.col("_metadata.file_name")).withColumn(
        "file_block", F.col("_metadata.file_block_start"))

    def write(batch: DataFrame, epoch: int) -> None:
        ordered = batch.withColumn("file_order", F.struct(
            F.lit(epoch).alias("batch"), F.col("run_file").alias("file"), F.col("file_block").alias("block"),
            F.monotonically_increasing_id().alias("row"))).drop("file_block")
        ordered.write.mode("overwrite").parquet(f"{table_dir}/batch={epoch}")

    q = (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def verdict_upserts(spark: SparkSession, source: str, votes: VoteTable, checkpoint: str, files_per_batch: int = 1000) -> None:
    """Verdict files as they appear, each micro-batch taken into the votes table once: a batch
    that runs again finds itself committed and changes nothing."""
    stream = (spark.readStream.schema(VERDICT_SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(source)
              .select("id", "model", "label", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block")))

    def take(batch: DataFrame, epoch: int) -> None:
        votes.upsert(batch.withColumn("row", F.monotonically_increasing_id()), epoch)

    q = (stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
