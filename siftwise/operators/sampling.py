"""Ordered heads, seeded shuffles and seed selection.

Positional selection ("the first k rows in feed order") is exact and
distributed: the frame is range-partitioned and sorted, each row's position
is its offset inside its sorted partition plus the sizes of the partitions
before it.  The offset table has one row per partition (it is broadcast), so
no task ever holds more than one partition's rows, whatever k is, and nothing
passes through the driver.
"""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import RANDOM_SEED


def seeded_key(id_col, seed: int = RANDOM_SEED) -> Column:
    """Q3: reproducible pseudo-random order key, independent of partitioning."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat(F.lit(str(seed)), F.lit(":"), c.cast("string")))


def with_position(df: DataFrame, order_cols: list[str], partitions: int | None = None) -> DataFrame:
    """Add ``pos`` (0-based global position in ``order_cols`` order).

    The sorted frame is checkpointed (reliable checkpoint in the shared
    ``spark.checkpoint.dir``) so positions stay fixed if an executor is lost
    and the range boundaries would otherwise be re-sampled.
    """
    # without a count, adaptive execution sizes the partitions from the shuffled bytes
    dealt = df.repartitionByRange(partitions, *order_cols) if partitions else df.repartitionByRange(*order_cols)
    ordered = (dealt
               .sortWithinPartitions(*order_cols)
               .withColumn("_pid", F.spark_partition_id())
               .withColumn("_mono", F.monotonically_increasing_id())
               .persist(StorageLevel.MEMORY_AND_DISK))
    sorted_df = ordered.checkpoint()      # written from the persisted copy, not recomputed
    ordered.unpersist()
    sizes = sorted_df.groupBy("_pid").agg(F.count("*").alias("_n"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    # one row per partition: bounded by the partition count
    return (sorted_df.join(F.broadcast(offsets), "_pid")
            .withColumn("pos", F.col("_off") + F.col("_mono") - F.shiftleft(F.col("_pid").cast("long"), 33))
            .drop("_pid", "_mono", "_off"))


def ratio_count(n: int, ratio: float | None) -> int:
    """``max(1, ceil(n * ratio))``; ratio must be in (0, 1]."""
    if ratio is None:
        return n
    if not (0 < ratio <= 1):
        raise ValueError("ratio must be a number in (0, 1]")
    return max(1, math.ceil(n * ratio))


def head_ratio(df: DataFrame, order_cols: list[str], ratio: float | None) -> DataFrame:
    """The first ``max(1, ceil(n*ratio))`` rows in ``order_cols`` order."""
    if ratio is not None and not (0 < ratio <= 1):
        raise ValueError("ratio must be a number in (0, 1]")
    if ratio is None:
        return df
    positioned = with_position(df, order_cols)
    n = positioned.count()   # cheap: reads the checkpoint's row count
    k = ratio_count(n, ratio)
    return positioned.where(F.col("pos") < k)


def seed_sample(candidates: DataFrame, pool: DataFrame, size: int, seed: int = RANDOM_SEED,
                id_col: str = "id") -> DataFrame:
    """Q2: ``size`` items drawn (seeded) from the candidates, or from the whole pool
    when there are fewer than ``size`` candidates.  A top-``size`` selection."""
    n_cand = candidates.select(F.count("*")).scalar()
    tagged = (candidates.select(id_col).withColumn("_from", F.lit(1))
              .unionByName(pool.select(id_col).withColumn("_from", F.lit(0))))
    chosen = tagged.where(F.col("_from") == F.when(n_cand >= size, 1).otherwise(0))
    return (chosen.select(id_col, seeded_key(id_col, seed).alias("draw_key"))
            .orderBy("draw_key", id_col).limit(size))
