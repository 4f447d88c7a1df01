"""Active-learning rounds over saved labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import labels as L
from . import sampling as Q


def start(pool: DataFrame, candidates: DataFrame, saved: DataFrame | None, size: int) -> tuple[DataFrame, DataFrame | None]:
    """(labels to go on with, queue to label first).

    With saved labels (id, label, round, seq) work is resumed: ids that are not in the
    pool are left out, the last label per id counts, and there is nothing to label
    first.  Without, the queue is the seed: ``size`` of the candidates, or of the whole
    pool if they are too few."""
    if saved is None:
        return None, Q.seed_sample(candidates, pool, size).select("id")
    known, _ = L.resume(saved, pool.select("id"))
    return L.upsert_labels(known).select("id", "label", F.col("last_round").alias("round")), None


def record(saved: DataFrame | None, queue: DataFrame, answers: DataFrame, rnd: int, stop_after: int | None = None) -> DataFrame:
    """Saved labels with this round's valid answers (0 or 1).

    ``queue(id[, rank])`` was shown in rank order; a labeller who stops after
    ``stop_after`` items has their answers saved, the rest stays open."""
    shown = queue if stop_after is None else queue.where(F.col("rank") <= stop_after)
    new = (shown.select("id").join(answers, "id").where(L.is_valid_label("label"))
           .select("id", "label", F.lit(rnd).alias("round"), F.lit(1).alias("seq")))
    return new if saved is None else saved.select("id", "label", "round", "seq").unionByName(new)


def ranked(queue: DataFrame) -> DataFrame:
    """A queue with ranks: surest last, ties by id (one row per queued item)."""
    return queue.withColumn("rank", F.row_number().over(Window.orderBy("confidence", "id")).cast("long"))
