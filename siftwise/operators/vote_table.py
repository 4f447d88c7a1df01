"""Votes as an upsert table with running tallies.

Verdicts arrive in batches; the last label of an (id, model) counts.  The table is a list of
committed runs (``versions``): every batch adds its votes, in files by bucket of the id, and,
in its log row, the signed changes of the tallies, so both appear at once; now and then a
compaction replaces all runs by one with the votes and tallies as they stand.  A batch reads only the buckets that its ids fall in,
and of those one compacted file and the runs since, not every batch there ever was.

Tallies are counts of items by the number of votes equal to 1, and of votes by model (a few
numbers for each model, whatever the table's size).  When a
vote of an item changes, the item leaves one count (-1) and enters another (+1); the sum of
all changes is the tally, so the consensus of the whole table is read from a few rows.

A batch that is committed is skipped when it comes again; one that failed before its commit
left nothing that counts.  Batches are one writer's work, in order.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import versions as VS
from .votes import canonical_label, consensus

BUCKETS = 16
COMPACT_EVERY = 4

VOTES = "id string, model string, vote int, at struct<batch:bigint,path:string,block:bigint,row:bigint>, bucket int"
TALLIES = "kind string, key string, change long"
ITEMS, MODELS = "items", "models"      # kinds of tallies


class VoteTable:
    """The table at ``path``.  ``buckets`` must stay what it was when the table was made."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, compact_every: int = COMPACT_EVERY):
        self.spark, self.path, self.buckets, self.compact_every = spark, path.rstrip("/"), buckets, compact_every

    def _bucket(self):
        return F.pmod(F.xxhash64("id"), F.lit(self.buckets)).cast("int")

    def votes(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """(id, model, vote, at, bucket): the last vote of every (id, model), of some buckets or all."""
        rows = VS.read(self.spark, self.path, VOTES, version)
        if buckets is not None:
            rows = rows.where(F.col("bucket").isin(buckets))          # prunes files
        return _last(rows)

    def tallies(self, version: int | None = None) -> DataFrame:
        """(kind, key, n): items by number of positive votes, votes by model."""
        changes = [tuple(c) for e in VS.live(VS.log(self.spark, self.path, version)) for c in json.loads(e.note or "[]")]
        return (self.spark.createDataFrame(changes, TALLIES).groupBy("kind", "key").agg(F.sum("change").alias("n"))
                .where(F.col("n") != 0))

    def consensus(self, threshold: int, version: int | None = None) -> DataFrame:
        """A4/A5 of the whole table, from the tallies alone."""
        t = self.tallies(version)
        n_models = t.where(F.col("kind") == MODELS).select(F.count("*")).scalar()
        items = t.where(F.col("kind") == ITEMS).select(F.col("key").cast("int").alias("n_pos"), F.col("n").alias("weight"))
        return consensus(items, n_models, threshold, weight_col="weight")

    def upsert(self, batch: DataFrame, number: int) -> bool:
        """Take in a batch of verdicts (id, model, label, path, block, row); False if it was taken in before.

        Rows without an id, a model or a label that is 0 or 1 change nothing."""
        run = f"batch-{number:012d}"
        if VS.committed(self.spark, self.path, run):
            return False
        at = F.struct(F.lit(number).cast("long").alias("batch"), "path", "block", "row")
        new = _last(batch.select("id", "model", canonical_label("label").alias("vote"), at.alias("at"))
                    .where(F.col("id").isNotNull() & F.col("model").isNotNull() & F.col("vote").isNotNull())
                    .withColumn("bucket", self._bucket())).checkpoint()
        touched = sorted(r[0] for r in new.select("bucket").distinct().collect())     # at most ``buckets`` numbers
        old = self.votes(buckets=touched).join(new.select("id").distinct(), "id", "left_semi")
        changes = [tuple(r) for r in self._changes(old, new).collect()]               # a few numbers for each model
        VS.write(new.repartition("bucket"), self.path, run, partition_by=("bucket",), note=json.dumps(sorted(changes)))
        if len(VS.live(VS.log(self.spark, self.path))) > self.compact_every:
            self.compact()
        return True

    def _changes(self, old: DataFrame, new: DataFrame) -> DataFrame:
        """(kind, key, change) that ``new`` votes make to items whose votes were ``old``."""
        after = _last(old.unionByName(new))

        def counts(votes: DataFrame, sign: int) -> DataFrame:
            items = votes.groupBy("id").agg(F.sum("vote").alias("n")).groupBy(F.col("n").cast("string").alias("key")).agg(F.count("*").alias("change"))
            models = votes.groupBy(F.col("model").alias("key")).agg(F.count("*").alias("change"))
            both = items.withColumn("kind", F.lit(ITEMS)).unionByName(models.withColumn("kind", F.lit(MODELS)))
            return both.withColumn("change", F.col("change") * sign)

        return (counts(old, -1).unionByName(counts(after, 1)).groupBy("kind", "key").agg(F.sum("change").alias("change"))
                .where(F.col("change") != 0).select("kind", "key", "change"))

    def compact(self) -> None:
        """One run with the votes and tallies as they stand in place of all so far."""
        entries = VS.log(self.spark, self.path)
        if entries:
            run = f"compact-{entries[-1].version:012d}"
            note = json.dumps(sorted(tuple(r) for r in self.tallies().collect()))
            VS.write(self.votes().repartition("bucket"), self.path, run, VS.REPLACE, ("bucket",), note=note)


def _last(votes: DataFrame) -> DataFrame:
    """K7: the last vote of every (id, model)."""
    return votes.groupBy("id", "model", "bucket").agg(F.max_by("vote", "at").alias("vote"), F.max("at").alias("at"))
