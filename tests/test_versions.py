"""Committed runs and the upsert votes table."""
import tempfile

import pytest
from pyspark.sql import functions as F

from siftwise.operators import sinks as K
from siftwise.operators import versions as VS
from siftwise.operators.vote_table import VoteTable
from siftwise.operators.votes import consensus


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_a_run_is_seen_whole_or_not_at_all(spark):
    base = tempfile.mkdtemp(prefix="sw-versions-")
    rows = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    assert VS.read(spark, base, "id long").count() == 0
    assert VS.write(rows(1, 2), base, "a") == 1
    VS.stage(rows(3), base, "b")                                   # stopped between the two steps
    assert ids(VS.read(spark, base, "id long")) == [1, 2]
    assert VS.write(rows(3, 4), base, "b") == 2                    # repeated: replaces what was left
    assert VS.write(rows(9), base, "a") == 1                       # committed before: nothing happens
    assert ids(VS.read(spark, base, "id long")) == [1, 2, 3, 4]
    assert VS.write(rows(7), base, "c", VS.REPLACE) == 3
    assert VS.write(rows(8), base, "d") == 4
    assert ids(VS.read(spark, base, "id long")) == [7, 8]
    assert [ids(VS.read(spark, base, "id long", v)) for v in (1, 2, 3)] == [[1, 2], [1, 2, 3, 4], [7]]
    assert {r["run"] for r in VS.read(spark, base, "id long").collect()} == {"c", "d"}


def test_partitioned_runs_prune(spark):
    base = tempfile.mkdtemp(prefix="sw-versions-")
    for run in ("a", "b"):
        VS.write(spark.range(20).select("id", (F.col("id") % 4).cast("int").alias("bucket")), base, run, partition_by=("bucket",))
    got = VS.read(spark, base, "id long, bucket int").where("bucket = 3")
    assert ids(got) == sorted([3, 7, 11, 15, 19] * 2)
    assert len(got.inputFiles()) <= len(VS.read(spark, base, "id long, bucket int").inputFiles())
    assert "PartitionFilters: [isnotnull(bucket" in got._jdf.queryExecution().toString()


def test_failed_and_repeated_verdict_run(spark):
    base = tempfile.mkdtemp(prefix="sw-verdicts-")
    v = spark.createDataFrame([("a", "org/m:1", "1", "r", "t", "nl"), ("b", "org/m:1", "0", "r", "t", "nl")],
                              "id string, model string, label string, reasoning string, text string, lang string")
    from datetime import datetime
    at = datetime(2026, 1, 2, 3, 4)
    VS.stage(v.limit(1).drop("lang"), base, "org-m-1-20260102-0304", fmt="json")
    assert K.read_verdict_runs(spark, base).count() == 0
    assert K.write_verdicts(v, base, at) == "org-m-1-20260102-0304"
    assert K.write_verdicts(v, base, at) == "org-m-1-20260102-0304"
    assert ids(K.read_verdict_runs(spark, base)) == ["a", "b"]


def table_of(rows):
    """Last vote of every (id, model), and the consensus counts, in plain Python."""
    last = {}
    for i, m, label in rows:
        if label in ("0", "1", " 1") and i is not None and m is not None:
            last[i, m] = int(label)
    items = {}
    for (i, _), v in last.items():
        items[i] = items.get(i, 0) + v
    n, t = len({m for _, m in last}), 2
    c = [len(items), sum(v >= t for v in items.values()), sum(v <= n - t for v in items.values()), sum(n - t < v < t for v in items.values())]
    return {(i, m, v) for (i, m), v in last.items()}, c


@pytest.mark.parametrize("compact_every", [2, 100])
def test_upserts_and_tallies(spark, compact_every):
    votes = VoteTable(spark, tempfile.mkdtemp(prefix="sw-votes-"), buckets=3, compact_every=compact_every)
    assert votes.votes().count() == 0 and votes.tallies().count() == 0
    batches = [
        [("a", "m1", "1"), ("a", "m2", "0"), ("b", "m1", "1"), ("b", "m2", " 1"), (None, "m1", "1"), ("c", None, "1"), ("c", "m1", "x")],
        [("a", "m1", "0"), ("a", "m1", "1"), ("c", "m1", "0"), ("d", "m3", None)],
        [("a", "m2", "1"), ("b", "m1", "0"), ("b", "m1", None), ("d", "m3", "1")],
        [],
        [("a", "m1", "0"), ("e", "m1", "1"), ("e", "m2", "1"), ("e", "m3", "1")],
    ]
    seen = []
    for k, b in enumerate(batches):
        df = spark.createDataFrame([(*r, "f", 0, j) for j, r in enumerate(b)], "id string, model string, label string, path string, block long, row long")
        assert votes.upsert(df, k)
        assert not votes.upsert(df.withColumn("label", F.lit("1")), k)            # the same batch again
        VS.stage(df.select("id"), votes.path, f"batch-{k + 1:012d}")               # an attempt that fails before its commit
        seen += b
        want, c = table_of(seen)
        assert {(r["id"], r["model"], r["vote"]) for r in votes.votes().collect()} == want
        got = votes.consensus(2).first()
        assert [got["n_items"], got["relevant"], got["irrelevant"], got["conflict"]] == c
        by_id = votes.votes().groupBy("id").agg(F.sum("vote").alias("n_pos"))
        assert tuple(got) == tuple(consensus(by_id, len({m for _, m, _ in want}), 2).first())
    live = VS.live(VS.log(spark, votes.path))
    assert len(live) <= compact_every + 1
    assert any(e.run.startswith("compact") for e in live) == (compact_every == 2)
    assert votes.votes(version=2).count() == len(table_of(batches[0] + batches[1])[0])
