"""Fixture votes reproduce the documented tallies; ensemble properties."""
from pyspark.sql import functions as F

from siftwise.operators import ensembles as E
from siftwise.plans import QUERIES

from .conftest import SF_MID


def test_consensus_regions(spark):
    got = {r["k"]: (r["relevant"], r["irrelevant"], r["conflict"], r["overlap"])
           for r in QUERIES["vote_consensus"](spark, SF_MID).collect()}
    assert got[3] == (239, 148, 613, 0)
    assert got[4] == (496, 220, 284, 0)
    assert got[5] == (641, 359, 0, 0)
    assert got[6][3] > 0          # N >= 2T: overlapping tallies are reported


def test_confusion_matches_fixture(spark):
    got = {r["model"]: (r["tn"], r["fp"], r["fn"], r["tp"])
           for r in QUERIES["confusion_by_model"](spark, SF_MID).collect()}
    assert got["a/flip5"] == (45, 13, 63, 278)
    assert got["a/flip7"] == (49, 9, 52, 289)
    assert got["b/long"] == (37, 21, 163, 178)
    assert got["b/words"] == (4, 48, 51, 260)
    assert got["c/flip3"] == (41, 14, 99, 221)


def test_ensemble_of_copies_equals_voter(spark):
    first = spark.createDataFrame(
        [(i, m, v) for i, v in enumerate([1, 0, 1, 1, None]) for m in ("x/a", "y/a", "z/a")],
        "id long, model string, vote int").where(F.col("vote").isNotNull())
    masks = E.vote_masks(first, ["x/a", "y/a", "z/a"])
    got = {r["id"]: r["v"] for r in masks.select("id", E.mask_vote(F.col("pos"), F.col("present"), 7).alias("v")).collect()}
    assert got == {0: 1, 1: 0, 2: 1, 3: 1}


def test_definitions_dedupe_and_caps():
    defs = E.ensemble_definitions(["a/m1", "b/m1", "c/m2", "d/m3"])
    names = [d[0] for d in defs]
    assert len(names) == len(set(names))
    assert names[0] == "ensemble::all (4)" and "ensemble::top-3" in names and "ensemble::top-5" not in names
    assert ("ensemble::combo(m1+m2+m3)", 0b1101, 3) in defs      # first of the equal names wins
    assert E.ensemble_definitions(["a"]) == []
    over_cap = E.ensemble_definitions([f"m/{i}" for i in range(13)])
    assert not any(d[0].startswith("ensemble::combo") for d in over_cap) and len(over_cap) == 3


def test_majority_tie_prefers_zero(spark):
    first = spark.createDataFrame([(1, "a", "1"), (1, "b", "0"), (2, "a", "1"), (2, "b", "1"), (2, "c", "0")],
                                  "id long, model string, label string")
    got = {r["id"]: r["majority"] for r in E.majority_vote(first).collect()}
    assert got == {1: "0", 2: "1"}


def test_ranking_ties_at_three_decimals_go_alphabetical(spark):
    from siftwise.operators import metrics as M
    board = spark.createDataFrame([("b/x", 0.8004), ("a/y", 0.7996), ("c/z", 0.9)], "model string, f1_1 double")
    rounded = board.select("model", (F.bround(F.col("f1_1") * 1000, 0) / 1000).alias("f1_1"))
    got = [r["model"] for r in M.rank_models(rounded).orderBy("rank").collect()]
    assert got == ["c/z", "a/y", "b/x"]      # 0.800 == 0.800: name order decides


def test_two_two_tie_goes_to_zero(spark):
    first = spark.createDataFrame([(1, m, v) for m, v in (("a/1", 1), ("b/2", 1), ("c/3", 0), ("d/4", 0))],
                                  "id long, model string, vote int")
    masks = E.vote_masks(first, ["a/1", "b/2", "c/3", "d/4"])
    assert masks.select(E.mask_vote(F.col("pos"), F.col("present"), 15).alias("v")).first()["v"] == 0
    none = masks.select(E.mask_vote(F.col("pos"), F.col("present"), 1 << 5).alias("v")).first()["v"]
    assert none is None                      # no member voted -> NULL (evaluated as -1)
