"""Majority votes and model ensembles.

Binary ensembles use bitmasks: each model gets a bit by its F1 rank, each item
a ``pos`` mask (members voting 1) and a ``present`` mask (members that voted).
For an ensemble mask m: p = bit_count(pos & m), k = bit_count(present & m);
vote = NULL if k = 0, 1 if 2p > k, else 0 (a tie goes to "0", the configured
priority).  Items are first collapsed to distinct (pos, present, gold)
signatures with a count, so evaluating thousands of ensembles touches at most
3^N * 2 rows however many items are labelled.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ENSEMBLE_MAX_MODELS, ENSEMBLE_MIN_COMBO, ENSEMBLE_TOP_K, TIE_BREAK_PRIORITY


def slug(model: str) -> str:
    return model.split("/")[-1]


def ensemble_definitions(ranked: list[str], top_k=ENSEMBLE_TOP_K, max_models: int = ENSEMBLE_MAX_MODELS,
                         min_size: int = ENSEMBLE_MIN_COMBO) -> list[tuple[str, int, int]]:
    """``(name, mask, size)`` for all-model, top-K and every combination of
    ``min_size``..N-1 models (only when N <= ``max_models``); names that repeat
    (same short names) are kept once, first one wins.  Bounded by the cap."""
    n = len(ranked)
    if n < 2:
        return []
    out = [(f"ensemble::all ({n})", (1 << n) - 1, n)]
    out += [(f"ensemble::top-{k}", (1 << k) - 1, k) for k in top_k if k < n]
    seen = {name for name, _, _ in out}
    if n <= max_models:
        for r in range(min_size, n):
            for combo in combinations(range(n), r):
                name = "ensemble::combo(" + "+".join(slug(ranked[i]) for i in combo) + ")"
                if name in seen:
                    continue
                seen.add(name)
                out.append((name, sum(1 << i for i in combo), r))
    return out


def model_bits(ranked: list[str]) -> Column:
    """Literal map model -> bit (rank order)."""
    pairs = []
    for i, m in enumerate(ranked):
        pairs += [F.lit(m), F.lit(1 << i).cast("long")]
    return F.create_map(*pairs)


def vote_masks(first: DataFrame, ranked: list[str], positive: Column | None = None,
               keep: tuple[str, ...] = ()) -> DataFrame:
    """Per id: ``pos`` and ``present`` bitmasks over the ranked models.

    ``positive`` marks a vote for class 1 (default ``vote = 1``); ``keep`` carries
    per-id columns (e.g. the gold label) through the aggregation."""
    if "voted" in first.columns:            # rows without any label are no votes
        first = first.where("voted")
    bit = model_bits(ranked)[F.col("model")]
    pos = positive if positive is not None else (F.col("vote") == 1)
    return (first.where(F.col("model").isin(ranked))
            .groupBy("id", *keep).agg(
                F.bit_or(F.when(pos, bit).otherwise(F.lit(0).cast("long"))).alias("pos"),
                F.bit_or(bit).alias("present")))


def mask_vote(pos: Column, present: Column, mask) -> Column:
    m = mask if isinstance(mask, Column) else F.lit(mask).cast("long")
    p, k = F.bit_count(pos.bitwiseAND(m)), F.bit_count(present.bitwiseAND(m))
    return F.when(k == 0, F.lit(None).cast("int")).when(2 * p > k, F.lit(1)).otherwise(F.lit(0))


def definitions_column(defs: list[tuple[str, int, int]]) -> Column:
    return F.array(*[F.struct(F.lit(n).alias("model"), F.lit(m).cast("long").alias("mask"),
                              F.lit(s).cast("long").alias("members")) for n, m, s in defs])


def ensemble_confusion(masks_gold: DataFrame, defs: list[tuple[str, int, int]]) -> DataFrame:
    """Confusion counts of every ensemble on (id, pos, present, gold) rows.

    Output matches ``metrics.confusion_counts``: model, tn, fp, fn, tp, n, t0, t1.
    """
    sig = masks_gold.groupBy("pos", "present", "gold").agg(F.count("*").alias("cnt"))
    totals = sig.agg(F.sum("cnt").alias("n"),
                     F.sum(F.when(F.col("gold") == 0, F.col("cnt")).otherwise(0)).alias("t0"),
                     F.sum(F.when(F.col("gold") == 1, F.col("cnt")).otherwise(0)).alias("t1"))
    per = (sig.select("*", F.explode(definitions_column(defs)).alias("e"))
           .select("gold", "cnt", F.col("e.model").alias("model"), F.col("e.members").alias("members"),
                   mask_vote(F.col("pos"), F.col("present"), F.col("e.mask")).alias("pred")))
    g, p, c = F.col("gold"), F.col("pred"), F.col("cnt")

    def cell(gv, pv):
        return F.sum(F.when((g == gv) & (p == pv), c).otherwise(0))

    cm = per.groupBy("model", "members").agg(cell(0, 0).alias("tn"), cell(0, 1).alias("fp"),
                                             cell(1, 0).alias("fn"), cell(1, 1).alias("tp"))
    tot = totals.select(F.struct("n", "t0", "t1")).scalar()
    return cm.select("*", tot["n"].alias("n"), tot["t0"].alias("t0"), tot["t1"].alias("t1"))


def majority_vote(first: DataFrame, priority: list[str] = TIE_BREAK_PRIORITY,
                  label_col: str = "label") -> DataFrame:
    """Most frequent label per id; ties go to the first label in ``priority``,
    then to the alphabetically first.  Nulls are ignored; no votes -> no row."""
    prio = F.coalesce(F.array_position(F.array(*[F.lit(p) for p in priority]), F.col(label_col)),
                      F.lit(len(priority) + 1))
    counts = (first.where(F.col(label_col).isNotNull())
              .groupBy("id", label_col).agg(F.count("*").alias("n")))
    ranked = counts.withColumn("_prio", prio)
    return ranked.groupBy("id").agg(
        F.min_by(label_col, F.struct((-F.col("n")).alias("a"), F.col("_prio").alias("b"),
                                     F.col(label_col).alias("c"))).alias("majority"),
        F.max("n").alias("top_count"),
        F.sum("n").alias("n_voters"))
