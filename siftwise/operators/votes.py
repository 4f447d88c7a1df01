"""Votes, consensus and unanimity.

Votes stay in long form ``(id, model, label, ...)``; the wide matrix is an
output format only.  All aggregations are partial (map-side combined), so a hot
id or a dominant model never gathers its rows in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CONSENSUS_THRESHOLD
from ..functions.numeric import round_fixed
from ..functions.text import strip_ws


def label_value(col) -> Column:
    """A label as a number ('1', ' 1', '1.0' and 1 are all 1.0); NULL if unparsable."""
    c = F.col(col) if isinstance(col, str) else col
    return strip_ws(c.cast("string")).try_cast("double")


def canonical_label(col) -> Column:
    """0 or 1, or NULL for anything else."""
    v = label_value(col)
    return F.when(v == 1.0, F.lit(1)).when(v == 0.0, F.lit(0)).otherwise(F.lit(None).cast("int"))


def numeric_label(col) -> Column:
    """The label as an integer; unparsable or missing becomes -1."""
    v = label_value(col)
    return F.coalesce(v.try_cast("int"), F.lit(-1))


def first_votes(votes: DataFrame, order_col: str | None = None, keep_label: bool = True,
                keep_null: bool = False) -> DataFrame:
    """A1: the first non-null vote per (id, model); duplicates resolved by ``order_col``
    (default: ``seq`` if there is one, else the reader's ``file_order``).

    Output ``(id, model, model_rank, label STRING, vote INT)`` where ``label`` is
    the stripped raw label and ``vote`` its canonical 0/1 value.  With
    ``keep_label=False`` only integers are aggregated (``vote`` and ``pred``, the
    X16 coercion), which plans as a hash aggregate instead of a sort aggregate.

    A NULL order comes last but never drops a vote.  ``keep_null`` also returns each
    (id, model) that has NULL labels only (vote NULL, prediction -1, ``voted`` false), so
    that such items stay in item counts and evaluation totals.
    """
    if order_col is None:
        order_col = "seq" if "seq" in votes.columns else "file_order"
    keep = [c for c in ("model_rank",) if c in votes.columns]
    lab = strip_ws(F.col("label").cast("string"))
    order = F.col(order_col)
    whole = votes.schema[order_col].dataType.typeName() in ("byte", "short", "integer", "long")
    order = (F.coalesce(order.cast("long"), F.lit((1 << 63) - 1)) if whole
             else F.struct(order.isNull().alias("last"), order.alias("at")))
    order = F.when(F.col("label").isNotNull(), order)          # min_by skips rows without an order
    if keep_label:
        agg = [F.min_by(lab, order).alias("label")]
    else:
        agg = [F.min_by(canonical_label(lab), order).alias("vote"),
               F.coalesce(F.min_by(numeric_label(lab), order), F.lit(-1)).alias("pred")]
    agg += [F.min(c).alias(c) for c in keep]
    if keep_null:
        agg.append((F.count("label") > 0).alias("voted"))
    rows = votes if keep_null else votes.where(F.col("label").isNotNull())
    out = rows.groupBy("id", "model").agg(*agg)
    return out.withColumn("vote", canonical_label("label")) if keep_label else out


def vote_matrix(first: DataFrame, models: list[str]) -> DataFrame:
    """D8/A1 output: one column per model (explicit list, so no extra pass)."""
    return first.groupBy("id").pivot("model", models).agg(F.max("label"))


def longest_text(votes: DataFrame) -> DataFrame:
    """A2: the longest text seen per id (ties: the greatest text)."""
    return votes.groupBy("id").agg(
        F.max_by("text", F.struct(F.length("text"), F.col("text"))).alias("text"),
        F.max(F.length("text")).cast("long").alias("text_len"))


def item_vote_counts(first: DataFrame, rank_limits: list[int] | None = None) -> DataFrame:
    """A3: per id the number of votes equal to 1 (missing or unparsable count as not 1).

    With ``rank_limits`` the counts are taken for several model prefixes in the
    same pass (``pos_k`` = votes of models with ``model_rank <= k``).
    """
    if not rank_limits:
        return first.groupBy("id").agg(
            F.sum(F.when(F.col("vote") == 1, 1).otherwise(0)).alias("n_pos"),
            F.count("*").alias("n_votes"))
    aggs = []
    for k in rank_limits:
        inside = F.col("model_rank") <= k
        aggs.append(F.sum(F.when(inside & (F.col("vote") == 1), 1).otherwise(0)).alias(f"pos_{k}"))
        aggs.append(F.max(inside).alias(f"has_{k}"))
    return first.groupBy("id").agg(*aggs)


def consensus(per_item: DataFrame, n_models: int | Column, threshold: int = CONSENSUS_THRESHOLD,
              votes_col: str = "n_pos", group_cols: list[str] | None = None, weight_col: str | None = None) -> DataFrame:
    """A4/A5: relevant if votes >= T, irrelevant if votes <= N - T (independent tallies).

    ``overlap`` counts items in both tallies (possible when N >= 2T); the
    conflict set is N - T < votes < T.  ``group_cols`` evaluates several
    annotator sets in one aggregation; ``weight_col``: the items that a row stands for.
    """
    v = F.col(votes_col)
    one = F.lit(1) if weight_col is None else F.col(weight_col)
    n = n_models if isinstance(n_models, Column) else F.lit(n_models)
    lo = n - threshold
    rel, irr = v >= threshold, v <= lo
    grouped = per_item.groupBy(*group_cols) if group_cols else per_item.groupBy()
    return grouped.agg(
        (F.count("*") if weight_col is None else F.coalesce(F.sum(one), F.lit(0))).alias("n_items"),
        F.sum(F.when(rel, one).otherwise(0)).alias("relevant"),
        F.sum(F.when(irr, one).otherwise(0)).alias("irrelevant"),
        F.sum(F.when((v > lo) & (v < threshold), one).otherwise(0)).alias("conflict"),
        F.sum(F.when(rel & irr, one).otherwise(0)).alias("overlap"),
    ).select("*", (F.col("relevant") + F.col("irrelevant")).alias("high_confidence"),
             round_fixed(F.col("conflict") * 100.0 / F.col("n_items"), 4).alias("conflict_pct"))


def consensus_bounds(per_item: DataFrame, lo: int, hi: int, votes_col: str = "n_pos") -> DataFrame:
    """Relevant if votes > hi, irrelevant if votes < lo, conflict otherwise."""
    v = F.col(votes_col)
    return per_item.agg(
        F.count("*").alias("n_items"),
        F.sum(F.when(v > hi, 1).otherwise(0)).alias("relevant"),
        F.sum(F.when(v < lo, 1).otherwise(0)).alias("irrelevant"),
        F.sum(F.when((v >= lo) & (v <= hi), 1).otherwise(0)).alias("conflict"),
    )


def conflict_items(per_item: DataFrame, n_models: int, threshold: int = CONSENSUS_THRESHOLD,
                   votes_col: str = "n_pos") -> DataFrame:
    """items whose vote count lies strictly between the two consensus bounds."""
    v = F.col(votes_col)
    return per_item.where((v > n_models - threshold) & (v < threshold))


def unanimous(first: DataFrame, models: list[str]) -> DataFrame:
    """Items on which every listed model voted, all with the same 0/1 label.

    One aggregation instead of N-1 joins; the text is the first model's text
    when carried on ``first`` (column ``text``).
    """
    sel = first.where(F.col("model").isin(models) & F.col("vote").isNotNull())
    aggs = [F.min("vote").alias("lo"), F.max("vote").alias("hi"),
            F.count("*").alias("n_models")]   # first votes: one row per (id, model)
    return (sel.groupBy("id").agg(*aggs)
            .where((F.col("lo") == F.col("hi")) & (F.col("n_models") == len(models)))
            .select("id", F.col("lo").alias("label")))
