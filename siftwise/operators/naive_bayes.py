"""Relational multinomial naive Bayes on TF-IDF weights (L1) and uncertainty (Q1).

The fitted model is a table ``(term, lp0, lp1)`` bounded by the vocabulary
size, plus one prior per class; scoring is a broadcast join by term and a
per-document sum.  Class priors are not
smoothed (unlike Spark ML's NaiveBayes), matching the common reference formula.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CLASSES = [0, 1]


def fit_wide(weights: DataFrame, labels: DataFrame, vocab: DataFrame, alpha: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Return ``(model (term, lp0, lp1), priors (label, log_prior))`` for classes 0/1.

    ``weights``: (id, term, weight); ``labels``: (id, label); ``vocab``: (term).
    Both classes' feature sums come from one aggregation by term; class totals
    and the vocabulary size are scalar subqueries.
    """
    lab = labels.select("id", "label")
    per_term = (weights.join(lab, "id").groupBy("term").agg(
        *[F.sum(F.when(F.col("label") == c, F.col("weight")).otherwise(0.0)).alias(f"fc{c}") for c in CLASSES]))
    full = vocab.select("term").join(per_term, "term", "left").select(
        "term", *[F.coalesce(f"fc{c}", F.lit(0.0)).alias(f"fc{c}") for c in CLASSES])
    model = _model(full, alpha)
    counts = lab.groupBy("label").agg(F.count("*").alias("n_c"))
    priors = counts.select("label", F.log(F.col("n_c") / counts.select(F.sum("n_c")).scalar()).alias("log_prior"))
    return model, priors


def count_changes(weights: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """What a change of labels does to the model's counts: (term, fc0, fc1) to be added to what is
    there; the row with a null term holds the documents of each class.

    ``before`` and ``after``: (id, label).  Only documents whose label is new, gone or another
    are read; a changed label takes from one class what it gives to the other."""
    moved = (after.select("id", F.col("label").alias("new")).join(before.select("id", F.col("label").alias("old")), "id", "full_outer")
             .where(~F.col("new").eqNullSafe(F.col("old"))))
    sign = lambda c: (F.coalesce(F.col("new") == c, F.lit(False)).cast("int") - F.coalesce(F.col("old") == c, F.lit(False)).cast("int"))
    moved = moved.select("id", *[sign(c).alias(f"s{c}") for c in CLASSES])
    terms = weights.join(moved, "id").groupBy("term").agg(*[F.sum(F.col("weight") * F.col(f"s{c}")).alias(f"fc{c}") for c in CLASSES])
    docs = moved.agg(*[F.coalesce(F.sum(f"s{c}"), F.lit(0)).cast("double").alias(f"fc{c}") for c in CLASSES])
    return terms.unionByName(docs.withColumn("term", F.lit(None).cast("string")))


COUNTS = "term string, fc0 double, fc1 double"


def from_counts(changes: DataFrame, vocab: DataFrame, alpha: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(model, priors) as of :func:`fit_wide`, from all changes so far (``COUNTS``); a class without
    documents has no prior."""
    counts = changes.groupBy("term").agg(*[F.sum(f"fc{c}").alias(f"fc{c}") for c in CLASSES])
    full = vocab.select("term").join(counts.where(F.col("term").isNotNull()), "term", "left").select(
        "term", *[F.coalesce(f"fc{c}", F.lit(0.0)).alias(f"fc{c}") for c in CLASSES])
    docs = counts.where(F.col("term").isNull()).select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("label"), F.col(f"fc{c}").alias("n")) for c in CLASSES])).alias("x")).select("x.label", "x.n").where(F.col("n") > 0)
    return _model(full, alpha), docs.select("label", F.log(F.col("n") / docs.select(F.sum("n")).scalar()).alias("log_prior"))


def _model(full: DataFrame, alpha: float) -> DataFrame:
    """(term, lp0, lp1) from the summed weights (term, fc0, fc1) of the whole vocabulary."""
    sizes = full.select(F.struct(F.count("*").alias("v"),
                                 *[F.sum(f"fc{c}").alias(f"t{c}") for c in CLASSES]).alias("s")).scalar()
    return full.select("term", *[F.log((F.col(f"fc{c}") + alpha) / (sizes[f"t{c}"] + alpha * sizes["v"]))
                                 .alias(f"lp{c}") for c in CLASSES])


def fit(weights: DataFrame, labels: DataFrame, vocab: DataFrame, alpha: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Long form ``(log_probs (label, term, log_prob), priors)`` of :func:`fit_wide`."""
    model, priors = fit_wide(weights, labels, vocab, alpha)
    long = model.select("term", F.explode(F.array(*[
        F.struct(F.lit(c).alias("label"), F.col(f"lp{c}").alias("log_prob")) for c in CLASSES])).alias("x"))
    return long.select("x.label", "term", "x.log_prob"), priors


def log_odds(weights: DataFrame, docs: DataFrame, model: DataFrame, priors: DataFrame) -> DataFrame:
    """``(id, log_odds)`` = log P(1|d) - log P(0|d) for every row of ``docs`` (id).

    ``model`` is the wide ``(term, lp0, lp1)`` table (vocabulary-sized, so it is
    broadcast).  Documents without any vocabulary term keep the prior difference.
    """
    diff = model.select("term", (F.col("lp1") - F.col("lp0")).alias("d"))
    prior_d = (priors.select(F.sum(F.when(F.col("label") == 1, F.col("log_prior")).otherwise(0.0))
                     - F.sum(F.when(F.col("label") == 0, F.col("log_prior")).otherwise(0.0))).scalar())
    contrib = (weights.join(F.broadcast(diff), "term")   # vocabulary-sized: bounded by max_features
               .groupBy("id").agg(F.sum(F.col("weight") * F.col("d")).alias("s")))
    return (docs.select("id").join(contrib, "id", "left")
            .select("id", (prior_d + F.coalesce("s", F.lit(0.0))).alias("log_odds")))


def probability(lo) -> F.Column:
    c = F.col(lo) if isinstance(lo, str) else lo
    return 1.0 / (1.0 + F.exp(-c))


def least_confident(scored: DataFrame, k: int, digits: int = 8) -> DataFrame:
    """Q1: the k items whose top class probability is lowest (|log-odds| ascending,
    rounded so ties are resolved by id on every engine).  A bounded top-k."""
    s = float(10 ** digits)
    key = F.round(F.abs(F.col("log_odds")) * s, 0) / s
    p = probability("log_odds")
    return (scored.select("id", key.alias("_k"), (F.round(F.greatest(p, 1 - p) * s, 0) / s).alias("confidence"))
            .orderBy("_k", "id").limit(k).drop("_k"))
