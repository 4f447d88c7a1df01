"""Queries over ensembles of annotators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import ENSEMBLE_MAX_MODELS, ENSEMBLE_MIN_COMBO, ENSEMBLE_TOP_K
from ..operators import ensembles as E
from ..operators import metrics as M
from . import sql as S
from .q_votes import fixture_first_votes, fixture_gold_votes, fixture_scored, gold_quality
from .registry import query


def ranked_models(spark, sf_dir) -> list[str]:
    """R6 on the driver: one row per annotator (bounded by the ensemble cap)."""
    rows = M.rank_models(M.leaderboard(fixture_scored(spark, sf_dir))).orderBy("rank").collect()
    return [r["model"] for r in rows]


_TOPK_SQL = "\n".join(
    f"  UNION ALL SELECT 'ensemble::top-{k}', CAST({(1 << k) - 1} AS BIGINT), CAST({k} AS BIGINT) FROM nm WHERE {k} < n"
    for k in ENSEMBLE_TOP_K)

ENSEMBLE_CTE = f"""
ranked AS (SELECT model, row_number() OVER (ORDER BY {S.rhe('f1_1')} DESC, model) AS rank FROM scored),
nm AS (SELECT count(*) AS n FROM ranked),
masks AS (SELECT range AS mask FROM range(1, CAST(1 AS BIGINT) << (SELECT n FROM nm))),
members AS (SELECT m.mask, r.rank, r.model FROM masks m JOIN ranked r ON ((m.mask >> (r.rank - 1)) & 1) = 1),
combos0 AS (
  SELECT mask, count(*) AS size,
         'ensemble::combo(' || string_agg(regexp_extract(model, '[^/]*$'), '+' ORDER BY rank) || ')' AS name,
         string_agg(lpad(CAST(rank AS VARCHAR), 3, '0'), ',' ORDER BY rank) AS okey
  FROM members GROUP BY mask),
defs AS (
  SELECT 'ensemble::all (' || CAST(n AS VARCHAR) || ')' AS model, (CAST(1 AS BIGINT) << n) - 1 AS mask,
         CAST(n AS BIGINT) AS members FROM nm WHERE n >= 2
{_TOPK_SQL}
  UNION ALL SELECT name, arg_min(mask, okey), CAST(min(size) AS BIGINT) FROM combos0, nm
    WHERE size >= {ENSEMBLE_MIN_COMBO} AND size < n AND n <= {ENSEMBLE_MAX_MODELS} GROUP BY name),
sig AS (
  SELECT f.id, bit_or(CASE WHEN f.vote = 1 THEN CAST(1 AS BIGINT) << (r.rank - 1) ELSE CAST(0 AS BIGINT) END) AS pos,
         bit_or(CAST(1 AS BIGINT) << (r.rank - 1)) AS present
  FROM fv f JOIN ranked r ON f.model = r.model GROUP BY f.id)"""


def _ens_pred(m: str = "d.mask") -> str:
    return (f"CASE WHEN bit_count(s.present & {m}) = 0 THEN NULL "
            f"WHEN 2 * bit_count(s.pos & {m}) > bit_count(s.present & {m}) THEN 1 ELSE 0 END")


ENS_EVAL_CTE = f"""
ens_preds AS (
  SELECT d.model, d.members, g.gold, coalesce({_ens_pred()}, -1) AS pred
  FROM sig s JOIN gold g ON s.id = g.id, defs d),
ecm AS (
  SELECT model, members,
    count(*) FILTER (WHERE gold = 0 AND pred = 0) AS tn, count(*) FILTER (WHERE gold = 0 AND pred = 1) AS fp,
    count(*) FILTER (WHERE gold = 1 AND pred = 0) AS fn, count(*) FILTER (WHERE gold = 1 AND pred = 1) AS tp
  FROM ens_preds GROUP BY model, members),
all_cm AS (
  SELECT model, CAST(1 AS BIGINT) AS members, tn, fp, fn, tp FROM cm
  UNION ALL SELECT model, members, tn, fp, fn, tp FROM ecm),
all_scored AS (
  SELECT *, {S.safe_div('tp + tn', 'n')} AS accuracy, {S.safe_div('tp', 'tp + fp')} AS precision_1,
    {S.safe_div('tp', 'tp + fn')} AS recall_1,
    {S.f1(S.safe_div('tp', 'tp + fp'), S.safe_div('tp', 'tp + fn'))} AS f1_1,
    CASE WHEN {{pe}} = 1.0 THEN NULL ELSE ({S.safe_div('tp + tn', 'n')} - {{pe}}) / (1 - {{pe}}) END AS kappa
  FROM all_cm, totals)""".replace(
    "{pe}", "(CASE WHEN n = 0 THEN NULL ELSE CAST(t0 * (tn + fn) + t1 * (fp + tp) AS DOUBLE) / (n * n) END)")

_BOARD_SELECT = f"""SELECT model, members, {S.rhe('accuracy')} AS accuracy, {S.rhe('precision_1')} AS precision_1,
  {S.rhe('recall_1')} AS recall_1, {S.rhe('f1_1')} AS f1_1, {S.rhe('kappa')} AS kappa, tn, fp, fn, tp
FROM all_scored"""


def _ensemble_board(spark, sf_dir):
    ranked = ranked_models(spark, sf_dir)
    defs = E.ensemble_definitions(ranked)
    first = fixture_gold_votes(spark, sf_dir)
    gold = gold_quality(spark, sf_dir)
    preds, eval_ids = M.predictions_vs_gold(first, gold)     # gold-sized, persisted
    masks = E.vote_masks(preds, ranked, positive=F.col("pred") == 1, keep=("gold",))
    ens = M.with_scores(E.ensemble_confusion(masks, defs))
    single = M.with_scores(M.confusion_counts(preds, eval_ids)).withColumn("members", F.lit(1).cast("long"))
    return M.leaderboard(single.unionByName(ens), keep=("members",))


@query("ensemble_leaderboard", S.with_ctes(S.VOTES_CTE, S.GOLD_EVAL_CTE, ENSEMBLE_CTE, ENS_EVAL_CTE)
       + _BOARD_SELECT)
def ensemble_leaderboard(spark, sf_dir):
    """M6 over single annotators and every ensemble (all, top-3/5, combinations)."""
    return _ensemble_board(spark, sf_dir)


@query("ensemble_only_leaderboard", S.with_ctes(S.VOTES_CTE, S.GOLD_EVAL_CTE, ENSEMBLE_CTE, ENS_EVAL_CTE)
       + _BOARD_SELECT + " WHERE starts_with(model, 'ensemble::')")
def ensemble_only_leaderboard(spark, sf_dir):
    """the ensemble rows of the leaderboard only."""
    return _ensemble_board(spark, sf_dir).where(F.col("model").startswith("ensemble::"))


@query("ensemble_combos", S.with_ctes(S.VOTES_CTE, S.GOLD_EVAL_CTE, ENSEMBLE_CTE)
       + "SELECT model, mask, members FROM defs")
def ensemble_combos(spark, sf_dir):
    """Ensemble definitions from the F1 ranking (duplicate names kept once)."""
    defs = E.ensemble_definitions(ranked_models(spark, sf_dir))
    return (spark.range(1).select(F.explode(E.definitions_column(defs)).alias("e"))
            .select("e.model", "e.mask", "e.members"))


@query("ensemble_all_topk", S.with_ctes(S.VOTES_CTE, S.GOLD_EVAL_CTE, ENSEMBLE_CTE) + f"""
SELECT s.id,
  {_ens_pred("(SELECT mask FROM defs WHERE starts_with(model, 'ensemble::all'))")} AS ens_all,
  {_ens_pred("(SELECT mask FROM defs WHERE model = 'ensemble::top-3')")} AS ens_top3,
  {_ens_pred("(SELECT mask FROM defs WHERE model = 'ensemble::top-5')")} AS ens_top5
FROM sig s""")
def ensemble_all_topk(spark, sf_dir):
    """Ensemble labels for every item (all models, top-3, top-5 by F1)."""
    ranked = ranked_models(spark, sf_dir)
    defs = {n: m for n, m, _ in E.ensemble_definitions(ranked)}
    masks = E.vote_masks(fixture_first_votes(spark, sf_dir), ranked)
    pos, present = F.col("pos"), F.col("present")

    def vote(name):
        m = defs.get(name)
        return E.mask_vote(pos, present, m) if m is not None else F.lit(None).cast("int")

    return masks.select("id", vote(f"ensemble::all ({len(ranked)})").alias("ens_all"),
                        vote("ensemble::top-3").alias("ens_top3"), vote("ensemble::top-5").alias("ens_top5"))


@query("majority_vote", S.with_ctes(S.VOTES_CTE, """
counts AS (SELECT id, label, count(*) AS n FROM fv GROUP BY id, label),
ranked_labels AS (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC,
            CASE label WHEN '0' THEN 1 WHEN '1' THEN 2 ELSE 3 END, label) AS rn,
         max(n) OVER (PARTITION BY id) AS top_count, CAST(sum(n) OVER (PARTITION BY id) AS BIGINT) AS n_voters
  FROM counts)""") + "SELECT id, label AS majority, top_count, n_voters FROM ranked_labels WHERE rn = 1")
def majority_vote(spark, sf_dir):
    """Generic majority over every annotator's label string, tie to "0"."""
    return E.majority_vote(fixture_first_votes(spark, sf_dir, keep_label=True))
