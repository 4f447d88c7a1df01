"""Queries over annotator votes: matrix, consensus, conflicts, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CONSENSUS_THRESHOLD, FIXTURE_MODELS, NEWSPAPER_CONSENSUS_BOUNDS
from ..operators import metrics as M
from ..operators import votes as V
from ..sources.tables import table
from . import sql as S
from .fixtures import rule_votes
from .cache import memo, persisted
from .registry import query


def fixture_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text-free votes table, built once per application and persisted."""
    return memo(spark, ("votes", sf_dir), lambda: persisted(rule_votes(spark, sf_dir, with_text=False)))


def fixture_first_votes(spark: SparkSession, sf_dir: str, keep_label: bool = False) -> DataFrame:
    """First votes of the rule annotators; integer-only unless labels are needed."""
    def build():
        first = V.first_votes(fixture_votes(spark, sf_dir), keep_label=keep_label)
        return persisted(first.withColumn("pred", V.numeric_label("label")) if keep_label else first)
    return memo(spark, ("first_votes", sf_dir, keep_label), build)


def fixture_gold_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First votes of the rule annotators on gold ids: the gold semi-join comes first."""
    votes = M.gold_votes(fixture_votes(spark, sf_dir), gold_quality(spark, sf_dir))
    return V.first_votes(votes, keep_label=False, keep_null=True)


def gold_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels", "doc_id", "quality").select(
        F.col("doc_id").alias("id"), F.col("quality").alias("gold"))


# --------------------------------------------------------------------------- A1 / D8
@query("vote_matrix", S.with_ctes(S.VOTES_CTE) + "SELECT id, " + ", ".join(
    f"max(CASE WHEN model = {S.q(m)} THEN label END) AS \"{m}\"" for m in FIXTURE_MODELS)
    + " FROM first_votes GROUP BY id")
def vote_matrix(spark, sf_dir):
    return V.vote_matrix(fixture_first_votes(spark, sf_dir, keep_label=True), FIXTURE_MODELS)


# --------------------------------------------------------------------------- A2 / J2 / A12
@query("longest_text", S.with_ctes(S.VOTES_CTE) + """
SELECT t.id, t.text_len, t.text, coalesce(c.n_models, 0) AS n_models, coalesce(c.n_pos, 0) AS n_pos
FROM (SELECT id, max(length(text)) AS text_len,
             max({'l': length(text), 't': text}).t AS text FROM votes GROUP BY id) t
LEFT JOIN (SELECT id, count(*) AS n_models, count(*) FILTER (WHERE vote = 1) AS n_pos
           FROM fv GROUP BY id) c ON t.id = c.id""")
def longest_text(spark, sf_dir):
    votes = rule_votes(spark, sf_dir)
    counts = V.item_vote_counts(V.first_votes(votes, keep_label=False)).withColumnRenamed("n_votes", "n_models")
    return (V.longest_text(votes).join(counts, "id", "left")
            .select("id", "text_len", "text", F.coalesce("n_models", F.lit(0)).alias("n_models"),
                    F.coalesce("n_pos", F.lit(0)).alias("n_pos")))


# --------------------------------------------------------------------------- A3-A5
_RANK_SQL = ", ".join(f"({k})" for k in S.FIXTURE_RANKS)


@query("vote_consensus", S.with_ctes(S.VOTES_CTE, f"""
ks AS (SELECT * FROM (VALUES {_RANK_SQL}) t(k)),
nm AS (SELECT k, count(DISTINCT model) AS n_models FROM ks JOIN votes ON votes.model_rank <= ks.k GROUP BY k),
per_item AS (
  SELECT k, id, count(*) FILTER (WHERE model_rank <= k AND vote = 1) AS n_pos
  FROM ks JOIN ballots ON ballots.model_rank <= ks.k GROUP BY k, id
)""") + f"""
SELECT p.k, nm.n_models, {CONSENSUS_THRESHOLD} AS threshold, count(*) AS n_items,
  count(*) FILTER (WHERE n_pos >= {CONSENSUS_THRESHOLD}) AS relevant,
  count(*) FILTER (WHERE n_pos <= nm.n_models - {CONSENSUS_THRESHOLD}) AS irrelevant,
  count(*) FILTER (WHERE n_pos > nm.n_models - {CONSENSUS_THRESHOLD} AND n_pos < {CONSENSUS_THRESHOLD}) AS conflict,
  count(*) FILTER (WHERE n_pos >= {CONSENSUS_THRESHOLD} AND n_pos <= nm.n_models - {CONSENSUS_THRESHOLD}) AS overlap,
  count(*) FILTER (WHERE n_pos >= {CONSENSUS_THRESHOLD})
    + count(*) FILTER (WHERE n_pos <= nm.n_models - {CONSENSUS_THRESHOLD}) AS high_confidence,
  {S.rfix(f"count(*) FILTER (WHERE n_pos > nm.n_models - {CONSENSUS_THRESHOLD} AND n_pos < {CONSENSUS_THRESHOLD}) * 100.0 / count(*)", 4)} AS conflict_pct
FROM per_item p JOIN nm ON p.k = nm.k GROUP BY p.k, nm.n_models""")
def vote_consensus(spark, sf_dir):
    """Consensus tallies for the first 3, 4, 5 and 6 annotators (threshold 3).

    Items lacking any vote row from the first k annotators are not items of
    that prefix (an item-less model run would not have produced them).
    """
    votes = fixture_votes(spark, sf_dir)
    first = V.first_votes(votes, keep_label=False, keep_null=True)
    ranks = S.FIXTURE_RANKS
    per_item = V.item_vote_counts(first, ranks)
    stacked = per_item.select("id", F.explode(F.array(*[
        F.struct(F.lit(k).alias("k"), F.col(f"pos_{k}").alias("n_pos"), F.col(f"has_{k}").alias("present"))
        for k in ranks])).alias("s")).where("s.present").select("id", "s.k", "s.n_pos")
    # distinct annotators per prefix: one scalar subquery (an array, one entry per prefix)
    counts = votes.select(F.array(*[F.count_distinct(F.when(F.col("model_rank") <= k, F.col("model")))
                                    for k in ranks]).alias("n")).scalar()
    n_models = F.lit(None).cast("long")
    for i, k in enumerate(ranks):
        n_models = F.when(F.col("k") == k, F.element_at(counts, i + 1)).otherwise(n_models)
    stacked = stacked.withColumn("n_models", n_models)
    return V.consensus(stacked, F.col("n_models"), CONSENSUS_THRESHOLD, group_cols=["k", "n_models"]) \
        .select("k", "n_models", F.lit(CONSENSUS_THRESHOLD).alias("threshold"), "n_items", "relevant",
                "irrelevant", "conflict", "overlap", "high_confidence", "conflict_pct")


# --------------------------------------------------------------------------- F13 / R2
@query("vote_conflicts", S.with_ctes(S.VOTES_CTE, """
per_item AS (SELECT id, count(*) FILTER (WHERE model_rank <= 3 AND vote = 1) AS n_pos
             FROM fv WHERE model_rank <= 3 GROUP BY id)""") + f"""
SELECT p.id, p.n_pos, t.text, l.labels
FROM per_item p JOIN (SELECT id, max({{'l': length(text), 't': text}}).t AS text FROM votes GROUP BY id) t
  ON p.id = t.id
JOIN (SELECT id, string_agg(model || '=' || coalesce(label, ''), ';' ORDER BY model) AS labels FROM first_votes GROUP BY id) l
  ON p.id = l.id
WHERE p.n_pos > 3 - {CONSENSUS_THRESHOLD} AND p.n_pos < {CONSENSUS_THRESHOLD}""")
def vote_conflicts(spark, sf_dir):
    """conflict items among the first three annotators with their whole text and every
    annotator's label (``model=label``, in model order)."""
    votes = rule_votes(spark, sf_dir)
    first = V.first_votes(fixture_votes(spark, sf_dir))
    per_item = V.item_vote_counts(first.where(F.col("model_rank") <= 3))
    conflicts = V.conflict_items(per_item, 3, CONSENSUS_THRESHOLD)
    # only conflict items need a text: semi-join first, so no other text is aggregated
    texts = V.longest_text(votes.join(conflicts.select("id"), "id", "left_semi"))
    # one short string per annotator of an item: bounded by the number of annotators
    labels = (first.join(conflicts.select("id"), "id", "left_semi")
              .groupBy("id").agg(F.array_sort(F.collect_list(F.concat("model", F.lit("="), F.coalesce("label", F.lit("")))))
                                 .alias("l")))
    return (conflicts.join(texts, "id").join(labels, "id")
            .select("id", "n_pos", "text", F.array_join("l", ";").alias("labels")))


@query("conflict_preview", S.with_ctes(S.VOTES_CTE, """
per_item AS (SELECT id, count(*) FILTER (WHERE model_rank <= 3 AND vote = 1) AS n_pos
             FROM fv WHERE model_rank <= 3 GROUP BY id)""") + f"""
SELECT id, n_pos FROM per_item
WHERE n_pos > 3 - {CONSENSUS_THRESHOLD} AND n_pos < {CONSENSUS_THRESHOLD} ORDER BY id LIMIT 5""")
def conflict_preview(spark, sf_dir):
    """R2: the first five conflict items."""
    first = fixture_first_votes(spark, sf_dir).where(F.col("model_rank") <= 3)
    return V.conflict_items(V.item_vote_counts(first), 3, CONSENSUS_THRESHOLD).select("id", "n_pos").orderBy("id").limit(5)


# --------------------------------------------------------------------------- A6
_LO, _HI = NEWSPAPER_CONSENSUS_BOUNDS


@query("consensus_fixed_bounds", S.with_ctes(S.VOTES_CTE, """
per_item AS (SELECT id, count(*) FILTER (WHERE model_rank <= 5 AND vote = 1) AS n_pos
             FROM ballots WHERE model_rank <= 5 GROUP BY id)""") + f"""
SELECT count(*) AS n_items,
  count(*) FILTER (WHERE n_pos > {_HI}) AS relevant,
  count(*) FILTER (WHERE n_pos < {_LO}) AS irrelevant,
  count(*) FILTER (WHERE n_pos >= {_LO} AND n_pos <= {_HI}) AS conflict
FROM per_item""")
def consensus_fixed_bounds(spark, sf_dir):
    first = V.first_votes(fixture_votes(spark, sf_dir), keep_label=False, keep_null=True).where(F.col("model_rank") <= 5)
    return V.consensus_bounds(V.item_vote_counts(first), _LO, _HI)


# --------------------------------------------------------------------------- M1-M3, M5
@query("confusion_by_model", S.with_ctes(S.VOTES_CTE, S.GOLD_EVAL_CTE) + f"""
SELECT model, tn, fp, fn, tp, n, {S.r6('accuracy')} AS accuracy, {S.r6('precision_1')} AS precision_1,
  {S.r6('recall_1')} AS recall_1, {S.r6('f1_1')} AS f1_1, {S.r6('kappa')} AS kappa
FROM scored""")
def confusion_by_model(spark, sf_dir):
    return M.confusion_by_model(fixture_gold_votes(spark, sf_dir), gold_quality(spark, sf_dir))


def fixture_scored(spark, sf_dir):
    preds, eval_ids = M.predictions_vs_gold(fixture_gold_votes(spark, sf_dir), gold_quality(spark, sf_dir))
    return M.with_scores(M.confusion_counts(preds, eval_ids))


# --------------------------------------------------------------------------- M6 / M7 / R3
@query("leaderboard", S.with_ctes(S.VOTES_CTE, S.GOLD_EVAL_CTE) + f"""
SELECT model, {S.rhe('accuracy')} AS accuracy, {S.rhe('precision_1')} AS precision_1,
  {S.rhe('recall_1')} AS recall_1, {S.rhe('f1_1')} AS f1_1, {S.rhe('kappa')} AS kappa, tn, fp, fn, tp
FROM scored ORDER BY f1_1 DESC, model""")
def leaderboard(spark, sf_dir):
    return M.leaderboard(fixture_scored(spark, sf_dir))


# --------------------------------------------------------------------------- M4
def _class_rows_sql() -> str:
    p0, r0 = S.safe_div("tn", "tn + fn"), S.safe_div("tn", "t0")
    p1, r1 = S.safe_div("tp", "tp + fp"), S.safe_div("tp", "t1")
    f0, f1_ = S.f1(p0, r0), S.f1(p1, r1)
    mp, mr = S.safe_div("tn + tp", "tn + fn + tp + fp"), S.safe_div("tn + tp", "t0 + t1")
    rows = [
        ("'0'", p0, r0, f0, "t0"),
        ("'1'", p1, r1, f1_, "t1"),
        ("'macro avg'", f"({p0} + {p1}) / 2", f"({r0} + {r1}) / 2", f"({f0} + {f1_}) / 2", "t0 + t1"),
        ("'weighted avg'", S.safe_div(f"{p0} * t0 + {p1} * t1", "t0 + t1"),
         S.safe_div(f"{r0} * t0 + {r1} * t1", "t0 + t1"), S.safe_div(f"{f0} * t0 + {f1_} * t1", "t0 + t1"),
         "t0 + t1"),
        ("'micro avg'", mp, mr, S.f1(mp, mr), "t0 + t1"),
    ]
    return "\nUNION ALL\n".join(
        f"SELECT model, {c} AS class, {S.r6(p)} AS precision, {S.r6(r)} AS recall, {S.r6(f)} AS f1, "
        f"CAST({s} AS BIGINT) AS support FROM cmt" for c, p, r, f, s in rows)


@query("class_report", S.with_ctes(S.VOTES_CTE, S.GOLD_EVAL_CTE) + _class_rows_sql())
def class_report(spark, sf_dir):
    preds, eval_ids = M.predictions_vs_gold(fixture_gold_votes(spark, sf_dir), gold_quality(spark, sf_dir))
    return M.class_report(M.confusion_counts(preds, eval_ids))


# --------------------------------------------------------------------------- R6
@query("model_ranking", S.with_ctes(S.VOTES_CTE, S.GOLD_EVAL_CTE) + f"""
SELECT model, {S.rhe('f1_1')} AS f1_1,
  row_number() OVER (ORDER BY {S.rhe('f1_1')} DESC, model) AS rank
FROM scored""")
def model_ranking(spark, sf_dir):
    return M.rank_models(M.leaderboard(fixture_scored(spark, sf_dir)))


# --------------------------------------------------------------------------- K1 K2 S4 -> M6
# every 29th item has rows without any label: no votes, but still evaluated
_UNLABELLED = S.VOTES_CTE.replace("FROM votes WHERE label IS NOT NULL GROUP BY", "FROM votes WHERE label IS NOT NULL AND id % 29 <> 0 GROUP BY")


@query("verdict_file_leaderboard", S.with_ctes(_UNLABELLED, S.GOLD_EVAL_CTE) + f"""
SELECT model, {S.rhe('accuracy')} AS accuracy, {S.rhe('precision_1')} AS precision_1,
  {S.rhe('recall_1')} AS recall_1, {S.rhe('f1_1')} AS f1_1, {S.rhe('kappa')} AS kappa, tn, fp, fn, tp
FROM scored""")
def verdict_file_leaderboard(spark, sf_dir):
    """The evaluation run from verdict files with the five fields of the format only: the
    annotators' votes are one committed run of NDJSON files (folders by model slug), the
    repeated votes a later one.  The first attempt at the later run fails before its commit
    and the first run is written again: neither shows.  Read back with the fixed schema,
    first votes by commit, file and position, evaluated against gold."""
    from ..operators import versions as VS
    from ..operators.sinks import read_verdict_runs, write_verdicts
    from .q_ml import scratch_dir
    base = scratch_dir(spark, "verdicts")
    votes = rule_votes(spark, sf_dir).select(
        F.col("id").cast("string").alias("id"), "model",
        F.when(F.col("id") % 29 != 0, F.col("label")).alias("label"), F.lit("").alias("reasoning"), "text", "seq")
    first, later = (votes.where(F.col("seq") == k).drop("seq") for k in (1, 2))
    write_verdicts(first, base, run="run1")
    VS.stage(later.withColumn("label", F.lit("0")), base, "run2", fmt="json")
    write_verdicts(later, base, run="run2")
    write_verdicts(first.where(F.lit(False)), base, run="run1")
    raw = read_verdict_runs(spark, base)
    gold = gold_quality(spark, sf_dir)
    votes = M.gold_votes(raw.select(F.col("id").cast("long").alias("id"), "model", "label", "file_order"), gold)
    preds, eval_ids = M.predictions_vs_gold(V.first_votes(votes, keep_label=False, keep_null=True), gold)
    return M.leaderboard(M.with_scores(M.confusion_counts(preds, eval_ids)))
