"""Streaming queries (T1, T2): run to completion, then read the sink back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import classify as C
from ..operators import versions as VS
from ..operators import votes as V
from ..operators.vote_table import VoteTable
from ..sources.tables import table
from ..streaming.feeds import classify_stream, verdict_stream, verdict_upserts
from . import sql as S
from .fixtures import rule_votes
from .q_ml import scratch_dir, trained_text_model
from .registry import query


@query("stream_classify")
def stream_classify(spark, sf_dir):
    """The documents as an NDJSON item feed, classified as a file stream (same routes
    as batch; the sink keeps id and text)."""
    base = scratch_dir(spark, "stream-classify")
    model = trained_text_model(spark, sf_dir)
    (table(spark, sf_dir, "documents", "doc_id", "text")
     .select(F.col("doc_id").cast("string").alias("id"), "text").write.json(f"{base}/feed"))
    classify_stream(spark, f"{base}/feed", model, f"{base}/out", f"{base}/ckpt")
    return spark.read.parquet(f"{base}/out").select(F.col("id").cast("long").alias("id"), "route")


@query("stream_votes", S.with_ctes(S.VOTES_CTE) + "SELECT id, model, label, vote FROM fv")
def stream_votes(spark, sf_dir):
    """Verdict files ingested as a stream into the votes table; the first-vote
    rule is applied on read (merge on read)."""
    base = scratch_dir(spark, "stream-votes")
    # the fields of the verdict format only: which vote is first follows from file and position
    (rule_votes(spark, sf_dir)
     .select(F.col("id").cast("string").alias("id"), "model", "label", F.lit("").alias("reasoning"), "text")
     .write.json(f"{base}/verdicts"))
    verdict_stream(spark, f"{base}/verdicts", f"{base}/votes", f"{base}/ckpt")
    votes = spark.read.parquet(f"{base}/votes").select(F.col("id").cast("long").alias("id"), "model", "label", "file_order")
    return V.first_votes(votes).select("id", "model", "label", "vote")


# ----------------------------------------------------------------- V4 K3 K8 L10 T1 with a given model
# relevant: words of fewer than eight characters on average, counting what stands between them
FIXED_WEIGHTS = [8.0, -1.0]
_ROUTED_CTE = f"""fixture AS (SELECT doc_id AS id, CASE WHEN doc_id % 20 = 7 THEN '?! ... -' WHEN doc_id % 50 = 9 THEN '' ELSE text END AS text FROM documents),
routed AS (SELECT id, CASE WHEN len({S.tokens('text')}) = 0 THEN 'quarantine'
             WHEN {FIXED_WEIGHTS[0]} * len({S.tokens('text')}) - length(text) > 0 THEN 'relevant' ELSE 'irrelevant' END AS route
           FROM fixture WHERE text IS NOT NULL AND text <> '')"""


def fixed_model():
    """(model, encoder, number of features) whose routes SQL can tell."""
    return C.LinearModel(FIXED_WEIGHTS), C.encoder_udf(encode=C.counting_encoder), len(FIXED_WEIGHTS)


def damaged_documents(spark, sf_dir):
    """Documents of which some have no token and some no text."""
    text = F.when(F.col("doc_id") % 20 == 7, "?! ... -").when(F.col("doc_id") % 50 == 9, "").otherwise(F.col("text"))
    return table(spark, sf_dir, "documents", "doc_id", "text").select(F.col("doc_id").alias("id"), text.alias("text"))


def routed_by_fixed_model(spark, sf_dir):
    model, encoder, dim = fixed_model()
    return C.classify(model, C.encode(damaged_documents(spark, sf_dir).where(X.has_text("text")), encoder=encoder), dim)


@query("bulk_routes", S.with_ctes(_ROUTED_CTE) + "SELECT id, route, 1::BIGINT AS n_rows FROM routed")
def bulk_routes(spark, sf_dir):
    """Every item in one batch-encoded pass, written once by route, read back: each
    item has one route, those whose encoding fails are in quarantine and nowhere else."""
    base = scratch_dir(spark, "fixed-routes")
    C.write_routes(routed_by_fixed_model(spark, sf_dir), base)
    return spark.read.parquet(base).groupBy("id", "route").agg(F.count("*").alias("n_rows"))


@query("route_totals", S.with_ctes(_ROUTED_CTE) + "SELECT route, count(*) AS n FROM routed GROUP BY route")
def route_totals(spark, sf_dir):
    """K8/V4: totals of the three routes."""
    return C.route_counts(routed_by_fixed_model(spark, sf_dir))


@query("stream_routes", S.with_ctes(_ROUTED_CTE) + "SELECT id, route FROM routed")
def stream_routes(spark, sf_dir):
    """The same items as an arriving feed, classified in micro-batches."""
    base = scratch_dir(spark, "fixed-stream")
    damaged_documents(spark, sf_dir).select(F.col("id").cast("string").alias("id"), "text").repartition(4, "id").write.json(f"{base}/feed")
    model, encoder, dim = fixed_model()
    classify_stream(spark, f"{base}/feed", model, f"{base}/out", f"{base}/ckpt", bytes_per_batch=1, encoder=encoder, dim=dim)
    return spark.read.parquet(f"{base}/out").select(F.col("id").cast("long").alias("id"), "route")


# The second run of the upsert feed: corrected votes, votes without a label, a late model.
_LATER = [("b/long", 10, 3, "1"), ("a/flip5", 7, 1, None), ("c/flip3", 17, 0, "0"), ("e/late", 4, 0, "1"), ("a/flip7", 13, 0, "1")]
THRESHOLD = 3
_LAST_CTE = S.VOTES_CTE + """,
feed AS (SELECT id, model, label, seq FROM votes""" + "".join(
    f" UNION ALL SELECT doc_id, '{m}', {'NULL' if lab is None else S.q(lab)}, 10 FROM documents WHERE doc_id % {k} = {r}" for m, k, r, lab in _LATER) + f"""),
last_votes AS (SELECT id, model, arg_max({S.canonical('label')}, seq) AS vote FROM feed WHERE {S.canonical('label')} IS NOT NULL GROUP BY id, model)"""


def upserted(spark, sf_dir):
    """The rule votes and a later run of corrections as verdict files, streamed into a votes table in
    small batches; one batch is taken in twice and another attempt fails before its commit."""
    base = scratch_dir(spark, "upserts")
    one = lambda df: df.select(F.col("id").cast("string").alias("id"), "model", "label", F.lit("").alias("reasoning"), F.lit("").alias("text"))
    one(rule_votes(spark, sf_dir, with_text=False).repartition(6, "id").sortWithinPartitions("id", "model", "seq")).write.json(f"{base}/feed/run1")
    docs = table(spark, sf_dir, "documents", "doc_id").withColumnRenamed("doc_id", "id")
    later = [docs.where(F.col("id") % k == r).withColumns({"model": F.lit(m), "label": F.lit(lab).cast("string")}) for m, k, r, lab in _LATER]
    one(reduce(lambda a, b: a.unionByName(b), later)).repartition(3, "id").write.json(f"{base}/feed/run2")
    votes = VoteTable(spark, f"{base}/votes", buckets=4, compact_every=3)
    verdict_upserts(spark, f"{base}/feed/*", votes, f"{base}/ckpt", files_per_batch=2)
    again = spark.createDataFrame([("0", "a/flip7", "0", "again", 0, 0)], "id string, model string, label string, path string, block long, row long")
    assert not votes.upsert(again, 1)                                  # batch 1 comes again: it is there
    VS.stage(again.select("id", "model", F.lit(1).alias("vote"), F.struct(F.lit(99).cast("long").alias("batch"), "path", "block", "row").alias("at"),
                          F.lit(0).alias("bucket")), f"{base}/votes", "batch-000000000099", ("bucket",))   # never committed
    return votes


@query("upsert_votes", S.with_ctes(_LAST_CTE) + "SELECT id, model, vote FROM last_votes")
def upsert_votes(spark, sf_dir):
    """The votes table after all batches: the last label of every (id, model)."""
    return upserted(spark, sf_dir).votes().select(F.col("id").cast("long").alias("id"), "model", "vote")


@query("upsert_tallies", S.with_ctes(_LAST_CTE) + f""",
items AS (SELECT id, sum(vote) AS v FROM last_votes GROUP BY id), n AS (SELECT count(DISTINCT model) AS n FROM last_votes),
t AS (SELECT count(*) AS n_items, sum((v >= {THRESHOLD})::INT) AS relevant, sum((v <= n - {THRESHOLD})::INT) AS irrelevant,
             sum((v > n - {THRESHOLD} AND v < {THRESHOLD})::INT) AS conflict, sum((v >= {THRESHOLD} AND v <= n - {THRESHOLD})::INT) AS overlap FROM items, n)
SELECT n_items, relevant::BIGINT AS relevant, irrelevant::BIGINT AS irrelevant, conflict::BIGINT AS conflict, overlap::BIGINT AS overlap,
       (relevant + irrelevant)::BIGINT AS high_confidence, {S.rfix('conflict * 100.0 / n_items', 4)} AS conflict_pct FROM t""")
def upsert_tallies(spark, sf_dir):
    """The consensus of the votes table from its running tallies."""
    return upserted(spark, sf_dir).consensus(THRESHOLD)
