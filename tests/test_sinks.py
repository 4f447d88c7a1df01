"""Sinks: write, read back, compare (temporary folders)."""
import tempfile
from datetime import datetime

from pyspark.ml.classification import LogisticRegression
from pyspark.ml import PipelineModel, Pipeline
from pyspark.ml.linalg import Vectors

from siftwise.operators import sinks as K
from siftwise.operators.labels import read_label_map_files
from siftwise.sources.tables import read_verdicts_json


def test_verdict_sink_roundtrip(spark):
    out = tempfile.mkdtemp(prefix="sw-verdicts-")
    v = spark.createDataFrame([("a", "org/m:1", "1", "r", "full text", "nl"), ("b", "org/m:1", "0", "r", "t2", "nl")],
                              "id string, model string, label string, reasoning string, text string, lang string")
    K.write_verdicts(v, out, datetime(2026, 1, 2, 3, 4))
    back = K.read_verdict_runs(spark, out)
    assert back.count() == 2
    assert {r["model_slug"] for r in back.collect()} == {"org-m-1"}
    assert {r["run_ts"] for r in back.collect()} == {"20260102-0304"}
    scanned = read_verdicts_json(spark, f"{out}/data/run=org-m-1-20260102-0304/lang=nl/model_slug=org-m-1/*.json")
    assert {r["text"] for r in scanned.collect()} == {"full text", "t2"}


def test_leaderboard_csv(spark):
    out = tempfile.mkdtemp(prefix="sw-board-")
    b = spark.createDataFrame([("m", 0.5, 0.5, 0.5, 0.5, 0.1, 1, 1, 1, 1)],
                              "model string, accuracy double, precision_1 double, recall_1 double, f1_1 double, "
                              "kappa double, tn long, fp long, fn long, tp long")
    K.write_leaderboard_csv(b, f"{out}/board")
    back = spark.read.option("header", True).csv(f"{out}/board")
    assert "F1-Score (1)" in back.columns and "Cohen's Kappa" in back.columns


def test_feature_cache_and_model_tables(spark):
    base = tempfile.mkdtemp(prefix="sw-cache-")
    calls = []

    def build():
        calls.append(1)
        return spark.range(5)

    assert K.cached_features(spark, base, {"min_df": 5}, build).count() == 5
    assert K.cached_features(spark, base, {"min_df": 5}, build).count() == 5
    assert len(calls) == 1
    K.save_tables({"vocab": spark.range(3)}, f"{base}/model")
    assert K.load_tables(spark, f"{base}/model", ["vocab"])["vocab"].count() == 3


def test_pipeline_model_persistence(spark):
    d = spark.createDataFrame([(Vectors.dense([0.0, 1.0]), 0.0), (Vectors.dense([1.0, 0.0]), 1.0)] * 5,
                              ["features", "label"])
    m = Pipeline(stages=[LogisticRegression(maxIter=5)]).fit(d)
    path = tempfile.mkdtemp(prefix="sw-model-") + "/m"
    m.write().overwrite().save(path)
    assert PipelineModel.load(path).transform(d).count() == 10


def test_label_map_files(spark):
    d = tempfile.mkdtemp(prefix="sw-maps-")
    with open(f"{d}/a.json", "w") as f:
        f.write('{"x1": 1, "x2": 0}')
    with open(f"{d}/b.json", "w") as f:
        f.write('{"x3": 1}')
    got = {(r["id"], r["label"]) for r in read_label_map_files(spark, d).collect()}
    assert got == {("x1", 1), ("x2", 0), ("x3", 1)}


def test_source_selector():
    assert K.source_path("local", "h", "l") == "l"
    try:
        K.source_path("ftp", "h", "l")
        raise AssertionError
    except ValueError:
        pass


def test_encoder_factory_and_failure_isolation(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from siftwise.operators.classify import encode, encoder_udf, hashing_encoder

    def factory():
        return lambda texts: hashing_encoder(texts, dim=8)

    df = spark.createDataFrame([("ab cd ef",), ("!!!",), ("gh ij",)], "text string")
    out = encode(df, encoder=encoder_udf(factory=factory, name="dim8")).orderBy("text").collect()
    by_text = {r["text"]: r for r in out}
    assert by_text["!!!"]["embedding"] is None and "no tokens" in by_text["!!!"]["error"]
    assert len(by_text["ab cd ef"]["embedding"]) == 8 and by_text["ab cd ef"]["error"] is None
    assert abs(np.linalg.norm(by_text["gh ij"]["embedding"]) - 1.0) < 1e-5


def test_readme_evaluation_flow(spark):
    """The README usage snippet, run on verdict files written from the fixture votes."""
    from pyspark.sql import functions as F

    from siftwise.operators import metrics as M
    from siftwise.operators import votes as V
    from siftwise.operators.sinks import read_verdict_runs, write_verdicts
    from siftwise.plans.fixtures import rule_votes

    from .conftest import SF_SMALL
    base = tempfile.mkdtemp(prefix="sw-flow-")
    votes = rule_votes(spark, SF_SMALL).select(F.col("id").cast("string").alias("id"), "model", "label",
                                               F.lit("").alias("reasoning"), "text", "seq")
    write_verdicts(votes, f"{base}/runs")
    verdicts = read_verdict_runs(spark, f"{base}/runs", extra="seq int")
    first = V.first_votes(verdicts, keep_label=False)
    n_models = verdicts.select(F.count_distinct("model")).first()[0]
    tallies = V.consensus(V.item_vote_counts(first), n_models, threshold=3).first()
    assert n_models == 6 and tallies["n_items"] == 200
    gold = spark.read.parquet(f"{SF_SMALL}/labels.parquet").select(
        F.col("doc_id").cast("string").alias("id"), F.col("quality").alias("gold"))
    preds, eval_ids = M.predictions_vs_gold(first, gold)
    board = M.leaderboard(M.with_scores(M.confusion_counts(preds, eval_ids)))
    K.write_leaderboard_csv(board, f"{base}/board")
    assert spark.read.option("header", True).csv(f"{base}/board").count() == 6
