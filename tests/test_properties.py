"""Property checks of the metric and ensemble operators (hypothesis, few examples)."""
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftwise.operators import ensembles as E
from siftwise.operators import metrics as M

pairs = st.lists(st.tuples(st.integers(0, 1), st.sampled_from([-1, 0, 1])), min_size=2, max_size=40)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(pairs)
def test_metric_identities(spark, rows):
    data = [(i, "m", p, g) for i, (g, p) in enumerate(rows)]
    first = spark.createDataFrame([(i, m, p) for i, m, p, _ in data], "id long, model string, pred int")
    gold = spark.createDataFrame([(i, g) for i, _, _, g in data], "id long, gold int")
    r = M.confusion_by_model(first, gold).first()
    assert r["tn"] + r["fp"] + r["fn"] + r["tp"] <= r["n"] == len(rows)
    for c in ("accuracy", "precision_1", "recall_1", "f1_1"):
        assert 0.0 <= r[c] <= 1.0
    if r["kappa"] is not None:
        assert -1.0 <= r["kappa"] <= 1.0
    # a perfect annotator: kappa 1 unless gold is constant (then undefined)
    perfect = spark.createDataFrame([(i, "p", g) for i, _, _, g in data], "id long, model string, pred int")
    k = M.confusion_by_model(perfect, gold).first()["kappa"]
    golds = {g for *_, g in data}
    assert (k is None) if len(golds) == 1 else abs(k - 1.0) < 1e-9


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from([0, 1, None]), min_size=1, max_size=30))
def test_single_member_ensemble_equals_member(spark, votes):
    first = spark.createDataFrame([(i, "x/a", v) for i, v in enumerate(votes) if v is not None],
                                  "id long, model string, vote int")
    if first.count() == 0:
        return
    masks = E.vote_masks(first, ["x/a"])
    got = {r["id"]: r["v"] for r in masks.select("id", E.mask_vote(F.col("pos"), F.col("present"), 1).alias("v")).collect()}
    assert got == {i: v for i, v in enumerate(votes) if v is not None}


def test_train_and_gold_disjoint(spark):
    from siftwise.plans import QUERIES
    from .conftest import SF_MID
    train = {r["id"] for r in QUERIES["unanimous_train"](spark, SF_MID).collect()}
    gold = {r["doc_id"] for r in spark.read.parquet(f"{SF_MID}/labels.parquet").collect()}
    assert train and not (train & gold)


def test_fold_sizes_balanced(spark):
    from siftwise.plans import QUERIES
    from .conftest import SF_MID
    rows = QUERIES["stratified_folds"](spark, SF_MID).groupBy("label", "fold").count().collect()
    for label in {r["label"] for r in rows}:
        sizes = [r["count"] for r in rows if r["label"] == label]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1
