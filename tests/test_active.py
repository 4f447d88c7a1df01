"""Active-learning rounds: seed, resume, partial save."""
from siftwise.operators import active as A
from siftwise.plans import QUERIES

from .conftest import SF_SMALL


def test_start_resumes_known_ids_only(spark):
    pool = spark.range(10)
    saved = spark.createDataFrame([(1, 0, 1, 1), (1, 1, 2, 1), (99, 1, 1, 1)], "id long, label int, round int, seq int")
    labels, seed = A.start(pool, pool, saved, 3)
    assert seed is None and [tuple(r) for r in labels.collect()] == [(1, 1, 2)]
    none, seed = A.start(pool, pool.where("id < 2"), None, 3)
    assert none is None and seed.count() == 3                  # too few candidates: the whole pool


def test_record_keeps_valid_answers_up_to_the_stop(spark):
    queue = spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "id long, rank long")
    answers = spark.createDataFrame([(1, 1), (2, 2), (3, 0)], "id long, label int")
    assert sorted(r["id"] for r in A.record(None, queue, answers, 1).collect()) == [1, 3]
    assert [r["id"] for r in A.record(None, queue, answers, 1, stop_after=2).collect()] == [1]


def test_rounds(spark):
    rows = QUERIES["al_round"](spark, SF_SMALL).collect()
    by = {(r["round"], r["status"]): sum(x["round"] == r["round"] and x["status"] == r["status"] for x in rows) for r in rows}
    assert by == {(1, "labelled"): 25, (2, "labelled"): 25, (3, "labelled"): 10, (3, "queued"): 15}
    assert -1 not in {r["id"] for r in rows} and len({r["id"] for r in rows}) == 75


def test_counts_of_three_rounds_equal_a_full_refit(spark):
    """Rounds add only what their labels change; a corrected label moves, a withdrawn one goes."""
    from siftwise.operators import naive_bayes as NB

    w = spark.createDataFrame([(i, f"t{(i * 7 + j) % 11}", 0.1 * (j + 1)) for i in range(30) for j in range(4)], "id long, term string, weight double")
    vocab = spark.createDataFrame([(f"t{j}",) for j in range(12)], "term string")
    rounds = [{1: 0, 2: 1, 3: 1}, {1: 0, 2: 0, 3: 1, 4: 1, 5: 0}, {1: 1, 2: 0, 4: 1, 5: 0, 6: 1, 99: 1}]
    changes, before = None, spark.createDataFrame([], "id long, label int")
    for labels in rounds:
        after = spark.createDataFrame(list(labels.items()), "id long, label int")
        step = NB.count_changes(w, before, after)
        changes, before = step if changes is None else changes.unionByName(step), after
        model, priors = NB.from_counts(changes, vocab, 0.5)
        want, want_priors = NB.fit_wide(w, after, vocab, 0.5)
        for got, full in ((model, want), (priors, want_priors)):
            a, b = (sorted(map(tuple, d.collect())) for d in (got, full))
            assert [x[0] for x in a] == [x[0] for x in b]
            assert all(abs(p - q) < 1e-9 for x, y in zip(a, b) for p, q in zip(x[1:], y[1:]))
