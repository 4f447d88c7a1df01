"""Near duplicates of texts and embeddings against all pairs."""
import random

import numpy as np
import pyarrow as pa

from siftwise.llm import components, embed_dup, near_dup
from siftwise.llm.textcodes import Codes, buffers

from .helpers import awkward, awkward_rows, shingles, smallest_reachable


def group_rows():
    """Exact copies, chains of small edits, pairs around the threshold, a shared passage."""
    rng = random.Random(5)
    vocabulary = [f"v{k}" for k in range(4000)]
    passage = rng.choices(vocabulary, k=80)
    rows, doc = [], 200
    for _ in range(25):
        base = rng.choices(vocabulary, k=rng.randint(60, 300))
        for edits in (0, 0, 1, 2, 3, 5, 8):
            w = list(base)
            for _ in range(edits):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append((doc, (" " if rng.random() < .5 else "\n").join(w), "en", "s", 1, 1, "r"))
            doc += 1
        rows.append((doc, " ".join(passage + rng.choices(vocabulary, k=40)), "en", "s", 1, 1, "r"))
        doc += 1
    return rows


def linked_sets(rows, pct):
    sets = {}
    for i, t, *_ in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is None, r[1])):
        sets.setdefault(i, shingles(t))

    def linked(a, b):
        both = len(sets[a] & sets[b])
        return bool(sets[a] and sets[b]) and 100 * both >= pct * (len(sets[a]) + len(sets[b]) - both)

    return sets, smallest_reachable(sets, linked)


def test_shingle_codes_are_the_sets():
    texts = [r[1] for r in awkward_rows(2000)]
    data, offsets = buffers(pa.array(texts))
    codes, first = Codes().shingles(data, offsets)
    assert np.diff(first).tolist() == [len(shingles(t)) for t in texts]
    of = lambda k: set(codes[first[k]:first[k + 1]].tolist())
    for a in range(len(texts)):
        for b in range(a):
            assert len(of(a) & of(b)) == len(shingles(texts[a]) & shingles(texts[b]))


def test_near_duplicates_all_pairs(spark):
    rows = awkward_rows() + group_rows()
    sets, want = linked_sets(rows, 85)
    got = near_dup.near_duplicates(awkward(spark, rows)).collect()
    named = [r for r in got if r["doc_id"] is not None]
    assert {r["doc_id"]: r["component_id"] for r in named} == want and len(named) == len(want)
    assert {r["doc_id"]: r["n_shingles"] for r in named} == {i: len(s) for i, s in sets.items()}
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in named)
    assert [(r["component_id"], r["kept"]) for r in got if r["doc_id"] is None] == [(None, True)]


def test_open_clusters_are_compared_in_blocks(spark, monkeypatch):
    """Texts around one base, many pairwise just below the threshold, a few linked late."""
    monkeypatch.setattr(near_dup, "BLOCK_CLASSES", 8)
    rng = random.Random(9)
    base = [f"b{k}" for k in range(150)]
    rows = []
    for doc in range(60):
        w = list(base)
        for at in rng.sample(range(150), 4):
            w[at] = f"e{rng.randrange(400)}"
        rows.append((1000 + doc, " ".join(w), "en", "s", 1, 1, "r"))
        if doc % 9 == 0:
            rows.append((2000 + doc, " ".join(w[:-1]), "en", "s", 1, 1, "r"))
    _, want = linked_sets(rows, 85)
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(awkward(spark, rows)).collect()}
    assert got == want and len(set(want.values())) > 10


def test_drop_near_duplicates_keeps_one_of_each(spark):
    rows = awkward_rows() + group_rows()[:60]
    _, want = linked_sets(rows, 80)
    left = near_dup.drop_near_duplicates(awkward(spark, rows), threshold_pct=80)
    assert left.columns == awkward(spark, []).columns
    ids = [r["doc_id"] for r in left.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(set(want.values())) and ids.count(None) == 1
    assert near_dup.near_duplicates(awkward(spark, [])).count() == 0


def test_drop_near_duplicates_judges_rows_of_repeated_ids_apart(spark):
    base = " ".join(f"word{k}" for k in range(40))
    other = " ".join(f"other{k}" for k in range(40))
    third = " ".join(f"third{k}" for k in range(40))
    rows = [(1, base, "en", "z", 1, 1, "r"), (2, base + " more", "en", "a", 1, 1, "r"), (2, other, "en", "a", 1, 1, "r"), (2, other, "en", "a", 1, 0, "q"),
            (3, third, "en", "a", 1, 1, "r"), (3, third + " x", "en", "a", 1, 1, "r"), (4, None, "en", "a", 1, 1, "r"), (4, other + " y", "en", "a", 1, 1, "r"),
            (5, "short", "en", "a", 1, 1, "r"), (5, "short", "en", "a", 1, 1, "r"), (None, base, "en", "a", 1, 1, "r")]
    for parts in (1, 4):
        left = near_dup.drop_near_duplicates(awkward(spark, rows).repartition(parts), threshold_pct=80)
        got = sorted((tuple(r) for r in left.collect()), key=repr)
        # of id 2 the unlinked text stays (the smaller of its equal rows), of id 4 the empty one: its other text is a copy
        assert got == sorted([rows[0], rows[3], rows[4], rows[6], rows[8], rows[10]], key=repr)


def test_plans_reach_their_miss_rate():
    for t in (0.8, 0.85, 0.9):
        bands, rows = near_dup.plan_bands(t)
        assert (1 - t ** rows) ** bands <= 1e-6
    bits, tables = embed_dup.plan_tables(10 ** 6, 0.95)
    assert (1 - (1 - np.arccos(0.95) / np.pi) ** bits) ** tables <= 1e-6


def test_odd_sketch_estimates_high_similarity():
    rng = np.random.default_rng(3)
    k = 252
    a = rng.integers(0, 2 ** 32, (200, k), dtype=np.uint32)
    b = a.copy()
    b[:, :k * 15 // 100] = rng.integers(0, 2 ** 32, (200, k * 15 // 100), dtype=np.uint32)      # similarity 0.85
    far = rng.integers(0, 2 ** 32, (200, k), dtype=np.uint32)
    ones = lambda x, y: np.unpackbits(near_dup.odd_sketches(x) ^ near_dup.odd_sketches(y), axis=1).sum(axis=1)
    assert ones(a, b).max() <= near_dup.most_ones(0.85, k) < ones(a, far).min()


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(100, 140)] + [(7, k) for k in range(8, 40)] + [(39, 7), (5, 7), (300, 300)]
    got = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 100 for k in range(100, 141)}, **{k: 5 for k in [5, *range(7, 40)]}}


def vectors():
    rng = np.random.default_rng(11)
    rows, k = [], 0
    for size in (1, 1, 2, 3, 40):
        centre = rng.standard_normal(16)
        for _ in range(size):
            rows.append((k, (centre + 0.06 * np.linalg.norm(centre) / 4 * rng.standard_normal(16)).astype(np.float32).tolist()))
            k += 1
    rows += [(k + j, rng.standard_normal(16).astype(np.float32).tolist()) for j in range(60)]
    k += 60
    rows += [(k, rows[3][1]), (k + 1, rows[3][1]), (k + 2, [-x for x in rows[3][1]]), (k + 3, [2 * x for x in rows[3][1]])]
    odd = [(k + 4, None), (k + 5, []), (k + 6, [0.0] * 16), (k + 7, [float("nan")] * 16), (k + 8, [float("inf")] + [1.0] * 15),
           (k + 9, [None] + [1.0] * 15), (k + 10, [1.0] * 3), (k + 11, [1.0] * 3), (None, rows[0][1])]
    return rows, odd


def test_embedding_links_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(embed_dup, "TILE", 16)               # several tiles in the largest component
    rows, odd = vectors()
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows + odd + rows[:1]], "vec_id long, embedding array<float>, label int, v string")
    got = {r["vec_id"]: r for r in embed_dup.embedding_duplicates(df).collect()}
    sound = {i: np.array(v, np.float64) for i, v in rows + odd[6:8]}
    cos = lambda a, b: len(sound[a]) == len(sound[b]) and sound[a] @ sound[b] / np.linalg.norm(sound[a]) / np.linalg.norm(sound[b])
    linked = lambda a, b: cos(a, b) >= 0.95
    want = smallest_reachable(sound, linked)
    for i in sound:
        assert got[i]["n_links"] == sum(linked(i, j) for j in sound if j != i)
        assert got[i]["component_id"] == want[i] and got[i]["kept"] == (want[i] == i)
    for i, _ in odd[:6]:
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert (got[None]["n_links"], got[None]["component_id"], got[None]["kept"]) == (0, None, True)
    assert embed_dup.embedding_duplicates(df.where("false")).count() == 0


def test_quantisation_bound_is_rigorous():
    rng = np.random.default_rng(1)
    u = embed_dup.unit(rng.standard_normal((300, 24)) ** 3)
    q, s, r = embed_dup.quantise(u)
    gap = np.abs(u @ u.T - (q.astype(float) @ q.T) * s[:, None] * s)
    assert (gap <= r[:, None] + (1 + r[:, None]) * r + 1e-12).all()


def test_components_of_chains_stars_and_loops(spark):
    from siftwise.llm.components import components

    rng = np.random.default_rng(8)
    chain = [(k, k + 1) for k in range(100, 400)]
    back = [(1000 - k, 999 - k) for k in range(200)]
    star = [(2500, 2000 + k) for k in range(400)] + [(2600, 3000 + k) for k in range(50)]
    some = [tuple(int(x) for x in rng.integers(5000, 5400, 2)) for _ in range(250)]
    links = chain + back + star + some + [(7, 7), (9, 8), (8, 9), (9, 8), (-5, 3)]
    ids = {i for x in links if x[0] != x[1] for i in x}
    pairs = {frozenset(x) for x in links if x[0] != x[1]}
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: find(i) for i in ids}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_components_send_no_pointers_through_the_driver(spark, monkeypatch):
    plans, saved = [], components.saved

    def noted(df):
        out = saved(df)
        plans.append(df._jdf.queryExecution().executedPlan().toString())       # as it was run
        return out

    monkeypatch.setattr(components, "saved", noted)
    links = [(k, k + 1) for k in range(100, 140)] + [(7, k) for k in range(8, 40)]
    components.components(spark.createDataFrame(links, "a long, b long"))
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)


def test_seats_of_texts_broadcast_only_ids(spark):
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(50)], "id long, text string")
    seats = spark.createDataFrame([(k % 7, k // 3, f"wide {k}") for k in range(30)] + [(99, 0, "no text")], "id long, lead long, sketch string")
    got = near_dup.texts_of(docs, seats)
    assert sorted((r["id"], r["lead"], r["sketch"], r["text"]) for r in got.collect()) == sorted(
        (k % 7, k // 3, f"wide {k}", f"text {k % 7}") for k in range(30))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=broadcast") == 1 and "LeftSemi" in plan.split("strategy=broadcast")[0].splitlines()[-1] and "strategy=merge" in plan


def test_driver_is_swept_between_steps(spark, monkeypatch):
    swept = []
    for module in (components, near_dup):
        monkeypatch.setattr(module, "swept", lambda s: swept.append(s))
    rows = group_rows()[:24]
    got = near_dup.near_duplicates(awkward(spark, rows)).count()
    assert got == len(rows) and len(swept) >= 4
