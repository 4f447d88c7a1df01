"""Importance resampling against plain counts and the ranks of a plain sort."""
import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np

from siftwise.llm import resample

from .helpers import LOWER, SCHEMA, awkward, awkward_rows

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_features(text):
    w = WORD.findall((text or "").translate(LOWER))
    return len(w), [zlib.crc32(" ".join(w[i:i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def plain(rows, target, percent=5, min_words=20):
    """(id, n_features, weight, score, rank) of every row, by the contract's words."""
    got = [(i, *plain_features(t)) for i, t in rows]
    s, t = Counter(b for _, _, f in got for b in f), Counter(b for x in target for b in plain_features(x)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + 10000) / ((s[b] + 1) * (t_all + 10000)))) for b in range(10000)]
    out = []
    for i, n, f in got:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] for b in f)
        out.append([i, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    able = sorted((r for r in out if r[4] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    rank = {id(r): k + 1 for k, r in enumerate(able[:percent * len(able) // 100])}
    return sorted([(*r[:4], rank.get(id(r))) for r in out], key=repr)


TARGET = ["the house by the sea is not far", "die katze und der hund", None, ""]


def test_awkward_rows_against_plain(spark):
    extra = [(1000 + k, f"{'the house by the sea ' * (k % 5)} w{k} x{k * 7} " + "a b-c_d é1 Ünd 日本 " * (k % 7), None, None, None, None, None)
             for k in range(150)]
    extra += [(5000, "x" * 70000, None, None, None, None, None), (5001, "é" * 3000 + " " + "y" * 999, None, None, None, None, None)]
    rows = awkward_rows() + extra
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    for percent in (5, 40):
        got = resample.resample(awkward(spark, rows).repartition(7), target, percent=percent).drop("n_words").collect()
        assert sorted(map(tuple, got), key=repr) == plain([r[:2] for r in rows], TARGET, percent)


def test_texts_never_touch(spark):
    rows = [(k, "abc" if k % 2 else "def ", None, None, None, None, None) for k in range(40)]
    got = resample.resample(awkward(spark, rows).coalesce(1), spark.createDataFrame([("abc",)], "text string")).collect()
    assert {r["n_features"] for r in got} == {1}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "text string")
    assert resample.resample(awkward(spark, []), none).count() == 0
    got = resample.resample(awkward(spark), none).drop("n_words").collect()
    assert sorted(map(tuple, got), key=repr) == plain([r[:2] for r in awkward_rows()], [])


def test_drawn_documents_keep_all_columns(spark):
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    docs = awkward(spark)
    ranks = resample.resample(docs, target, percent=50).where("rank is not null").collect()
    drawn = resample.drawn_documents(docs, target, percent=50)
    assert drawn.columns == docs.columns and {r["doc_id"] for r in drawn.collect()} == {r["doc_id"] for r in ranks}
    assert SCHEMA.startswith("doc_id")


def test_crc_of_runs():
    rng = np.random.default_rng(5)
    data = rng.integers(0, 256, 5000).astype(np.uint8)
    starts = rng.integers(0, 4000, 600)
    lens = rng.integers(1, 40, 600)
    lens[:3] = [1000, 1, 500]
    got = resample.crc_of_runs(data, starts, lens, resample.crc_table())
    assert got.tolist() == [zlib.crc32(data[a:a + n].tobytes()) for a, n in zip(starts, lens)]
