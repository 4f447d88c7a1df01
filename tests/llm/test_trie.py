"""The conversation trie against a dictionary of all prefixes, with whole and cut chunks."""
import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest

from siftwise.llm import trie

TURNS = "conv_id long, turn long, role string, text string, depth long, key string"


def plain_rebuilt(rows):
    convs = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            convs[c].append((t is not None, t or 0, r or "", x or ""))
    convs = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in convs.items()}
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = convs.get(c - int(math.fmod(c, 100)), [])[:h] + own[h:]         # as in SQL: -5 belongs to 0
    return out


def plain_nodes(convs):
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members[tuple(convs[c][:d])].append(c)
        ends[tuple(convs[c])].append(c)
    kids = defaultdict(int)
    leaves, saved = defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
            leaves[p[:d]] += p not in kids
    return sorted((m[0], len(p), members[p[:-1]][0] if p else -1, len(m), kids[p], leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()) for p, m in members.items())


def shown(df):
    return sorted((r["conv_id"], r["depth"], -1 if r["parent_conv_id"] is None else r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"],
                   r["saved_tokens"], r["ends_sha256"]) for r in df.collect())


def many(seed, n=400):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-150, 3000), n):
        for t in range(rng.choice([1, 2, 3, 5, 8])):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", rng.choice(["hi", "hello there", "日本🎉", "", "ok"]) if rng.random() < 0.8 else f"own {c} {t}"))
    rows += [(c, t, "user", "the same") for c in range(5000, 5120) for t in range(3)]        # a hot conversation
    rows += [(7000, t, "user", f"t{t}") for t in range(300)] + [(7001, t, "user", f"t{t}") for t in range(300)]
    rng.shuffle(rows)
    return rows


AWKWARD = [(1, None, "user", "first"), (1, 0, None, "a"), (1, 1, "user", None), (1, 1, "user", "tie"), (2, 5, "user", "only"), (2, 5, "user", "only"),
           (None, 0, "user", "nobody's"), (100, 0, "user", "a"), (123, 0, "user", "b"), (123, 1, "x", "c"), (199, 0, "user", "x" * 100000),
           (-5, 0, "user", "neg"), (0, 0, "user", "zero"), (900000000000001, 0, "user", "big")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, "k") for r in rows], TURNS)


@pytest.mark.parametrize("cells", [1 << 20, 64, 1])
def test_against_plain(spark, cells):
    rows = many(3)
    got = trie.trie(trie.rebuilt(trie.conversations(frame(spark, rows).repartition(5))), cells)
    assert shown(got) == plain_nodes(plain_rebuilt(rows))


def test_many_range_shards(spark):
    rows = many(4)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        got = trie.trie(trie.rebuilt(trie.conversations(frame(spark, rows))), 200)
        assert shown(got) == plain_nodes(plain_rebuilt(rows))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_nulls_ties_and_empty_table(spark):
    # tied turns: any order is right as long as it is one order for equal turns
    rows = [r for r in AWKWARD if r[1] != 1 or r[0] != 1]
    assert shown(trie.trie(trie.rebuilt(trie.conversations(frame(spark, rows))))) == plain_nodes(plain_rebuilt(rows))
    tied = trie.trie(trie.rebuilt(trie.conversations(frame(spark, AWKWARD)))).collect()
    assert max(r["n_convs"] for r in tied) == len({r[0] for r in AWKWARD} - {None})
    assert trie.trie(trie.rebuilt(trie.conversations(frame(spark, [])))).collect() == []


def test_pieces_of_a_long_list(spark):
    rows = [(c, 0, "user", "same") for c in range(1, 6001)]
    convs = trie.conversations(frame(spark, rows))
    got = shown(trie.trie(convs, 500))
    assert got == plain_nodes({c: [("user", "same")] for c in range(1, 6001)})
