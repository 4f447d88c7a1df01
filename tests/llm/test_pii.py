"""Personal data: base spans against plain regular expressions, EM, added spans, masking."""
import hashlib
import math
import re

from siftwise.llm import pii

from .helpers import awkward, awkward_rows

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(s):
    return sum(x if k % 2 == 0 else 2 * x - 9 * (x > 4) for k, x in enumerate(map(int, reversed(s)))) % 10 == 0


def base_spans(text):
    """The contract, read literally."""
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            ok = {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m.group().split(".")),
                  "card": lambda: 12 <= len(d) <= 19 and luhn(d), "phone": lambda: 9 <= len(d) <= 15}[kind]()
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def joined(spans):
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)


CARD = "4952935900253052"
assert luhn(CARD)
TRICKY = [
    "write to a.b@c.example.com, or x@y.z", "a@b.c_d@e.f g@h", "@x.y a@.b a@b. a@b..c q@w.e.r.t", "é@b.cd ü.a@b.cd.", "a@b@c.d",
    "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 000255.0.0.1 1.2.3 01.02.03.04x 9.9.9.9.", f"{CARD} {CARD[:4]} {CARD[4:8]} {CARD[8:12]} {CARD[12:]}",
    f"{CARD} 1", f"x{CARD}y -{CARD}- {CARD}\n{CARD}", "0000 0000 0000 0000 0000 0000", "000000000000 0000000000000000000 00000000000000000000",
    "1  2 3-4 5 --6", "+1 (017) 555-7713 +12345678 +123456789 +1234567890123456", "+1+22 333 4444 55) +4 (((((", "call +31 20 624 1111.",
    "🎉 1.1.1.1 日本 a@b.cd 🎉🎉 +49 30 901820 ende", "+" + "1" * 3000, "a" * 50000, "1." * 20000, "a@" + "b." * 20000 + "c", "1" * 40000,
    "(" * 3000 + "+1" + "(" * 50000, "a.b-" * 10000 + "@", "4 " * 20000, "1.2.3.4 " * 300, "", " ", None,
]


def test_base_spans_against_plain_patterns(spark):
    rows = [(i, t, None, None, None, None, None) for i, t in enumerate(TRICKY)] + awkward_rows()
    got = pii.detect(awkward(spark, rows)).collect()
    want = sorted(((r[0], base_spans(r[1])) for r in rows), key=repr)
    assert sorted(((r["doc_id"], [tuple(x) for x in r["base"]]) for r in got), key=repr) == want
    for r in got:
        spans = [tuple(x) for x in r["spans"]]
        assert spans == sorted(spans) and set(map(tuple, r["base"])) <= set(spans)


def test_query_counts_and_hash(spark, tmp_path):
    rows = [(i, t, None, None, None, None, None) for i, t in enumerate(TRICKY)]
    awkward(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in pii.op11_pii(spark, str(tmp_path)).collect()}
    for i, t in enumerate(TRICKY):
        base = base_spans(t)
        assert got[i]["base_sha256"] == hashlib.sha256(joined(base).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(b[1] == n for b in base) for n in range(4)]


def test_empty_table_and_no_candidates(spark):
    assert pii.detect(awkward(spark, [])).count() == 0
    got = pii.detect(awkward(spark, [(1, "nothing here", "", "", 0, 0, "")])).collect()
    assert [(r["doc_id"], r["base"], r["spans"]) for r in got] == [(1, [], [])]


def em_plain(patterns, rounds):
    """The same estimate, span by span, with probabilities instead of logarithms."""
    spans = [(base, v) for base, v, n in patterns for _ in range(n)]
    odds = [{1: t, 0: 1 / t, -1: 1.0} for t, _ in pii.TRUST]
    post = [1.0 if b else (o := math.prod(d[x] for d, x in zip(odds, v)) / 9) / (1 + o) for b, v in spans]
    for _ in range(rounds):
        share = (1 + sum(post)) / (2 + len(spans))
        like = []
        for k in range(len(spans[0][1])):
            right, n = pii.TRUST[k]
            a = n * right / (1 + right)
            t = {1: [a, n - a], 0: [n - a, a], -1: [1.0, 1.0]}
            for p, (_, v) in zip(post, spans):
                t[v[k]][0] += p
                t[v[k]][1] += 1 - p
            all_ = [sum(x[z] for x in t.values()) for z in (0, 1)]
            like.append({x: (y[0] / all_[0], y[1] / all_[1]) for x, y in t.items()})
        new = []
        for b, v in spans:
            yes, no = share, 1 - share
            for t, x in zip(like, v):
                yes, no = yes * t[x][0], no * t[x][1]
            new.append(1.0 if b else yes / (yes + no))
        post = new
    return {(b, v): p for p, (b, v) in zip(post, spans)}


def test_reliabilities_against_plain_em():
    patterns = [(True, (1, 1, 1, -1, 1), 40), (False, (1, 0, 1, -1, 1), 5), (False, (0, 0, 0, -1, 0), 60), (False, (1, 0, 0, 0, 1), 9),
                (False, (1, 1, -1, 1, 1), 3)]
    got = pii.reliabilities([(2, *p) for p in patterns], rounds=12)
    want = em_plain(patterns, 12)
    assert {k[1:]: round(p, 9) for k, p in got.items()} == {k: round(p, 9) for k, p in want.items()}
    assert got[(2, False, (0, 0, 0, -1, 0))] < 0.05 < 0.9 < got[(2, False, (1, 1, -1, 1, 1))]


def test_masked_and_bracketed_addresses_are_added_and_decoys_are_not(spark):
    rows = [(i, f"please write to anna.k{i}@mail{i % 9}.example.com or call +1 ({200 + i}) 555-{1000 + i} today", "en", "a", 0, 0, "") for i in range(60)]
    rows += [(100 + i, f"please write to anna.k{i} (at) mail{i % 9}.example.com today", "en", "a", 0, 0, "") for i in range(8)]
    rows += [(200 + i, f"number {7000000000000001 + 1000003 * i} in a row, token = \"4d44c79e8bf7c55{i}759c49\" version 1.2.300.4", "en", "a", 0, 0, "") for i in range(60)]
    got = {r["doc_id"]: r for r in pii.detect(awkward(spark, rows)).collect()}
    assert all(len(got[i]["spans"]) == 2 for i in range(60))
    assert all(len(got[100 + i]["spans"]) == 1 and not got[100 + i]["base"] for i in range(8))
    assert all(got[200 + i]["spans"] == got[200 + i]["base"] for i in range(60))
    text = {r["doc_id"]: r for r in pii.masked(awkward(spark, rows)).collect()}
    assert text[5]["text"] == "please write to [email] or call [phone] today" and text[5]["lang"] == "en"
    assert text[100]["text"] == "please write to [email] today"
