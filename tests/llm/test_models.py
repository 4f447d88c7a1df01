"""Language identification, token counts, language-model scores, packing and the pipeline."""
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siftwise.llm import LLM_ORACLE, LLM_QUERIES, language, lm, mixing, packing, quality, token_counts
from siftwise.llm.tokens import byte_encoder, public_path

from ..conftest import SF_SMALL
from .helpers import LOWER, OTHER, PROSE, awkward, awkward_rows, words


@pytest.fixture(scope="module")
def model(spark):
    return language.fit(awkward(spark))


def test_language_labels_and_spans(spark, model):
    got = {r["doc_id"]: r for r in language.identify(awkward(spark), model).collect()}
    assert model.langs == ["de", "en"]
    assert all(got[i]["lang_pred"] == "en" for i in (1, 2, 3, 16)) and all(got[i]["lang_pred"] == "de" for i in (7, 8))
    assert all((got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0) for i in (4, 5, 6, 13))
    assert got[12]["score"] == 0.0 and got[12]["lang_pred"] in model.langs       # a script that no language writes
    mixed = got[14]["spans"]
    assert [s["lang"] for s in mixed] == ["de", "en"]
    assert abs(mixed[1]["start"] - len(OTHER) - 1) <= 12 and mixed[1]["end"] == len(OTHER) + 1 + len(PROSE)
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_language_empty_tables(spark, model):
    assert language.identify(awkward(spark, []), model).count() == 0
    nothing = language.fit(awkward(spark, []))
    assert {r["lang_pred"] for r in language.identify(awkward(spark), nothing).collect()} == {"und"}
    kept = language.keep_identified(awkward(spark), model)
    assert kept.columns == awkward(spark).columns and {1, 7, 14} <= {r["doc_id"] for r in kept.collect()}


def test_viterbi_is_the_best_path():
    import itertools
    rng = np.random.default_rng(0)
    for _ in range(20):
        s = rng.normal(0, 4, (6, 3))
        value = lambda p: s[np.arange(6), list(p)].sum() - 5 * sum(a != b for a, b in zip(p, p[1:]))
        assert value(language.viterbi(s, 5.0)) == pytest.approx(max(map(value, itertools.product(range(3), repeat=6))))


def test_shortcut_agrees_with_viterbi(spark, model):
    from siftwise.llm.textcodes import buffers
    import pyarrow as pa
    words_ = (PROSE + " " + OTHER).split()
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(words_[:70] if k % 2 else words_, size=40)) for k in range(60)]
    data, offsets = buffers(pa.array(texts))
    fast = language.label(model, 15.0, data, offsets)
    starts, ends, first, bucket, at, *_ = language.grams(data, offsets)
    score = np.stack([np.add.reduceat(w[bucket], at, dtype=np.float64) for w in model.weights], axis=1)
    for i, (lang, share, _) in enumerate(fast):
        path = language.viterbi(score[first[i]:first[i + 1]], 15.0)
        n = np.bincount(path, (ends - starts)[first[i]:first[i + 1]], len(model.langs))
        assert share == pytest.approx(n.max() / n.sum()) and n[lang] == n.max()


def base_log(words_, c, n, v):
    return sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words_)


def test_lm_blocks_and_pieces_do_not_change_scores(spark):
    """One block and one piece, or many of both: the same counts, base scores and scores."""
    rows = awkward_rows(3000) + [(200 + k, f"{PROSE.split()[k % 9]} rare{k % 50} the sea rare{k % 40}", "en", "s", 1, 1, "x") for k in range(120)]
    docs = awkward(spark, rows)
    train = F.col("doc_id").isNull() | (F.col("doc_id") % 2 == 1)
    tokens = lambda t: [*words((t or "").translate(LOWER)), ""]
    c = Counter(w for r in rows if r[0] is None or r[0] % 2 for w in tokens(r[1]))
    n, v = sum(c.values()), len(c)
    want = sorted(((r[0], len(tokens(r[1])), sum(c[w] > 0 for w in tokens(r[1])), n, base_log(tokens(r[1]), c, n, v)) for r in rows), key=repr)
    found = []
    for block_tokens, piece_codes, parts in ((1 << 20, 1 << 21, 1), (50, 40, 5), (1, 7, 3)):
        got = lm.score(docs.repartition(parts), train, block_tokens=block_tokens, piece_codes=piece_codes).collect()
        have = sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got), key=repr)
        assert [x[:4] for x in have] == [x[:4] for x in want]
        assert [x[4] for x in have] == pytest.approx([x[4] for x in want])
        found.append(sorted((repr(r["doc_id"]), r["n_tokens"], round(r["score"], 6)) for r in got))
    assert found[0] == found[1] == found[2]


def test_lm_probabilities_of_a_state_sum_to_one():
    """The words after a context, the end and an unknown word have probability 1 together."""
    corpus = ["a b c", "a b d", "a b c", "b c", "c a b", "d d d a", "a b"]
    after = ["a", "b", "c", "d", "unknown"]
    one, two, three = Counter(), Counter(), Counter()
    for t in corpus:
        w = [*t.split(), ""]
        one.update(w), two.update(zip(["", *w], w)), three.update(zip(["", *w], w, w[1:]))
    n, v = sum(one.values()), len(one)
    for context in ("a b", "d", "c d", "d zz"):
        # what a continuation adds to its context, read off the walk token by token
        p = 0.0
        for w in [*after, ""]:
            tokens = ["", *context.split(), w]
            block = {"tokens": len(tokens) - 1, "lens": np.array([len(tokens) - 1], "<i4").tobytes(), "train": b"\0",
                     "c1": lm.planes(np.array([one[x] for x in tokens[1:]])), "c2": lm.planes(np.array([two[x] for x in zip(tokens, tokens[1:])])),
                     "c3": lm.planes(np.array([0, *[three[x] for x in zip(tokens, tokens[1:], tokens[2:])]]))}
            at = lm.Walk(block, n, v)
            at.after1[0] = one[""]
            p += 10 ** at.steps(2.0, 4.0)[-1]
        assert p == pytest.approx(1)


def test_lm_empty_tables(spark):
    got = lm.score(awkward(spark), F.lit(False)).collect()
    assert len(got) == len(awkward_rows()) and all(r["n_known"] == 0 and r["train_tokens"] == 0 for r in got)
    assert [r["score"] for r in got] == pytest.approx([r["base_score"] for r in got])
    assert lm.score(awkward(spark, []), F.lit(True)).count() == 0


def test_planes():
    for a in (np.array([0, 0]), np.array([1, 2 ** 63, 255, 256], np.uint64), np.zeros(0, np.int64), np.arange(70000)):
        assert lm.numbers(lm.planes(a), len(a)).tolist() == a.tolist()


def test_token_histogram_and_limits(spark):
    rows = awkward_rows(3000)
    hist = token_counts.histogram(awkward(spark, rows))
    encode = byte_encoder(public_path(token_counts.RANKS)).encode_ordinary
    n = [(r[3], len(encode(r[1] or ""))) for r in rows]
    assert {(r["source"], r["length"]): r["n_docs"] for r in hist.collect()} == Counter(n)
    got = token_counts.limits(hist).collect()
    for r in got:
        own = [k for s, k in n if r["all_sources"] or s == r["source"]]
        assert r["total_docs"] == len(own) and r["total_tokens"] == sum(own)
        assert r["docs_longer"] == sum(k > r["length"] for k in own)
        assert r["kept_tokens"] == sum(min(k, r["length"]) for k in own) == r["total_tokens"] - r["lost_tokens"]
        assert r["docs_share"] == pytest.approx(sum(k <= r["length"] for k in own) / len(own))
    at = {(r["source"], r["context"]): r["kept_tokens"] for r in token_counts.at_limits(hist, [0, 64, 10 ** 6]).collect()}
    assert all(x == sum(min(k, c) for s, k in n if s == src) for (src, c), x in at.items())
    assert token_counts.limits(token_counts.histogram(awkward(spark, []))).count() == 0


def test_packing_pieces_and_places(spark):
    from tokenizers import Tokenizer
    extra = ["<|endoftext|> and <|startoftext|>", "Don't STOP, it's Ünïcode—e\u0301! 12,345.67 (ok)...", "x" * 5000, "a\u00a0b\u3000c", "\u0301 mark"]
    rows = awkward_rows() + [(500 + k, t, None, None, None, None, None) for k, t in enumerate(extra)]
    got = packing.pack(awkward(spark, rows)).collect()
    tok = Tokenizer.from_file(public_path(packing.VOCABULARY))
    want = []
    for r in rows:
        ids = np.array(tok.encode(r[1] or "", add_special_tokens=False).ids + [0], "<u4")
        want += [(r[0], k, 2048 * k, len(ids[2048 * k:2048 * k + 2048]), zlib.crc32(ids[2048 * k:2048 * k + 2048].tobytes()))
                 for k in range(-(-len(ids) // 2048))]
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        places.sort()
        assert all(o == sum(n for _, n in places[:k]) for k, (o, _) in enumerate(places)) and sum(n for _, n in places) <= 2048
    assert packing.pack(awkward(spark, [])).count() == 0


def test_bins_choose_the_best_fit_and_close_the_fullest():
    rng = np.random.default_rng(2)
    bins, room, open_bins = packing.Bins(100, 5), {}, []
    for length in rng.integers(1, 101, 3000).tolist():
        fit = [b for b in open_bins if room[b] >= length]
        number, offset = bins.place(length)
        if fit:
            assert room[number] == min(room[b] for b in fit)
        else:
            if len(open_bins) == 5:
                least = min(room[b] for b in open_bins)
                gone = [b for b in open_bins if room[b] == least]
                open_bins.remove(gone[-1])
                room[gone[-1]] = -1
            room[number] = 100
        assert offset == 100 - room[number]
        if number in open_bins:
            open_bins.remove(number)
        room[number] -= length
        if room[number]:
            open_bins.append(number)


def test_pipeline_stages_keep_columns_and_rows(spark, tmp_path):
    docs = awkward(spark).select("doc_id", "text", "lang", "source", "n_chars")
    columns, docs_in = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs_in, SF_SMALL).write.parquet(str(tmp_path / name))
        docs_in = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert docs_in.columns == columns
    assert docs_in.select("doc_id").distinct().count() >= 2
    assert corpus_pipeline.run(spark, SF_SMALL).count() > 0


def _passes_rules(text):
    """The quality rules, read off their table in plain Python."""
    import re
    w, lines = words(text), [x for x in (text or "").split("\n") if words(x)]
    seen = Counter(zip(w, w[1:], w[2:]))
    repeat = {k + d for k, x in enumerate(zip(w, w[1:], w[2:])) if seen[x] > 1 for d in range(3)}
    if len(w) < 50 or 100 * len(repeat) > 50 * len(w):
        return False
    chars = sum(map(len, w))
    value = {"mean_word": chars / len(w), "symbol_ratio": sum(c in "#*$%&|<>" for c in text) / chars,
             "letter_word_ratio": sum(any(c.isalpha() for c in x) for x in w) / len(w),
             "stop_ratio": sum(x.lower() in quality.STOP_WORDS for x in w) / len(w), "dup_line_ratio": (len(lines) - len(set(lines))) / len(lines),
             "bullet_line_ratio": sum(bool(re.match(r"[ \t]*[-*•‣●]", x)) for x in lines) / len(lines),
             "ellipsis_line_ratio": sum(bool(re.search(r"(\.\.\.|…)[ \t\r]*$", x)) for x in lines) / len(lines)}
    return not any(value[m] > v if bound == "max" else value[m] < v for _, m, bound, v in quality.RULES)


def test_pipeline_against_plain_stages(spark, tmp_path):
    """What every stage keeps, copies and packs, worked out on the rows one by one."""
    from tokenizers import Tokenizer

    from .test_pairs import linked_sets

    p, o = PROSE.split(), OTHER.split()
    texts = [" ".join(p[(k * 7 + j) % len(p)] + ("" if j % 9 else str(k)) for j in range(60 + 5 * k)) for k in range(12)]
    texts += [" ".join(o[(k * 5 + j) % len(o)] + ("" if j % 8 else str(k)) for j in range(70 + 3 * k)) for k in range(8)]
    texts += [texts[0], texts[0] + " end", texts[13] + " und", "# * $ " * 60, "too short", None, "", " ".join(["same words here"] * 40), "1234 5678 " * 60]
    rows = [(i, t, ["en", "de"][12 <= i < 20 or i == 22], ["a", "b", None][i % 3], len(t) if t else None, 0, "x") for i, t in enumerate(texts)]
    awkward(spark, rows).drop("size", "rank").write.parquet(str(tmp_path / "documents.parquet"))
    good = [r for r in rows if _passes_rules(r[1])]
    docs = awkward(spark, good)
    told = {r["doc_id"]: r for r in language.identify(docs, language.fit(docs)).collect()}      # held against all paths above
    known = [r for r in good if told[r[0]]["lang_pred"] != "und" and told[r[0]]["score"] >= language.MIN_SHARE]
    _, component = linked_sets(known, corpus_pipeline.SIMILARITY_PCT)
    first = [r for r in known if component[r[0]] == r[0]]
    assert len(good) < len(rows) and len(first) < len(known) and len(first) > 10
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(awkward(spark, first)).collect()}
    tok = Tokenizer.from_file(public_path(packing.VOCABULARY))
    want = Counter()
    for r in first:
        ids = np.array(tok.encode(r[1], add_special_tokens=False).ids + [0], "<u4")
        for k in range(-(-len(ids) // 2048)):
            part = ids[2048 * k:2048 * k + 2048]
            want[r[0], k, 2048 * k, len(part), zlib.crc32(part.tobytes())] += copies[r[0]]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(tuple(r)[:5] for r in got) == +want
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        places.sort()
        assert all(o == sum(n for _, n in places[:k]) for k, (o, _) in enumerate(places)) and sum(n for _, n in places) <= 2048


def test_language_of_held_out_documents(spark):
    """The query's split and its accuracy on what it has not learned from (the small tables' labels)."""
    got = {r["doc_id"]: r for r in LLM_QUERIES["op2_language"](spark, SF_SMALL).collect()}
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text", "lang").collect()
    assert len(got) == len(docs)
    for d in docs:
        assert got[d["doc_id"]]["held_out"] == (zlib.crc32(str(d["doc_id"]).encode()) % 4 == 2)
    held = [d for d in docs if got[d["doc_id"]]["held_out"] and d["lang"] and any(c.isalpha() for c in d["text"] or "")]
    right = sum(got[d["doc_id"]]["lang_pred"] == d["lang"] for d in held)
    assert len(held) > 20 and right >= 0.95 * len(held)


def test_all_queries_are_registered():
    assert [n.split("_")[0] for n in sorted(LLM_QUERIES, key=lambda n: int(n[2:].split("_")[0]))] == [f"op{k}" for k in range(1, 14)]
    assert set(LLM_ORACLE) <= set(LLM_QUERIES)


def test_lm_query_scores_with_every_ngram(spark, tmp_path):
    rows = [(100 + k, f"{PROSE.split()[k % 9]} rare{k} {PROSE.split()[k % 7]} rare{k % 40} end", "en", "s", 1, 1, "x") for k in range(80)]
    rows += [r for r in awkward_rows(3000) if r[0] is not None]
    awkward(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = LLM_QUERIES["op7_lm_score"](spark, str(tmp_path)).collect()
    held = {r["doc_id"]: r["held_out"] for r in got}
    assert len(got) == len(rows) and len(set(held.values())) == 2
    tokens = lambda t: [*words((t or "").translate(LOWER)), ""]
    one, two, three = Counter(), Counter(), Counter()
    for r in rows:
        if not held[r[0]]:
            w = tokens(r[1])
            one.update(w)
            two.update(zip(["", *w], w))
            three.update(zip(["", *w], w, w[1:]))
    n, v = sum(one.values()), len(one)
    p1 = lambda w: (one[w] + 0.1) / (n + 0.1 * (v + 1))

    def best(counts, of, low):
        return max(lm.MUS, key=lambda mu: sum(c * math.log((c - 1 + mu * low(g)) / (of(g) - 1 + mu)) for g, c in counts.items()))

    mu2 = best(two, lambda g: one[g[0]], lambda g: p1(g[1]))
    p2 = lambda a, w: (two[a, w] + mu2 * p1(w)) / (one[a] + mu2)
    mu3 = best(three, lambda g: two[g[:2]], lambda g: p2(*g[1:]))

    def brute(text):
        w = ["", *tokens(text)]
        logs = [math.log10(p2(w[0], w[1]))]
        logs += [math.log10((three[g] + mu3 * p2(*g[1:])) / (two[g[:2]] + mu3)) for g in zip(w, w[1:], w[2:])]
        return len(w) - 1, sum(one[x] > 0 for x in w[1:]), n, base_log(w[1:], one, n, v), sum(logs)

    want = sorted(((r[0], *brute(r[1])) for r in rows))
    have = sorted((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got)
    assert [x[:4] for x in have] == [x[:4] for x in want]
    assert [y for x in have for y in x[4:]] == pytest.approx([y for x in want for y in x[4:]])
    spark.createDataFrame([], awkward(spark).schema).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert LLM_QUERIES["op7_lm_score"](spark, str(tmp_path / "none")).count() == 0


def test_word_encoder_equals_whole_texts():
    """Word by word, with tails apart and a memo that starts anew, as the tokenizer alone does it."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    from siftwise.llm.packing import VOCABULARY
    from siftwise.llm.textcodes import buffers
    from siftwise.llm.tokens import WordEncoder

    path = public_path(VOCABULARY)
    plain, words = Tokenizer.from_file(path), WordEncoder(path)
    words.MOST_WORDS = 30
    tricky = ["it's, don't!! étÉ, Ω͜Σ. ÷, ×... «été». ñ!! Ça,va'; 'tis' x's, 3.14, 10%%% é%% “q”, ŒŸ; İ. ſ, ǆ; ΟΔΟΣ, ½! a²;",
              "x <|endoftext|> y <|ENDOFTEXT|>, a<|endoftext|>b, <|startoftext|>.", "", " \t\n", "a" * 5000 + "." * 5000, "!!! ... ?", "日本語。 のテキスト, ok。"]
    for texts in (tricky, [t for _, t, *_ in awkward_rows(400) if t], tricky):
        data, offsets = buffers(pa.array(texts))
        ids, bounds = words.encode(data, offsets, 0)
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [plain.encode(t, add_special_tokens=False).ids + [0] for t in texts]
