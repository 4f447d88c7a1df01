"""Language identification of mixed-language text.

Training counts letter trigrams per language over all labelled training texts (hashed
to ``BUCKETS``; partial counts per task, so the shuffle and the model are bounded by
languages x buckets) and letters per (language, script).

Prediction, whole texts in Arrow batches:

1. the script of a word (fixed ranges) narrows the candidates to the languages that
   write it in training (at least ``SCRIPT_SHARE`` of their letters);
2. a word's score under a language is the sum of its trigrams' log-probabilities;
3. Viterbi over the words with a penalty per switch of language labels the spans.

A text whose best single language cannot be beaten is recognised without the
Viterbi loop: a stretch of words given to other languages gains at most the largest
sum over adjacent words of (best other score - this score) and costs at least one
switch; if no stretch gains a switch, the single language is the optimal path.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read, tidied, worker_memo
from .registry import query
from .textcodes import U64, buffers, mix64, slices

BUCKETS = 1 << 16
ALPHA = 0.5
SWITCH = 15.0
SCRIPT_SHARE = 0.005
OTHER_SCRIPT = -50.0
MIN_SHARE = 0.5
CHUNK_BYTES = 256 << 10

# Fixed values: (first, last code point, script); letters outside have script 0.
SCRIPT_RANGES = [
    (0x0041, 0x024F, "Latin"), (0x0370, 0x03FF, "Greek"), (0x0400, 0x052F, "Cyrillic"), (0x0530, 0x058F, "Armenian"),
    (0x0590, 0x05FF, "Hebrew"), (0x0600, 0x06FF, "Arabic"), (0x0750, 0x077F, "Arabic"), (0x0900, 0x097F, "Devanagari"),
    (0x0980, 0x09FF, "Bengali"), (0x0A00, 0x0A7F, "Gurmukhi"), (0x0A80, 0x0AFF, "Gujarati"), (0x0B80, 0x0BFF, "Tamil"),
    (0x0C00, 0x0C7F, "Telugu"), (0x0C80, 0x0CFF, "Kannada"), (0x0D00, 0x0D7F, "Malayalam"), (0x0E00, 0x0E7F, "Thai"),
    (0x10A0, 0x10FF, "Georgian"), (0x1100, 0x11FF, "Hangul"), (0x1E00, 0x1EFF, "Latin"), (0x1F00, 0x1FFF, "Greek"),
    (0x3040, 0x30FF, "Kana"), (0x3400, 0x4DBF, "Han"), (0x4E00, 0x9FFF, "Han"), (0xAC00, 0xD7AF, "Hangul"),
    (0xF900, 0xFAFF, "Han"), (0xFF21, 0xFF5A, "Latin"), (0x20000, 0x2FA1F, "Han"),
]
SCRIPTS = sorted({s for _, _, s in SCRIPT_RANGES})


def letter_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(is a letter, lower case, script number) by code point; made once per worker."""
    def make():
        n = 0x110000
        chars = np.arange(n, dtype=np.uint32)
        letter, lower = np.zeros(n, bool), chars.copy()
        for i in range(0, n, 1 << 14):                   # no Python string per code point
            part = chars[i:i + (1 << 14)].view("U1")
            letter[i:i + len(part)] = np.strings.isalpha(part)
            lower[i:i + len(part)] = np.strings.lower(part).view(np.uint32)
        lower[~letter] = chars[~letter]
        lower[0x130] = 0x130                              # the only letter whose lower case is two characters
        script = np.zeros(n, np.uint8)
        for a, b, s in SCRIPT_RANGES:
            script[a:b + 1] = SCRIPTS.index(s) + 1
        return letter, lower, script

    return worker_memo("letters", make)


def grams(data: np.ndarray, offsets: np.ndarray):
    """Words (runs of letters) of many texts and their trigrams.

    Returns (starts, ends, first word of each text, bucket of each trigram, first trigram of
    each word, script of each word, letters per text, offsets in code points)."""
    letter, lower, script = letter_tables()
    cp = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    heads = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    off = heads[offsets]
    is_letter = letter[cp]
    start, end = is_letter.copy(), is_letter.copy()
    if len(cp):
        start[1:] &= ~is_letter[:-1]
        end[:-1] &= ~is_letter[1:]
        inner = off[1:-1]
        inner = inner[(inner > 0) & (inner < len(cp))]
        start[inner] = is_letter[inner]
        end[inner - 1] = is_letter[inner - 1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    first = np.searchsorted(starts, off)
    # the letters of all words in a row, each word closed by a 0: trigrams never cross words
    n = ends - starts
    upto = np.concatenate(([0], np.cumsum(n)))
    place = np.arange(upto[-1]) + np.repeat(np.arange(len(n)), n)
    row = np.zeros(int(upto[-1]) + len(n), np.uint32)
    row[place] = lower[cp[is_letter]]
    at = upto[:-1] + np.arange(len(n))
    one = np.zeros(len(row), np.uint32)       # the letter before, 0 at a word's start
    two = np.zeros(len(row), np.uint32)
    if len(row):
        one[1:] = row[:-1]
        two[2:] = row[:-2]
        one[at] = 0
        two[at] = 0
        two[at + 1] = 0
    code = (two.astype(U64) << U64(42)) | (one.astype(U64) << U64(21)) | row
    bucket = (mix64(code) >> U64(48)).astype(np.int64)       # BUCKETS = 2**16
    return starts, ends, first, bucket, at, script[cp[starts]].astype(np.int64), np.diff(upto[first]), off


def _count(batches):
    """(lang, text) -> lang, slot, n: trigrams by bucket, then letters by script."""
    import pyarrow as pa

    by: dict[str, np.ndarray] = {}
    for batch in batches:
        data, offsets = buffers(batch.column(1))
        langs = batch.column(0).to_pylist()
        for i, j in slices(offsets, CHUNK_BYTES):
            starts, ends, first, bucket, at, scripts, _, _ = grams(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
            edge = np.append(at, len(bucket))
            for r in range(i, j):
                a, b = first[r - i], first[r - i + 1]
                if a == b:
                    continue
                n = by.get(langs[r])
                if n is None:
                    n = by[langs[r]] = np.zeros(BUCKETS + 256, np.int64)
                n[:BUCKETS] += np.bincount(bucket[edge[a]:edge[b]], minlength=BUCKETS) if edge[b] - edge[a] > 5000 else 0
                if edge[b] - edge[a] <= 5000:
                    np.add.at(n, bucket[edge[a]:edge[b]], 1)
                np.add.at(n, BUCKETS + scripts[a:b], ends[a:b] - starts[a:b])
    for lang, n in by.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at])],
                                         ["lang", "slot", "n"])


class Model:
    """Languages (sorted), trigram weights [language, bucket], candidates [script, language], the most frequent language."""

    def __init__(self, langs, weights, candidates, usual):
        self.langs, self.weights, self.candidates, self.usual = langs, weights, candidates, usual

    def values(self) -> tuple:
        return self.langs, self.weights, self.candidates, self.usual


def fit(train: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Model of all rows with a language.  The driver gets the summed counts (languages x buckets)."""
    counts = (train.where(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
              .mapInArrow(tidied(_count), "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))).toPandas()
    langs = sorted(counts["lang"].unique())
    n = np.zeros((len(langs), BUCKETS + 256))
    n[[langs.index(x) for x in counts["lang"]], counts["slot"].to_numpy()] = counts["n"].to_numpy()
    tri, letters = n[:, :BUCKETS], n[:, BUCKETS:]
    w = np.log((tri + ALPHA) / (tri.sum(axis=1, keepdims=True) + ALPHA * BUCKETS))
    w[:, tri.sum(axis=0) == 0] = 0                       # never seen: no evidence for any language
    w -= w.mean(axis=0, keepdims=True) if langs else 0
    share = letters / np.maximum(letters.sum(axis=1, keepdims=True), 1)
    usual = int(np.argmax(letters.sum(axis=1))) if langs else 0
    return Model(langs, w.astype(np.float32), (share >= SCRIPT_SHARE).T.copy(), usual)


def viterbi(score: np.ndarray, switch: float) -> np.ndarray:
    """Best language of each word (rows) under a penalty per switch."""
    n, k = score.shape
    back = np.zeros((n, k), np.int32)
    same = np.arange(k)
    best = score[0].copy()
    for t in range(1, n):
        top = int(np.argmax(best))
        jump = best[top] - switch
        stay = best >= jump
        back[t] = np.where(stay, same, top)
        best = np.where(stay, best, jump) + score[t]
    path = np.empty(n, np.int32)
    path[-1] = int(np.argmax(best))
    for t in range(n - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def label(model: Model, switch: float, data: np.ndarray, offsets: np.ndarray):
    """Per text: (language number or -1, score, spans [(language, start, end)] in code points)."""
    starts, ends, first, bucket, at, scripts, letters, off = grams(data, offsets)
    n, k = len(starts), len(model.langs)
    score = np.empty((n, k))
    for l in range(k):
        score[:, l] = np.add.reduceat(model.weights[l][bucket], at, dtype=np.float64) if n else 0
    allowed = model.candidates[scripts]
    known = allowed.any(axis=1)
    score[known] = np.where(allowed[known], score[known], OTHER_SCRIPT)
    score[~known] = 0
    size = np.where(known, ends - starts, 0)
    texts = len(offsets) - 1
    full = np.flatnonzero(first[1:] > first[:-1])
    out = [(-1, 0.0, [])] * texts
    if not k or not len(full):
        return out
    total = np.add.reduceat(score, first[full], axis=0)
    top = total.argmax(axis=1)
    word_text = np.repeat(np.arange(len(full)), np.diff(first)[full])
    own = score[np.arange(n), top[word_text]]
    rival = score.copy()
    rival[np.arange(n), top[word_text]] = -np.inf
    gain = rival.max(axis=1) - own if k > 1 else np.full(n, -1.0)
    run = np.cumsum(np.maximum(gain, -1e6))
    before = np.concatenate(([0.0], run[:-1]))
    shift = word_text * (2 * np.abs(run).max() + 1.0)        # keeps one text's lowest point out of the next
    low = np.minimum.accumulate(before - shift) + shift
    most = np.maximum.reduceat(run - low, first[full])
    sums = np.add.reduceat(size, first[full])
    for r, i in enumerate(full):
        a, b = first[i], first[i + 1]
        if letters[i] and not sums[r]:
            out[i] = (model.usual, 0.0, [])
        elif most[r] <= switch:
            l = int(top[r])
            out[i] = (l, float(sums[r] / letters[i]), [(l, int(starts[a] - off[i]), int(ends[b - 1] - off[i]))])
        else:
            path = viterbi(score[a:b], switch)
            share = np.bincount(path, size[a:b], k)
            l = int(share.argmax())
            cut = np.concatenate(([0], np.flatnonzero(path[1:] != path[:-1]) + 1, [b - a]))
            out[i] = (l, float(share[l] / letters[i]),
                      [(int(path[x]), int(starts[a + x] - off[i]), int(ends[a + y - 1] - off[i])) for x, y in zip(cut[:-1], cut[1:])])
    return out


def _predict(shared, switch: float):
    def run(batches):
        """(..., text last) -> the other columns, lang_pred, score, spans"""
        import pyarrow as pa

        model = Model(*shared.value)          # plain values: executors need no copy of this package
        names = [*model.langs, "und"]
        span = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            keep = batch.columns[:-1]
            data, offsets = buffers(batch.column(len(keep)))
            for i, j in slices(offsets, CHUNK_BYTES):
                got = label(model, switch, data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                yield pa.RecordBatch.from_arrays(
                    [*[c.slice(i, j - i) for c in keep], pa.array([names[l] for l, _, _ in got], pa.string()),
                     pa.array([s for _, s, _ in got], pa.float64()),
                     pa.array([[{"lang": names[l], "start": a, "end": b} for l, a, b in sp] for _, _, sp in got], span)],
                    [*batch.schema.names[:-1], "lang_pred", "score", "spans"])
    return tidied(run)


def identify(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",), switch: float = SWITCH) -> DataFrame:
    """``keep`` columns with lang_pred, score and spans (language, start, end in code points).

    ``score``: share of the letters that lie in spans of lang_pred.  Null texts and texts
    without a letter are ``und`` with score 0; texts whose scripts no language of the model
    writes get its most frequent language with score 0; a model without languages (empty
    training table) gives ``und``.  Every row is predicted on its own."""
    shared = docs.sparkSession.sparkContext.broadcast(model.values())      # languages x buckets
    d = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text).alias("_text"))
    from pyspark.sql import types as T
    schema = T.StructType([*d.schema.fields[:-1], *T.StructType.fromDDL(
        "lang_pred string, score double, spans array<struct<lang:string,start:bigint,end:bigint>>").fields])
    return d.mapInArrow(_predict(shared, switch), schema)


def held_out(id_col: str, parts: int, part: int):
    """crc32 of the id as text falls in the held-out part (null ids do not)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % parts == part, F.lit(False))


def keep_identified(docs: DataFrame, model: Model, text: str = "text", min_share: float = MIN_SHARE) -> DataFrame:
    """The rows of ``docs`` whose main language has at least ``min_share`` of the letters."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    got = identify(docs.select(row, F.col(text).alias("_t")), model, "_t", keep=("_row",))
    return got.where((F.col("lang_pred") != "und") & (F.col("score") >= min_share)).select("_row.*")


@query("op2_language")
def op2_language(spark, sf_dir):
    """Language of every document, learned from those that are not held out."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = fit(docs.where(~held_out("doc_id", 4, 2)))
    return identify(docs, model).select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score",
                                        F.size("spans").alias("n_spans"))
