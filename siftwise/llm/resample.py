"""Importance resampling towards a target distribution, with hashed n-gram features.

A feature is a run of one to three words; its bucket is the CRC-32 of its bytes modulo
``BUCKETS``.  Two histograms (all documents, all target texts) give every bucket a gain,
a document's weight is the sum of the gains of its features, and Gumbel noise from a hash
of its id turns "the highest scores" into a draw without replacement.

In a task, the words of a slice of whole texts are laid out once, lower-cased and one
space apart, so that every feature is a run of bytes there.  Distinct features are found
by integer codes (word numbers packed into 63 bits), grouped by equal byte length into
two-dimensional uint8 arrays, and all CRCs of a group are updated column by column; the
buckets are then scattered back to the places of the text.  Words are numbered by 64-bit
codes; a slice has some 10**5 words, so two that share a code have a chance of 10**-9.

The texts are read twice (histogram, weights) and never shuffled or kept.  What the
driver gets is one histogram of ``BUCKETS`` rows, and what a task gets is as many gains.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.sampling import with_position
from .common import fresh, read, saved
from .registry import query
from .textcodes import Codes, buffers, slices

# Fixed values of the contract.
BUCKETS = 10_000
MOST_WORDS = 3             # words of the longest feature
SEED = "42"
MIN_WORDS, PERCENT = 20, 5
CHUNK_BYTES = 1 << 20
FEW = 8                    # a length with fewer features is not worth a matrix


def word_codes() -> Codes:
    """Codes whose words are runs of digits, ASCII letters and bytes above 0x7F."""
    codes = Codes()
    codes.space[:] = True
    for a, b in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
        codes.space[a:b] = False
    return codes


def crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1).astype(np.uint32)
    return t


def crc_of_runs(data: np.ndarray, starts: np.ndarray, lens: np.ndarray, table: np.ndarray) -> np.ndarray:
    """CRC-32 of the byte runs ``data[start:start + len]``, one matrix for each length."""
    out = np.empty(len(starts), np.uint32)
    order = np.argsort(lens, kind="stable")
    sorted_lens = lens[order]
    cuts = np.flatnonzero(np.diff(sorted_lens, prepend=-1)).tolist() + [len(order)]
    for a, b in zip(cuts, cuts[1:]):
        group, n = order[a:b], int(sorted_lens[a])
        if b - a < FEW:
            for g in group.tolist():
                out[g] = zlib.crc32(data[starts[g]:starts[g] + n].tobytes())
            continue
        columns = data[np.arange(n)[:, None] + starts[group][None, :]]     # row k: byte k of every run
        crc = np.full(b - a, 0xFFFFFFFF, np.uint32)
        for column in columns:
            crc = table[(crc ^ column) & np.uint32(255)] ^ (crc >> np.uint32(8))
        out[group] = ~crc
    return out


class Features:
    """Buckets of all features of a slice of texts."""

    def __init__(self):
        self.codes, self.table = word_codes(), crc_table()

    def of(self, data: np.ndarray, offsets: np.ndarray):
        """(first, [(n, places, buckets)]): the index of each text's first word, and for each
        number of words n the first word of every feature with its bucket."""
        gaps = np.insert(data, offsets[1:], 32)                   # texts never touch
        starts, ends, first = self.codes.words(gaps, offsets + np.arange(len(offsets)))
        if not len(starts):
            return first, []
        _, number = np.unique(self.codes.word_codes(gaps, starts, ends), return_inverse=True)
        line = self.codes.lower[gaps]
        line[ends] = 32
        keep = ~self.codes.space[gaps]
        keep[ends] = True
        line = line[keep]
        at = np.concatenate(([0], np.cumsum(ends - starts + 1)))  # of each word in the line
        text_end = first[1:][np.repeat(np.arange(len(first) - 1), np.diff(first))]
        size, out = int(number.max()) + 1, []
        key = number.astype(np.int64)
        for n in range(1, MOST_WORDS + 1):
            if n > 1:
                key = key[:-1] * size + number[n - 1:]
            places = np.flatnonzero(np.arange(len(key)) + n <= text_end[:len(key)])
            if not len(places):
                break
            _, index, inverse = np.unique(key[places], return_index=True, return_inverse=True)
            some = places[index]
            crc = crc_of_runs(line, at[some], at[some + n] - 1 - at[some], self.table)
            out.append((n, places, (crc % np.uint32(BUCKETS)).astype(np.int64)[inverse]))
        return first, out


def _histogram(batches):
    """(text) -> bucket, n of all texts of the task"""
    import pyarrow as pa

    features, total = Features(), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        data, offsets = buffers(batch.column(0))
        for i, j in slices(offsets, CHUNK_BYTES):
            _, parts = features.of(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
            for _, _, buckets in parts:
                total += np.bincount(buckets, minlength=BUCKETS)
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["bucket", "n"])


def _weights(gains: list[int]):
    def run(batches):
        """(id, text) -> id, n_words, n_features, weight"""
        import pyarrow as pa

        features, gain = Features(), np.array(gains, np.int64)
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            for i, j in slices(offsets, CHUNK_BYTES):
                first, parts = features.of(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                n_features, weight = np.zeros(j - i, np.int64), np.zeros(j - i, np.int64)
                for _, places, buckets in parts:
                    bounds = np.searchsorted(places, first)
                    n_features += np.diff(bounds)
                    weight += np.diff(np.concatenate(([0], np.cumsum(gain[buckets])))[bounds])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(np.diff(first)), pa.array(n_features), pa.array(weight)],
                    ["id", "n_words", "n_features", "weight"])
    return run


def histogram(texts: DataFrame, text: str = "text") -> DataFrame:
    """(bucket, n): features of all texts by bucket, added up in the tasks first."""
    return (texts.select(F.col(text).alias("text")).mapInArrow(_histogram, "bucket int, n long")
            .groupBy("bucket").agg(F.sum("n").alias("n")))


def gains(docs: DataFrame, target: DataFrame, text: str = "text", target_text: str = "text") -> list[int]:
    """The gain of every bucket: floor(1000 ln of the smoothed ratio of target to documents)."""
    all_, wanted = histogram(docs, text).withColumnRenamed("n", "s"), histogram(target, target_text).withColumnRenamed("n", "t")
    d = (docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
         .join(all_, "bucket", "left").join(wanted, "bucket", "left")
         .select("bucket", *[F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in ("s", "t")]))
    rows = sorted(map(tuple, d.collect()))                         # BUCKETS rows, whatever the corpus
    s_all, t_all = sum(r[1] for r in rows), sum(r[2] for r in rows)
    return [int(np.floor(1000.0 * np.log((t + 1.0) * (s_all + BUCKETS) / ((s + 1.0) * (t_all + BUCKETS))))) for _, s, t in rows]


def noise(id_col: Column, seed: str = SEED) -> Column:
    """floor(1000 x Gumbel noise) of the id's hash (a null id hashes like an empty one)."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text: str = "text", target_text: str = "text",
             percent: int = PERCENT, min_words: int = MIN_WORDS, seed: str = SEED) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_features, weight, score, rank (null: not drawn).

    Of the N documents with at least ``min_words`` words, the floor(percent N / 100) highest
    scores are drawn; ties go to the smaller id, null ids last.  Null and empty texts have
    no features and weight 0.  Rows that repeat an id are documents of their own (with the
    same noise; equal ones are ranked in any order).  Empty tables give no rows; an empty
    target gives gains from its smoothing alone."""
    d = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    kind = d.schema["id"].dataType.simpleString()
    g = gains(d, target, "text", target_text)
    scored = saved(d.mapInArrow(_weights(g), f"id {kind}, n_words long, n_features long, weight long")
                   .withColumn("score", F.col("weight") + noise(F.col("id"), seed)))
    able = scored.where(F.col("n_words") >= min_words)
    ranked = with_position(able.select("*", (-F.col("score")).alias("_down"), F.col("id").isNull().alias("_no_id")),
                           ["_down", "_no_id", "id", "n_features"])
    most = F.floor(able.select(F.count("*")).scalar() * percent / 100)
    out = ranked.select("id", "n_words", "n_features", "weight", "score",
                        F.when(F.col("pos") < most, F.col("pos") + 1).cast("long").alias("rank"))
    rest = scored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    return out.unionByName(rest).withColumnRenamed("id", id_col)


def drawn_documents(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **kw) -> DataFrame:
    """The drawn rows of ``docs`` with all their columns (all rows of an id of which one is drawn)."""
    name, = fresh(docs, "drawn_id")
    drawn = (resample(docs, target, id_col, **kw).where(F.col("rank").isNotNull())
             .select(F.col(id_col).alias(name)).distinct())
    return docs.join(drawn, docs[id_col].eqNullSafe(drawn[name]), "left_semi")


@query("op12_resample")
def op12_resample(spark, sf_dir):
    """All documents scored against the benchmark texts, with the draw of 5 percent."""
    return resample(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "benchmark", "text")).drop("n_words")
