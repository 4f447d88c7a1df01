"""Language-model scores from a backoff automaton of every n-gram of the corpus.

States are the contexts of up to two words, arcs the words seen after them, and every state
has a failure arc to the state of its last word, then to the root, where each word has an
arc.  With mu chosen per order, an arc of a state with c(v) tokens weighs
log10((c(vw) + mu P(w)) / (c(v) + mu)) and its failure arc log10(mu / (c(v) + mu)), P(w) being
the state below; no n-gram is left out, so all probabilities of a state sum to 1.  A text is
walked once from left to right; the state at a word follows from the two words before it.

The automaton of a large corpus fits nowhere whole, and a scored text needs few of its arcs.
Texts are packed into blocks of about ``BLOCK_TOKENS`` tokens (word numbers and the codes of
the block's words).  A block asks for its distinct words, pairs and triples, with its own
training counts; the asked codes are dealt to pieces by code range, where the counts of all
blocks add up, and every block is told the totals of what it asked.  So an n-gram is one
entry per block, however frequent, and a block then holds exactly the arcs that its texts
walk.  Blocks with the counts at every token are kept in the shared folder; the two mus
(best leave-one-out likelihood of the training tokens) and the scores are passes over them.

Blocks are made twice from the texts, to ask and to be told, rather than kept; the answers
carry a checksum, so a table that does not read the same twice is an error, not a wrong score.
N-grams are told apart by 56-bit codes: of 10**9 distinct ones, about 7 pairs share a code
by chance.  The driver gets sums.
"""

from __future__ import annotations

import math
import uuid
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .common import read, worker_memo
from .language import held_out
from .registry import query
from .textcodes import U64, Codes, buffers, mix64, slices

ADD = 0.1                 # fixed value of the contract
MUS = [2.0 ** k for k in range(0, 21)]
END = 0x5851F42D4C957F2D  # code of the end of a text, which is also the context of its first word
CHUNK_BYTES = 1 << 20
BLOCK_TOKENS = 3 << 20
TOKEN_BYTES = 5           # of text for a token, about: sizes the pieces and the shuffle of blocks
CODE_BITS = 56
PIECE_CODES = 1 << 21     # asked codes of a piece, about
SHARES = (0.4, 0.8, 1.0)  # distinct words, pairs and triples of a block per token, at most about

TOLD = "block long, tokens long, ids array<{kind}>, train binary, lens binary, c1 binary, c2 binary, c3 binary, vocabulary array<struct<piece:int,words:long>>"


def planes(a: np.ndarray) -> bytes:
    """Whole numbers as byte planes, low bytes first, without the high planes that are all zero,
    and compressed: what is alike lies together."""
    import pyarrow as pa

    b = np.ascontiguousarray(a, "<u8").view(np.uint8).reshape(-1, 8)
    used = 8
    while used and not b[:, used - 1].any():
        used -= 1
    return bytes([used]) + pa.compress(np.ascontiguousarray(b[:, :used].T).tobytes(), codec="zstd", asbytes=True)


def numbers(blob: bytes, n: int) -> np.ndarray:
    import pyarrow as pa

    out = np.zeros((n, 8), np.uint8)
    used = blob[0]
    if used:
        raw = pa.decompress(blob[1:], decompressed_size=used * n, codec="zstd", asbytes=True)
        out[:, :used] = np.frombuffer(raw, np.uint8).reshape(used, n).T
    return out.view("<u8").ravel()


class Block:
    """Texts of a block: ids, training flags, tokens each (the end counts), word codes and word numbers."""

    def __init__(self, ids, train, lens, codes, index):
        self.ids, self.train, self.lens, self.codes, self.index = ids, train, lens, codes, index

    def ngrams(self):
        """Codes of the word, then the pair, then the triple at every token (triples of first words: 0, for none)."""
        word = self.codes[self.index]
        yield word
        first = np.cumsum(self.lens) - self.lens
        before = np.empty_like(word)
        before[1:] = word[:-1]                     # before a text's first word: the end of the text before it
        before[first] = END
        pair = mix64(before * U64(0xD6E8FEB86659FD93) + word * U64(0xA0761D6478BD642F) + U64(2))
        del before
        yield pair
        triple = np.zeros_like(word)
        triple[1:] = mix64(pair[:-1] * U64(0xE7037ED1A0B428DB) + word[1:] * U64(0x8EBC6AF09C88C6E3) + U64(3))
        triple[first] = 0
        yield triple

    def asked(self):
        """For each order in turn: (ascending distinct codes, place of each token's code in them)."""
        for codes in self.ngrams():
            yield np.unique(codes >> U64(64 - CODE_BITS), return_inverse=True)

    def checksum(self) -> int:
        return zlib.crc32(self.index.tobytes(), zlib.crc32(self.codes.tobytes(), zlib.crc32(self.lens.tobytes())))


def _pack(block_tokens: int, kind: str):
    def run(batches):
        """(id, text, train) -> block, tokens, ids, train, lens, codes, index"""
        import pyarrow as pa
        from pyspark import TaskContext

        worker_memo(None)
        codes, number = Codes(), TaskContext.get().partitionId() << 32
        held, size = [], 0

        def made():
            word = np.concatenate([h[3] for h in held])
            distinct, index, n = np.unique(word, return_inverse=True, return_counts=True)
            order = np.argsort(-n, kind="stable")            # frequent words get small numbers
            place = np.empty_like(order)
            place[order] = np.arange(len(order))
            ids = pa.concat_arrays([h[0] for h in held])
            lens = np.concatenate([h[2] for h in held])
            return pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([len(word)], pa.int64()),
                 pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([np.concatenate([h[1] for h in held]).tobytes()], pa.binary()),
                 pa.array([lens.astype("<i4").tobytes()], pa.binary()), pa.array([distinct[order].astype("<u8").tobytes()], pa.binary()),
                 pa.array([planes(place[index])], pa.binary())], ["block", "tokens", "ids", "train", "lens", "codes", "index"])

        for batch in batches:
            data, offsets = buffers(batch.column(1))
            train = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for i, j in slices(offsets, CHUNK_BYTES):
                part = data[offsets[i]:offsets[j]]
                starts, ends, first = codes.words(part, offsets[i:j + 1] - offsets[i])
                lens = np.diff(first) + 1
                word = np.full(int(lens.sum()), END, U64)
                inside = np.ones(len(word), bool)
                inside[np.cumsum(lens) - 1] = False
                word[inside] = codes.word_codes(part, starts, ends)
                held.append((batch.column(0).slice(i, j - i), train[i:j], lens, word))
                size += len(word)
                if size >= block_tokens:
                    yield made()
                    held, size, number = [], 0, number + 1
        if held:
            yield made()
    return run


def _block(r: dict) -> Block:
    lens = np.frombuffer(r["lens"], "<i4").astype(np.int64)
    return Block(r["ids"], np.frombuffer(r["train"], bool), lens, np.frombuffer(r["codes"], "<u8"), numbers(r["index"], r["tokens"]).astype(np.int64))


def _rows(batches):
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def _ask(pieces: list[int]):
    """Blocks -> (piece, block, n, codes, counts, checksum): what a block asks of every piece (ascending codes, as
    differences), with its training counts.  Pieces of an order are equal ranges of codes; ``pieces``: how
    many each order has."""
    base = [sum(pieces[:k]) for k in range(3)]

    def run(batches):
        import pyarrow as pa

        for r in _rows(batches):
            b = _block(r)
            train, checksum = np.repeat(b.train, b.lens), b.checksum()
            for order, (codes, place) in enumerate(b.asked()):
                counts = np.bincount(place, train, len(codes)).astype(np.int64)
                bounds = np.searchsorted(codes, np.array([(p << CODE_BITS) // pieces[order] for p in range(pieces[order])], U64))
                bounds = np.append(bounds, len(codes))
                for p in range(pieces[order]):
                    i, j = bounds[p], bounds[p + 1]
                    if i < j:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([base[order] + p], pa.int32()), pa.array([r["block"]], pa.int64()), pa.array([int(j - i)], pa.int64()),
                             pa.array([planes(np.diff(codes[i:j], prepend=U64(0)))], pa.binary()), pa.array([planes(counts[i:j])], pa.binary()),
                             pa.array([checksum], pa.int64())], ["piece", "block", "n", "codes", "counts", "checksum"])
    return run


def _answer(words: int):
    """(piece, block, n, codes, counts, checksum), the rows of a piece together -> (block, piece, totals, words, checksum): the
    totals of what each block asked; ``words``: number of pieces of single words, which also tell how many
    distinct training words they hold."""
    def run(batches):
        import pyarrow as pa

        def told(piece, held):
            codes = np.concatenate([np.cumsum(numbers(r["codes"], r["n"]), dtype=U64) for r in held])
            distinct, place = np.unique(codes, return_inverse=True)
            totals = np.bincount(place, np.concatenate([numbers(r["counts"], r["n"]) for r in held]), len(distinct)).astype(np.int64)
            known, at = int((totals > 0).sum()) if piece < words else 0, 0
            for r in held:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["block"]], pa.int64()), pa.array([piece], pa.int32()), pa.array([r["n"]], pa.int64()),
                     pa.array([planes(totals[place[at:at + r["n"]]])], pa.binary()), pa.array([known], pa.int64()), pa.array([r["checksum"]], pa.int64())],
                    ["block", "piece", "n", "totals", "words", "checksum"])
                at += r["n"]

        held: list[dict] = []
        for r in _rows(batches):
            if held and held[0]["piece"] != r["piece"]:
                yield from told(held[0]["piece"], held)
                held = []
            held.append(r)
        if held:
            yield from told(held[0]["piece"], held)
    return run


def _tell(pieces: list[int]):
    """A block (piece -1) and then its answers, by piece -> the block with the counts at every token."""
    ends = [sum(pieces[:k + 1]) for k in range(3)]

    def run(batches):
        import pyarrow as pa

        def told(r, answers):
            b, counts = _block(r), []
            if any(a["checksum"] != b.checksum() for a in answers[:1]) or not answers:
                raise RuntimeError("the texts to be scored did not read the same twice; write them to a table first")
            totals: list[list] = [[], [], []]
            for a in answers:
                totals[next(k for k in range(3) if a["piece"] < ends[k])].append(numbers(a["totals"], a["n"]))
            for (_, place), t in zip(b.asked(), totals):
                counts.append(planes(np.concatenate(t)[place]))
            return {"block": r["block"], "tokens": r["tokens"], "ids": r["ids"], "train": r["train"], "lens": r["lens"], "c1": counts[0], "c2": counts[1],
                    "c3": counts[2], "vocabulary": [{"piece": a["piece"], "words": a["words"]} for a in answers if a["piece"] < pieces[0]]}

        schema, now, answers = None, None, []
        for batch in batches:
            if schema is None:
                vocabulary = pa.list_(pa.struct([("piece", pa.int32()), ("words", pa.int64())]))
                schema = pa.schema([("block", pa.int64()), ("tokens", pa.int64()), ("ids", batch.schema.field("ids").type),
                                    *[(c, pa.binary()) for c in ("train", "lens", "c1", "c2", "c3")], ("vocabulary", vocabulary)])
            for r in _rows([batch]):
                if r["piece"] < 0:
                    if now is not None:
                        yield pa.RecordBatch.from_pylist([told(now, answers)], schema)
                    now, answers = r, []
                else:
                    answers.append(r)
        if now is not None:
            yield pa.RecordBatch.from_pylist([told(now, answers)], schema)
    return run


class Walk:
    """A block on the automaton: counts at every token and weights of the arcs that it takes."""

    def __init__(self, r: dict, tokens: int, words: int):
        n = r["tokens"]
        self.lens, self.train = np.frombuffer(r["lens"], "<i4").astype(np.int64), np.frombuffer(r["train"], bool)
        self.first = np.cumsum(self.lens) - self.lens
        self.c1, self.c2, self.c3 = (numbers(r[c], n).astype(np.float64) for c in ("c1", "c2", "c3"))
        # tokens after the state of one word and of two: the counts one token before
        self.after1, self.after2 = np.empty(n), np.zeros(n)
        self.after1[1:], self.after2[1:] = self.c1[:-1], self.c2[:-1]
        if n:
            self.after1[0] = self.c1[-1]                         # the last token is an end, and a text begins after one
        self.after2[self.first] = 0.0                            # no state of two words at a text's first word
        self.c3[self.first] = 0.0
        self.root = (self.c1 + ADD) / (tokens + ADD * (words + 1))
        self.learns = np.repeat(self.train, self.lens)

    def below(self, mu: float) -> np.ndarray:
        """Probability of each token in the state of the word before."""
        return (self.c2 + mu * self.root) / (self.after1 + mu)

    def steps(self, mu1: float, mu2: float) -> np.ndarray:
        """Weight of each token's path: failure arcs down to the first state that has its arc, and that arc."""
        two = self.after2 > 0                                    # the state of two words exists
        arc2, arc1 = two & (self.c3 > 0), self.c2 > 0
        one = np.where(arc1, np.log10((self.c2 + mu1 * self.root) / (self.after1 + mu1)),
                       np.log10(mu1 / (self.after1 + mu1)) + np.log10(self.root))
        return np.where(arc2, np.log10((self.c3 + mu2 * self.below(mu1)) / (self.after2 + mu2)),
                        np.where(two, np.log10(mu2 / (self.after2 + mu2)), 0.0) + one)


def _likelihood(tokens: int, words: int, mu1: float | None):
    """Told blocks -> sums, over the training tokens, of n-gram log probabilities without the token itself, for every mu."""
    def run(batches):
        import pyarrow as pa

        for r in _rows(batches):
            w = Walk(r, tokens, words)
            n, of, low = (w.c2, w.after1, w.root) if mu1 is None else (w.c3, w.after2, w.below(mu1))
            use = w.learns & (n > 0)
            n, of, low = n[use], of[use], low[use]
            sums = [float(np.log((n - 1 + mu * low) / (of - 1 + mu)).sum()) for mu in MUS]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(MUS)), pa.int32()), pa.array(sums)], ["k", "s"])
    return run


def _scores(tokens: int, words: int, mu1: float, mu2: float):
    """Told blocks -> id, n_tokens, n_known, base_score, score of every text"""
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                ids = row.column(row.schema.get_field_index("ids")).flatten()
                w = Walk(row.to_pylist()[0], tokens, words)
                add = lambda x: np.add.reduceat(x, w.first) if len(w.first) else x
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(w.lens), pa.array(add((w.c1 > 0).astype(np.int64))), pa.array(add(np.log10(w.root))),
                     pa.array(add(w.steps(mu1, mu2)))], ["id", "n_tokens", "n_known", "base_score", "score"])
    return run


def score(docs: DataFrame, train: Column, id_col: str = "doc_id", text: str = "text", block_tokens: int = BLOCK_TOKENS,
          piece_codes: int = PIECE_CODES) -> DataFrame:
    """One row per row of ``docs``: id, n_tokens, n_known, train_tokens, base_score, score, learned
    from the rows where ``train`` holds.

    Null and empty texts are the end alone.  Repeated ids and rows are scored each on their
    own.  Without a training row every word is unknown and both scores are equal.  An empty
    table gives no rows.  ``docs`` is read twice and must be the same both times, as tables are."""
    spark = docs.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/lm-{uuid.uuid4().hex}"

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    d = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    kind = d.schema["id"].dataType.simpleString()
    size = d.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    about = size[0] / TOKEN_BYTES + size[1]
    pieces = [max(1, math.ceil(about * share / piece_codes)) for share in SHARES]
    pack, ask = _pack(block_tokens, kind), _ask(pieces)
    answers = (d.mapInArrow(lambda batches: ask(pack(batches)), "piece int, block long, n long, codes binary, counts binary, checksum long")
               .repartition(sum(pieces), "piece").sortWithinPartitions("piece", "block")
               .mapInArrow(_answer(pieces[0]), "block long, piece int, n long, totals binary, words long, checksum long"))
    blocks = d.mapInArrow(pack, f"block long, tokens long, ids array<{kind}>, train binary, lens binary, codes binary, index binary")
    both = blocks.withColumn("piece", F.lit(-1)).unionByName(answers, allowMissingColumns=True)
    told = kept(both.repartition(max(1, math.ceil(2 * about / block_tokens)), "block").sortWithinPartitions("block", "piece")
                .mapInArrow(_tell(pieces), TOLD.format(kind=kind)), "told")
    words = told.select(F.explode("vocabulary").alias("v")).select("v.*").distinct().agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    tokens = _training_tokens(told)

    def best(mu1: float | None) -> float:
        columns = ["tokens", "train", "lens", "c1", "c2", "c3"]
        got = told.select(*columns).mapInArrow(_likelihood(tokens, words, mu1), "k int, s double").groupBy("k").agg(F.sum("s").alias("s")).collect()
        sums = {r["k"]: r["s"] for r in got}
        return MUS[max(range(len(MUS)), key=lambda k: sums.get(k, 0.0))]

    mu1 = best(None)
    mu2 = best(mu1)
    out = told.select("tokens", "ids", "train", "lens", "c1", "c2", "c3").mapInArrow(
        _scores(tokens, words, mu1, mu2), f"id {kind}, n_tokens long, n_known long, base_score double, score double")
    return out.select(F.col("id").alias(id_col), "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")


def _training_tokens(told: DataFrame) -> int:
    def run(batches):
        import pyarrow as pa

        for r in _rows(batches):
            n = np.frombuffer(r["lens"], "<i4").astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([int(n[np.frombuffer(r["train"], bool)].sum())])], ["n"])
    return told.select("lens", "train").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


@query("op7_lm_score")
def op7_lm_score(spark, sf_dir):
    """Score of every document, learned from all n-grams of those that are not held out."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    held = held_out("doc_id", 10, 0)
    out = score(docs, ~held)
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
