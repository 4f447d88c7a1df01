"""Tokenizers inside tasks: word-wise encoding with a memo, and lengths of whole texts."""

from __future__ import annotations

import os
from itertools import chain

import numpy as np

from .common import worker_memo
from .textcodes import Codes


def public_path(name: str) -> str:
    """Place of a public tokenizer file on this machine."""
    import public_tokenizers
    return public_tokenizers.path(name)


class WordEncoder:
    """Ids of whole texts under a ``tokenizers`` file whose pre-tokenizer never joins
    across ASCII white space and drops it: a text's ids are its words' ids in a row.

    Words are known by their 64-bit codes (ASCII letters lower-cased, as the tokenizer would do
    itself), found in a batch without an object per word and looked up, once per distinct
    word, in a sorted memo.  Only words that are not there become strings; they are encoded
    and remembered (at most ``MOST_WORDS`` at a time, then the memo starts anew).  A tail of
    ASCII punctuation after an ASCII digit or a Latin letter is a pre-token of its own and a
    word of its own here.  Words with ``<|`` keep their case, as a special token's string is matched before
    lower-casing.  Two of the remembered words share a code with a chance of 10**-8."""

    MOST_WORDS = 800_000
    TAIL_BYTES = 16
    SALT = np.uint64(0xA5A5_5A5A_0F0F_F0F0)

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.codes, self.cased = Codes(), Codes()
        self.cased.lower = np.arange(256, dtype=np.uint8)
        self.tail, self.solid = np.zeros(256, bool), np.zeros(256, bool)
        for x, y in ((0x21, 0x30), (0x3A, 0x41), (0x5B, 0x61), (0x7B, 0x7F)):
            self.tail[x:y] = True
        for x, y in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B)):
            self.solid[x:y] = True
        self._clear()

    def _clear(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.starts, self.lens = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0

    def _items(self, data: np.ndarray, offsets: np.ndarray):
        """(starts, ends, codes, cased) of the words of all texts, tails apart, and the index of each text's first."""
        starts, ends, first = self.codes.words(data, offsets)
        special = np.zeros(len(starts), bool)
        hits = np.flatnonzero((data[:-1] == 0x3C) & (data[1:] == 0x7C)) if len(data) > 1 else np.zeros(0, np.int64)
        if len(hits):
            special[np.searchsorted(starts, hits, "right") - 1] = True
        core = ends.copy()
        for _ in range(self.TAIL_BYTES):
            more = (core > starts) & self.tail[data[core - 1]]
            if not more.any():
                break
            core = core - more
        apart = (core > starts) & (core < ends) & ~special
        last, lead = data[core[apart] - 1], data[np.maximum(core[apart] - 2, 0)]
        latin = (last >= 0x80) & (((lead == 0xC3) & (last != 0x97) & (last != 0xB7)) | ((lead == 0xC4) & (last != 0xB0)) | (lead == 0xC5))
        # U+00C0 to U+017F but U+0130, whose lower case ends in a mark
        apart[apart] = self.solid[last] | latin
        count = 1 + apart
        at = np.cumsum(count) - count
        s, e = np.repeat(starts, count), np.repeat(ends, count)
        e[at[apart]] = core[apart]
        s[at[apart] + 1] = core[apart]
        codes = self.codes.word_codes(data, s, e)
        kept = np.repeat(special, count)
        if kept.any():
            codes[kept] = self.cased.word_codes(data, s[kept], e[kept]) ^ self.SALT
        return s, e, codes, kept, np.append(at, len(s))[first]

    def _learn(self, codes: np.ndarray, words: list[str]) -> None:
        """Encode and remember words under their (ascending) codes."""
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        lens = np.fromiter(map(len, ids), np.int32, len(ids))
        total = int(lens.sum())
        if self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat[:self.used], np.zeros(max(self.used // 2, total), np.int32)])
        self.flat[self.used:self.used + total] = np.fromiter(chain.from_iterable(ids), np.int32, total)
        at = np.searchsorted(self.known, codes)
        self.known = np.insert(self.known, at, codes)
        self.starts = np.insert(self.starts, at, self.used + np.cumsum(lens) - lens)
        self.lens = np.insert(self.lens, at, lens)
        self.used += total

    def encode(self, data: np.ndarray, offsets: np.ndarray, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds): ids of all texts in a row (each closed by ``end``), bounds of each text in them."""
        if len(self.known) > self.MOST_WORDS or self.used > 16 * self.MOST_WORDS:
            self._clear()
        n = len(offsets) - 1
        s, e, codes, kept, first = self._items(data, offsets)
        distinct, some, which = np.unique(codes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, distinct)
        new = np.ones(len(distinct), bool)
        inside = at < len(self.known)
        new[inside] = self.known[at[inside]] != distinct[inside]
        if new.any():
            lower = self.codes.lower[data].tobytes()
            raw = data.tobytes() if kept.any() else b""
            words = [(raw if kept[i] else lower)[s[i]:e[i]].decode("utf-8", "replace") for i in some[new].tolist()]
            self._learn(distinct[new], words)
            at = np.searchsorted(self.known, distinct)
        lens = self.lens[at].astype(np.int64)[which]
        starts = self.starts[at].astype(np.int64)[which]
        upto = np.concatenate(([0], np.cumsum(lens)))
        more = 0 if end is None else 1
        bounds = np.concatenate(([0], upto[first[1:]] + more * np.arange(1, n + 1)))
        ids = np.full(int(bounds[-1]), 0 if end is None else end, np.int32)
        text_of = np.repeat(np.arange(n), np.diff(first))
        within = np.arange(upto[-1]) - np.repeat(upto[:-1], lens)
        ids[within + np.repeat(upto[:-1] + more * text_of, lens)] = self.flat[within + np.repeat(starts, lens)]
        return ids, bounds


def word_encoder(path: str) -> WordEncoder:
    """The worker's encoder for ``path``, made once."""
    return worker_memo(f"words {path}", lambda: WordEncoder(path))


def byte_encoder(path: str):
    """The worker's byte-level encoder for a rank file, made once."""
    def make():
        import base64

        import public_tokenizers
        import tiktoken
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    return worker_memo(f"bytes {path}", make)
