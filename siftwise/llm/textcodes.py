"""Whole texts of an Arrow batch as numpy arrays: words, word codes and shingle codes.

Works on the UTF-8 bytes of many texts at once; no Python object per word.  Codes
are 64-bit: a polynomial over the lower-cased bytes (odd base, so prefix sums can be
shifted back), finished by a bit mixer.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15          # odd: invertible modulo 2**64
SHINGLE_ODD = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64 finalizer, element by element."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    import pyarrow as pa

    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    a = a.cast(pa.large_binary()) if not pa.types.is_large_binary(a.type) else a
    if a.null_count:
        a = a.fill_null(b"")
    _, off, data = a.buffers()
    offsets = np.frombuffer(off, np.int64, len(a) + 1, a.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int):
    """Consecutive runs (i, j) of texts of at most ``most`` bytes together (one text alone may be longer)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j


class Codes:
    """Powers of the base and the byte tables, made once per task."""

    def __init__(self):
        self.space = np.zeros(256, bool)
        self.space[[32, 9, 10, 11, 12, 13]] = True
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32
        self.pow = self.inv = np.ones(1, U64)

    def _powers(self, n: int) -> None:
        if len(self.pow) < n:
            n = max(n, 1 << 20)
            step = np.full(n, BASE, U64)
            back = np.full(n, pow(BASE, -1, 1 << 64), U64)
            step[0] = back[0] = 1
            self.pow, self.inv = np.cumprod(step), np.cumprod(back)

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ends, first): byte spans of the words of all texts, and the index of each text's first word."""
        solid = ~self.space[data]
        n = len(data)
        start, end = solid.copy(), solid.copy()
        if n:
            start[1:] &= ~solid[:-1]
            end[:-1] &= ~solid[1:]
            inner = offsets[1:-1]
            inner = inner[(inner > 0) & (inner < n)]
            start[inner] = solid[inner]
            end[inner - 1] = solid[inner - 1]
        starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
        return starts, ends, np.searchsorted(starts, offsets)

    def word_codes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if not len(starts):
            return np.zeros(0, U64)
        self._powers(len(data) + 1)
        sums = np.empty(len(data) + 1, U64)
        sums[0] = 0
        np.cumsum((self.lower[data].astype(U64) + U64(1)) * self.pow[:len(data)], out=sums[1:])
        return mix64((sums[ends] - sums[starts]) * self.inv[starts] + (ends - starts).astype(U64))

    def shingles(self, data: np.ndarray, offsets: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
        """(codes, first): the distinct ``k``-word shingle codes of each text, ascending within a text.

        A text of fewer words has one shingle of all its words; one without words has none."""
        starts, ends, first = self.words(data, offsets)
        w = self.word_codes(data, starts, ends)
        parts, sizes = [], np.zeros(len(offsets) - 1, np.int64)
        if len(w) >= k:
            m = len(w) - k + 1
            run = w[:m] * U64(SHINGLE_ODD[0])
            for j in range(1, k):
                run = run + w[j:j + m] * U64(SHINGLE_ODD[j % 5] + 2 * (j // 5))
            run = mix64(run)
        for i in range(len(sizes)):
            a, b = first[i], first[i + 1]
            if b - a >= k:
                s = np.sort(run[a:b - k + 1])
                s = s[np.concatenate(([True], s[1:] != s[:-1]))] if len(s) > 1 else s
            elif b > a:
                odd = np.array([SHINGLE_ODD[j % 5] + 2 * (j // 5) for j in range(b - a)], U64)
                s = mix64((w[a:b] * odd).sum(dtype=U64, keepdims=True) + np.array([b - a], U64) * U64(0xC2B2AE3D27D4EB4F))
            else:
                continue
            sizes[i] = len(s)
            parts.append(s)
        codes = np.concatenate(parts) if parts else np.zeros(0, U64)
        return codes, np.concatenate(([0], np.cumsum(sizes)))
