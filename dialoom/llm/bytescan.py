"""Vectorised scans of UTF-8 text columns: words, their hashes and runs of words, with numpy over Arrow's own buffers.

All word classes used here are unions of ASCII ranges and "every byte from 0x80", so that words of the bytes are
the words of the code points.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_STEP = 0xD6E8FEB86659FD93
_powers: dict[str, np.ndarray] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words of [^\x20\x09-\x0D]+
SPACED = np.ones(256, bool)
SPACED[[0x20, 9, 10, 11, 12, 13]] = False
#: Words of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ in lower-cased text
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, modulo 2**64."""
    if not _powers or len(_powers["up"]) < n:
        size = max(n, 1 << 20)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _powers[name] = np.multiply.accumulate(a)
    return _powers["up"][:n], _powers["down"][:n]


def text_bytes(arr: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start, end) of a string or binary array; nulls are empty. Positions count from the array's first byte."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    offsets = np.frombuffer(arr.buffers()[1], np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64) if len(arr) else np.zeros(1, np.int64)
    data = arr.buffers()[2] if len(arr) else None
    buf = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    start, end = offsets[:-1] - offsets[0], offsets[1:] - offsets[0]
    if arr.null_count:
        end = np.where(np.asarray(arr.is_valid()), end, start)
    return buf, start, end


def step(j: int) -> np.uint64:
    """The factor of the j-th word of a run."""
    return np.uint64(pow(_STEP, j, 1 << 64))


class Words:
    """The words of each text: byte spans, text number and 64-bit hash, in order."""

    def __init__(self, arr: pa.Array, word: np.ndarray):
        raw, self.text_start, self.text_end = text_bytes(arr)
        self.n_texts = len(self.text_start)
        self.buf = b = LOWER[raw]
        n = len(b)
        is_word = word[b]
        if arr.null_count:
            for i in np.flatnonzero(self.text_end < np.append(self.text_start[1:], n)):
                is_word[self.text_end[i] : self.text_start[i + 1] if i + 1 < self.n_texts else n] = False
        new = np.zeros(n + 1, bool)
        new[self.text_start] = True
        new[n] = True
        before = np.empty(n + 1, bool)
        before[0] = False
        before[1:] = is_word
        here = np.append(is_word, False)
        self.start = np.flatnonzero(here & (~before | new))
        self.end = np.flatnonzero(before & (~here | new))
        self.text = np.searchsorted(self.text_start, self.start, "right") - 1
        up, down = powers(n + 1)
        prefix = np.zeros(n + 1, np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[:n], out=prefix[1:])
        self.hash = mix((prefix[self.end] - prefix[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64))
        self.counts = np.bincount(self.text, minlength=self.n_texts)
        self.first = np.concatenate(([0], np.cumsum(self.counts)))[:-1]

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of first word, hash) of each run of n words inside one text."""
        m = len(self.hash) - n + 1
        if m <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        h = np.zeros(m, np.uint64)
        for j in range(n):
            h += self.hash[j : j + m] * step(j)
        at = np.flatnonzero(self.text[:m] == self.text[n - 1 :])
        return at, mix(h[at])

    def sequences(self, texts: np.ndarray) -> np.ndarray:
        """Hash of the whole word sequence of each given text of less than some few words."""
        out = np.zeros(len(texts), np.uint64)
        for i, t in enumerate(texts):
            own = self.hash[self.first[t] : self.first[t] + self.counts[t]]
            out[i] = np.sum(own * np.array([step(j) for j in range(len(own))], np.uint64), dtype=np.uint64)
        return mix(out + np.uint64(0x51ED270B))

    def joined(self, first: int, n: int) -> bytes:
        """n words from the given one, joined by a blank."""
        return b" ".join(self.buf[s:e].tobytes() for s, e in zip(self.start[first : first + n], self.end[first : first + n], strict=True))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w consecutive values; as many as there are such windows."""
    have, out = 1, x
    while have < w:
        add = min(have, w - have)
        out = np.minimum(out[: len(out) - add], out[add:])
        have += add
    return out
