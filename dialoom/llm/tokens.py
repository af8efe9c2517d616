"""Exact token counts at every prefix of a text, by prefix dynamic programming.

A byte-level BPE merges only inside the pieces that its splitting pattern cuts. Inside a piece the last token of every
prefix is found from the last tokens of shorter ones: a token may follow another if both stay as they are when encoded
together, and of the tokens that end a prefix exactly one may follow the last token of what stands before it. So each
prefix's count is the count of a shorter one plus one, and no prefix is encoded. The tables of pieces add up to that of
the whole text: `PrefixTable.counts[p]` is the number of tokens of the first p code points. Truncation and budgets are
looked up there.

What a prefix is split into can differ from the text's pieces in three places only, and each has its own rule: a run of
white space at its end (one piece), a cut contraction such as 'r of 're, and a cut special string, which is text again.

Null texts are empty: no tokens, nothing to cut. Repeated rows get equal results; empty tables give empty ones. Extra
columns are ignored. A special string inside a text is one token, as the library has it by default (special strings
that hold another one are not provided for). Memory: tables of pieces of at most `cache_chars` characters in all a worker (each
counts 20 more), some twenty bytes a character of the longest text, and slices of `SLICE_BYTES` of text.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Fixed value: the splitting pattern of this family of tokenizers.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SLICE_BYTES = 4 << 20
CACHE_CHARS = 12_000_000
#: Longer pieces are not remembered.
LONG_PIECE = 1000


def byte_alphabet() -> dict[str, int]:
    """Character -> byte in files of byte-level vocabularies: printable Latin-1 characters stand for themselves, the other
    bytes for the characters from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(other)}


class Merges:
    """A byte-level BPE: its tokens, and which may follow which."""

    def __init__(self, model: dict):
        byte = byte_alphabet()
        raw = lambda token: bytes(byte[c] for c in token)
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.rank = {(raw(a), raw(b)): n for n, (a, b) in enumerate(pairs)}
        # token -> {the token before it, b"" at the start: whether it may stand there}, filled when asked for
        self.after: dict[bytes, dict[bytes, bool]] = {raw(t): {} for t in model["vocab"] if all(c in byte for c in t)}
        self.longest = max(map(len, self.after), default=1)

    def encoded(self, data: bytes) -> list[bytes]:
        """data by merging the pair of least rank again and again; for single tokens and pairs of them only."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            least, at = min((self.rank.get(pair, len(self.rank)), i) for i, pair in enumerate(zip(parts, parts[1:])))
            if least == len(self.rank):
                break
            pair, out, i = (parts[at], parts[at + 1]), [], 0
            while i < len(parts):
                both = tuple(parts[i : i + 2]) == pair
                out.append(parts[i] + parts[i + 1] if both else parts[i])
                i += 2 if both else 1
            parts = out
        return parts

    def may_follow(self, last: bytes, token: bytes) -> bool:
        """Whether both stay as they are when encoded together (with last empty: the token alone)."""
        return self.encoded(last + token) == ([last, token] if last else [token])

    def prefix_counts(self, data: bytes) -> list[int]:
        """The number of tokens of each prefix of a piece, from none to all of its bytes."""
        n, after, longest = len(data), self.after, self.longest
        counts, last = [0] * (n + 1), [b""] * (n + 1)
        for i in range(1, n + 1):
            for start in range(i - 1, i - longest - 1 if i > longest else -1, -1):
                token = data[start:i]
                if (known := after.get(token)) is None:
                    continue
                before = last[start]
                if (good := known.get(before)) is None:
                    good = known[before] = self.may_follow(before, token)
                if good:
                    counts[i], last[i] = counts[start] + 1, token
                    break
        return counts


class Counter:
    """Prefix counts of one tokenizer file of the tokenizers library, with remembered pieces."""

    def __init__(self, path: str, cache_chars: int = CACHE_CHARS):
        with open(path, encoding="utf-8") as f:  # a file of the machine's own Python installation
            whole = json.load(f)
        self.merges = Merges(whole["model"])
        self.pieces = regex.compile(PATTERN).findall
        self.is_space = regex.compile(r"\s").match
        specials = sorted((t["content"] for t in whole["added_tokens"]), key=len, reverse=True)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, specials)) + ")") if specials else None
        # piece -> its table as bytes of uint32, in two generations
        self.most, self.held = cache_chars // 2, 0
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def piece(self, text: str) -> bytes:
        """The tokens of each prefix of a piece, from its first code point on, as uint32."""
        got = self.old.get(text)
        if got is None:
            got = self.made(text).tobytes()
        if len(text) <= LONG_PIECE:
            if self.held > self.most:
                self.young, self.old, self.held = {}, self.young, 0
            self.young[text] = got
            self.held += len(text) + 20
        return got

    def made(self, text: str) -> array:
        counts = self.merges.prefix_counts(text.encode())
        if len(counts) > len(text) + 1:
            counts = [counts[i] for i in accumulate((len(c.encode()) for c in text), initial=0)]
        if len(text) == 3 and text[0] == "'" and text[1].isalpha():  # cut after its first letter it is no contraction
            counts[2] = sum(self.merges.prefix_counts(c.encode())[-1] for c in text[:2])
        return array("I", counts[1:])

    def table(self, text: str) -> np.ndarray:
        """Tokens of each prefix of a text without special strings; the first entry is 0."""
        pieces = self.pieces(text)
        counts = np.zeros(len(text) + 1, np.int64)
        if not pieces:
            return counts
        young, made = self.young.get, self.piece
        counts[1:] = np.frombuffer(b"".join([young(p) or made(p) for p in pieces]), np.uint32)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(sizes)
        totals = counts[ends]
        before = np.cumsum(totals) - totals
        counts[1:] += np.repeat(before, sizes)
        # a prefix that ends in a run of white space has that run as one piece, which the text may have as two, or as one and
        # the blank of a word
        for k, p in enumerate(pieces[:-1]):
            if p.isspace() and pieces[k + 1][0].isspace() and self.is_space(p):
                more = 1 if not pieces[k + 1].isspace() else len(pieces[k + 1])
                run = np.frombuffer(self.made(p + pieces[k + 1][:more]), np.uint32)
                counts[ends[k] + 1 : ends[k] + more + 1] = before[k] + run[len(p) :]
        return counts


class PrefixTable:
    """counts[p] is the number of tokens of the first p code points of a text."""

    def __init__(self, counter: Counter, text: str):
        if counter.specials is None or not counter.specials.search(text):
            self.counts = counter.table(text)
            return
        tables, base, plain = [np.zeros(1, np.int64)], 0, ""
        for k, part in enumerate(counter.specials.split(text)):
            if k % 2 == 0:
                own = counter.table(part)
                tables.append(base + own[1:])
                base += int(own[-1])
                plain = part
                continue
            # a cut special string goes on with what stands before it since the last blank
            tail = plain[plain.rfind(" ", 0, len(plain.rstrip())) + 1 :] if plain.strip() else plain
            tail = plain[len(plain) - len(tail) - 1 :] if len(tail) < len(plain) else tail
            start = base - int(counter.table(tail)[-1])
            cut = start + counter.table(tail + part)[len(tail) + 1 :]
            cut[-1] = base + 1
            tables.append(cut)
            base += 1
            plain = ""
        self.counts = np.concatenate(tables)

    @property
    def total(self) -> int:
        return int(self.counts[-1])

    def at(self, p: int) -> int:
        """The number of tokens of the first p code points."""
        return int(self.counts[min(p, len(self.counts) - 1)])

    def longest(self, budget: int) -> int:
        """The most leading code points that take at most budget tokens."""
        return int(np.flatnonzero(self.counts <= budget)[-1])


_counters: dict[tuple[str, int], Counter] = {}


def counter(path: str, cache_chars: int = CACHE_CHARS) -> Counter:
    """This worker's counter for the file."""
    if (path, cache_chars) not in _counters:
        _counters[path, cache_chars] = Counter(path, cache_chars)
    return _counters[path, cache_chars]


def counts(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024, cache_chars: int = CACHE_CHARS) -> DataFrame:
    """id_col, n_bytes, n_tokens, over_limit and fit_chars (the most leading code points within limit tokens) of each
    row, all looked up in the text's prefix table."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(tokenizer_path, cache_chars)
        for b in slices(batches, "t", SLICE_BYTES):
            tokens, fit = [], []
            for text in b.column(1).to_pylist():
                table = PrefixTable(c, text or "")
                tokens.append(table.total)
                fit.append(len(table.counts) - 1 if table.total <= limit else table.longest(limit))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens]), pa.array(fit, pa.int64())], names=[id_col, "n_bytes", "n_tokens", "over_limit", "fit_chars"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    slim = docs.select(F.col(id_col).alias("k"), text.alias("t"), F.octet_length(text).cast("long").alias("n"))
    return slim.mapInArrow(scan, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean, fit_chars long")
