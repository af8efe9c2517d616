"""Language identification by rank-order profiles.

A profile is the list of the `RANKS` most frequent letter n-grams (one to three letters, words padded with blanks). A
text's own list is compared with each language's by out-of-place distance: for each of its n-grams the difference of the
two ranks, or `RANKS` if the profile lacks it. The nearest language wins, the first by code points among equals.

Profiles are learned from labelled rows that are not held out; of a language with more than `sample_rows` of them, a
share chosen by hash of the id so that about `sample_rows` remain (a documented bound of the fit; all rows are
predicted, over their whole texts).

Null texts and texts without a letter are `und` with score 0. Rows with a null language teach nothing. Without any
profile all are `und`. Repeated rows get equal results; extra columns are ignored. The score is d2 / (d1 + d2) of the
two least distances (1 if only one language is known).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices

RANKS = 300
SLICE_BYTES = 1 << 20
SAMPLE_ROWS = 2000
UNKNOWN = "und"
_BLANK = (1 << 21) - 1  # no code point, and not the absence of one
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams packed in 63 bits, counts) of a text; none without a letter."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    code = np.where(letters()[code], code, 0).astype(np.int64)
    code = np.concatenate(([0], code, [0]))
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] != 0) | (code[:-1] != 0)
    code = code[keep]
    if not code.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    letter = code > 0
    code = np.where(letter, code, _BLANK)
    two = code[:-1] | code[1:] << 21
    three = two[:-1] | code[2:] << 42
    return np.unique(np.concatenate([code[letter], two, three[letter[1:-1]]]), return_counts=True)


def ranked(packed: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The RANKS most frequent n-grams, the most frequent first, ties by n-gram."""
    if len(counts) > RANKS:  # only those that can be among them need sorting
        least = np.partition(counts, len(counts) - RANKS)[len(counts) - RANKS]
        packed, counts = packed[counts >= least], counts[counts >= least]
    return packed[np.argsort(-counts, kind="stable")[:RANKS]]


class Profiles:
    """Rank of each n-gram in each language, and distances to a text's list."""

    def __init__(self, lists: dict[str, np.ndarray]):
        self.names = sorted(lists)
        self.vocabulary = np.unique(np.concatenate([*lists.values(), np.zeros(0, np.int64)])).astype(np.int64)
        self.rank = np.full((len(self.names), len(self.vocabulary) + 1), -1, np.int64)
        for k, name in enumerate(self.names):
            self.rank[k, np.searchsorted(self.vocabulary, lists[name])] = np.arange(len(lists[name]))

    def predict(self, text: str | None) -> tuple[str, float]:
        mine = ranked(*grams(text)) if text else np.zeros(0, np.int64)
        if not len(mine) or not self.names:
            return UNKNOWN, 0.0
        at = np.searchsorted(self.vocabulary, mine)
        known = at < len(self.vocabulary)
        known[known] = self.vocabulary[at[known]] == mine[known]
        at = np.where(known, at, len(self.vocabulary))
        rank = self.rank[:, at]
        distance = np.where(rank < 0, RANKS, np.abs(rank - np.arange(len(mine)))).sum(1)
        best = int(distance.argmin())
        if len(distance) == 1:
            return self.names[0], 1.0
        d1, d2 = np.partition(distance, 1)[:2].tolist()
        return self.names[best], d2 / (d1 + d2) if d1 + d2 else 0.5


def held_out(id_col):
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> Profiles:
    """Profiles of all languages of docs. The driver gets RANKS rows for each language."""
    known = docs.select(F.col(id_col).alias("k"), F.col(lang_col).cast("string").alias("l"), F.col(text_col).cast("string").alias("t")).where(F.col("l").isNotNull() & F.col("t").isNotNull() & ~held_out(F.col("k")))
    share = known.groupBy("l").agg((F.lit(float(sample_rows)) / F.count("*")).alias("share")).collect()
    limits = F.create_map(*[F.lit(x) for r in share for x in (r["l"], int(min(1.0, r["share"]) * (1 << 30)))]) if share else None
    if limits is None:
        return Profiles({})
    sample = known.where(F.pmod(F.xxhash64(F.col("k").cast("string")), F.lit(1 << 30)) < limits[F.col("l")]).select("l", "t")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "t", SLICE_BYTES):
            parts: dict[str, list] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                parts.setdefault(lang, []).append(grams(text))
            for lang, got in parts.items():
                packed, where = np.unique(np.concatenate([g for g, _ in got]), return_inverse=True)
                n = np.bincount(where, weights=np.concatenate([c for _, c in got]), minlength=len(packed)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(packed), pa.string()), pa.array(packed), pa.array(n)], names=["l", "g", "n"])

    summed = sample.mapInArrow(count, "l string, g long, n long").groupBy("l", "g").agg(F.sum("n").alias("n"))
    top = summed.withColumn("r", F.row_number().over(Window.partitionBy("l").orderBy(F.desc("n"), "g"))).where(F.col("r") <= RANKS)
    lists: dict[str, list] = {}
    for r in top.select("l", "r", "g").collect():
        lists.setdefault(r["l"], []).append((r["r"], r["g"]))
    return Profiles({k: np.array([g for _, g in sorted(v)], np.int64) for k, v in lists.items()})


def predict(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS, profiles: Profiles | None = None) -> DataFrame:
    """id_col, held_out, lang_pred, score of each row."""
    known = profiles or learn(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, sample_rows=sample_rows)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "t", SLICE_BYTES):
            got = [known.predict(t.as_py()) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=[id_col, "held_out", "lang_pred", "score"])

    slim = docs.select(F.col(id_col).alias("k"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string").alias("t"))
    return slim.mapInArrow(scan, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, held_out boolean, lang_pred string, score double")
