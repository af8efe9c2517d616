"""Quality classifier: regularised quadratic discriminant analysis over transformed document statistics.

Each text becomes a few statistics of its bytes and words, on log or root scales. For each label the mean and the
covariance are fitted from sums over all labelled rows (nothing is sampled): the covariance is shrunk towards the pooled
one and its diagonal. A row's score is the logistic function of the difference of the labels' log densities, from
Mahalanobis distances by Cholesky factors that are computed once on the driver, plus the log of the prior odds.

Null and empty texts have the statistics of an empty text and get a score like any other. Rows without a label, and
labels without a document, are not used to learn. Labels repeated for a row count each. Without rows of both labels the
score is the share of label 1 (0.5 without any). Extra columns are ignored by `scores` and kept by `accepted`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytescan import SPACED, Words, text_bytes
from .common import released, slices, stored

SLICE_BYTES = 1 << 19
THRESHOLD = 0.3
#: Shrinkage towards the pooled covariance, and towards its diagonal.
POOL, DIAGONAL = 0.1, 0.05


def _class(*chars: str) -> np.ndarray:
    out = np.zeros(256, np.uint8)
    for c in chars:
        out[np.frombuffer(c.encode("latin-1"), np.uint8)] = 1
    return out


UPPER = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
DIGIT = _class("0123456789")
SPACE = _class(" \t\n\r\x0b\x0c")
LINE = _class("\n")
STOP = _class(".,;:")
LOUD = _class("!?")
ODD = _class("#$%&*+/<=>@[\\]^_`{|}~\"'()-")
CLASSES = (UPPER, DIGIT, SPACE, LINE, STOP, LOUD, ODD)
#: Statistics of short texts are drawn towards plain prose, as if PRIOR_BYTES and PRIOR_WORDS of it stood before them:
#: its share of each class, mean and variance of word lengths, shares of short, one-letter and distinct words.
PRIOR_BYTES, PRIOR_WORDS = 60, 10
PROSE = (0.03, 0.005, 0.15, 0.005, 0.03, 0.001, 0.005)
PROSE_LENGTH, PROSE_VARIANCE, PROSE_SHORT, PROSE_LONE, PROSE_DISTINCT = 5.5, 9.0, 0.4, 0.02, 0.9
N_STATS = len(CLASSES) + 7


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of N_STATS transformed statistics for each text."""
    words = Words(texts, SPACED)
    raw, start, end = text_bytes(texts)
    n = (end - start).astype(float)
    shares = []
    for c, usual in zip(CLASSES, PROSE, strict=True):
        total = np.concatenate(([0], np.cumsum(c[raw], dtype=np.int64)))
        shares.append(np.sqrt((total[end] - total[start] + PRIOR_BYTES * usual) / (n + PRIOR_BYTES)))
    count = words.counts.astype(float)
    length = (words.end - words.start).astype(float)
    by_text = lambda w: np.bincount(words.text, weights=w, minlength=words.n_texts)
    order = np.lexsort((words.hash, words.text))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (words.hash[order][1:] != words.hash[order][:-1]) | (words.text[order][1:] != words.text[order][:-1])
    distinct = np.bincount(words.text[order][fresh], minlength=words.n_texts)
    some = count + PRIOR_WORDS
    mean = (by_text(length) + PRIOR_WORDS * PROSE_LENGTH) / some
    square = (by_text(length**2) + PRIOR_WORDS * (PROSE_LENGTH**2 + PROSE_VARIANCE)) / some
    spread = np.sqrt(np.maximum(square - mean**2, 0))
    short = (by_text((length <= 3).astype(float)) + PRIOR_WORDS * PROSE_SHORT) / some
    lone = (by_text((length == 1).astype(float)) + PRIOR_WORDS * PROSE_LONE) / some
    varied = (distinct + PRIOR_WORDS * PROSE_DISTINCT) / some
    gross = (n + PRIOR_WORDS * (PROSE_LENGTH + 1)) / some
    return np.column_stack([*shares, np.log1p(count), np.log1p(mean), np.log1p(spread), np.sqrt(short), np.sqrt(lone), np.sqrt(varied), np.log1p(gross)])


@dataclass
class Discriminant:
    """The fitted model: for each of labels 0 and 1 the mean, the inverse Cholesky factor, half the log determinant and
    the log prior; or only a constant score."""

    means: np.ndarray | None
    whiten: np.ndarray | None
    half_log_det: np.ndarray | None
    log_prior: np.ndarray | None
    constant: float = 0.5

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.means is None:
            return np.full(len(x), self.constant)
        logs = [self.log_prior[k] - self.half_log_det[k] - 0.5 * (((x - self.means[k]) @ self.whiten[k].T) ** 2).sum(1) for k in (0, 1)]
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def fit_sums(sums: dict[int, tuple[float, np.ndarray, np.ndarray]], pool: float = POOL, diagonal: float = DIAGONAL) -> Discriminant:
    """sums: label -> (rows, sum of statistics, sum of their outer products)."""
    total = sum(s[0] for s in sums.values())
    if any(k not in sums or sums[k][0] < 2 for k in (0, 1)):
        return Discriminant(None, None, None, None, sums[1][0] / total if 1 in sums and total else (0.0 if total else 0.5))
    means = np.array([sums[k][1] / sums[k][0] for k in (0, 1)])
    scatter = np.array([sums[k][2] - sums[k][0] * np.outer(means[k], means[k]) for k in (0, 1)])
    pooled = scatter.sum(0) / total
    whiten, dets = [], []
    for k in (0, 1):
        cov = (1 - pool) * scatter[k] / sums[k][0] + pool * pooled
        cov = (1 - diagonal) * cov + diagonal * np.diag(np.diag(cov)) + 1e-6 * np.eye(len(cov))
        chol = np.linalg.cholesky(cov)
        whiten.append(np.linalg.inv(chol))
        dets.append(np.log(np.diag(chol)).sum())
    return Discriminant(means, np.array(whiten), np.array(dets), np.log([sums[k][0] / total for k in (0, 1)]))


def with_statistics(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id_col and stats (array<double>) of each row, stored."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "t", SLICE_BYTES):
            x = statistics(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * N_STATS, x.ravel())], names=[id_col, "stats"])

    slim = docs.select(F.col(id_col).alias("k"), F.col(text_col).cast("string").alias("t"))
    return stored(slim.mapInArrow(released(scan), f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, stats array<double>"), "quality")


def held_out(id_col: Column, folds: int = 5, fold: int = 0) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds == fold, F.lit(False))


def fit(stats: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", label_col: str = "quality") -> Discriminant:
    """The model from all labelled rows that are not held out. What reaches the driver are two rows of sums."""
    known = labels.select(F.col(id_col).alias("k"), F.col(label_col).cast("int").alias("y")).where("y IN (0, 1)").where(~held_out(F.col("k")))
    rows = stats.join(known, stats[id_col] == known["k"]).select("y", "stats")

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for b in batches:
            if b.num_rows:
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, N_STATS)
                y = b.column(0).to_numpy(zero_copy_only=False)
                for k in np.unique(y).tolist():
                    own, s = x[y == k], sums.setdefault(k, [0.0, np.zeros(N_STATS), np.zeros((N_STATS, N_STATS))])
                    s[0] += len(own)
                    s[1] += own.sum(0)
                    s[2] += own.T @ own
        for k, (n, one, two) in sums.items():
            flat = np.concatenate(([n], one, two.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(flat), pa.int32()), pa.array(range(len(flat)), pa.int32()), pa.array(flat)], names=["y", "i", "v"])

    added = rows.mapInArrow(released(partial), "y int, i int, v double").groupBy("y", "i").agg(F.sum("v").alias("v"))
    got: dict[int, np.ndarray] = {}
    for r in added.collect():
        got.setdefault(r["y"], np.zeros(1 + N_STATS + N_STATS**2))[r["i"]] = r["v"]
    return fit_sums({k: (v[0], v[1 : N_STATS + 1], v[N_STATS + 1 :].reshape(N_STATS, N_STATS)) for k, v in got.items()})


def scores(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """id_col, held_out, score, predicted of each row."""
    stats = with_statistics(docs, id_col, text_col)
    model = fit(stats, labels, id_col=id_col, label_col=label_col)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                s = model.score(b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, N_STATS))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[id_col, "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    return stats.mapInArrow(released(scan), f"`{id_col}` {kind}, score double, predicted int").select(id_col, held_out(F.col(id_col)).alias("held_out"), "score", "predicted")


def accepted(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD, broadcast_rows: int = 500_000) -> DataFrame:
    """The rows of docs, all columns, whose score is at least threshold. Only labelled rows are measured to learn; if
    there are more than broadcast_rows labels, all rows are, as their texts would have to move else."""
    ids = labels.select(F.col(id_col).alias("k")).where(F.col("k").isNotNull() & ~held_out(F.col("k"))).distinct()
    own = docs.join(F.broadcast(ids), docs[id_col] == ids["k"], "left_semi") if ids.count() <= broadcast_rows else docs
    model = fit(with_statistics(own, id_col, text_col), labels, id_col=id_col, label_col=label_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text_col, SLICE_BYTES):
            yield b.filter(pc.greater_equal(pa.array(model.score(statistics(b.column(b.schema.get_field_index(text_col))))), threshold))

    return docs.mapInArrow(released(keep), docs.schema)
