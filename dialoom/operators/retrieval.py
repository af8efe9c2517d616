"""Scores of vectors against vectors, in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 2048


def _blocks(vectors: DataFrame, id_col: str, vector_col: str, prefix: str) -> DataFrame:
    """ids and vectors of up to BLOCK_ROWS rows each; rows without an id or a vector are left out."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, BLOCK_ROWS):
                part = b.slice(at, BLOCK_ROWS)
                flat = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_numpy().astype(np.int64).tobytes()], pa.binary()), pa.array([flat.tobytes()], pa.binary())], names=[f"{prefix}_ids", f"{prefix}_vectors"])

    slim = vectors.select(F.col(id_col).cast("long").alias("i"), F.col(vector_col).alias("v")).where("i IS NOT NULL AND v IS NOT NULL")
    return slim.mapInArrow(pack, f"{prefix}_ids binary, {prefix}_vectors binary")


def nearest(queries: DataFrame, base: DataFrame, id_col: str, vector_col: str, k: int, broadcast_rows: int = 100_000) -> DataFrame:
    """query_id, id, score (dot product, six decimals), place of the k best of base for each query, itself left out;
    of equal scores the least id. Blocks of queries meet blocks of base as matrices; each meeting keeps k rows a query,
    so that what is shuffled does not grow with base times queries. Blocks of queries are sent to all tasks if their rows,
    which are counted, are few."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for q_ids, q_vectors, ids, vectors in zip(*(b.column(c).to_pylist() for c in ("q_ids", "q_vectors", "b_ids", "b_vectors")), strict=True):
                asked, known = np.frombuffer(q_ids, np.int64), np.frombuffer(ids, np.int64)
                scores = np.round(np.frombuffer(q_vectors).reshape(len(asked), -1) @ np.frombuffer(vectors).reshape(len(known), -1).T, 6)
                scores[asked[:, None] == known[None, :]] = -np.inf
                least = np.partition(scores, -k, axis=1)[:, -k] if k < len(known) else np.full(len(asked), -np.inf)
                row, col = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
                yield pa.RecordBatch.from_arrays([pa.array(asked[row]), pa.array(known[col]), pa.array(scores[row, col])], names=["query_id", "id", "score"])

    asked = _blocks(queries, id_col, vector_col, "q")
    sent = F.broadcast(asked) if queries.count() <= broadcast_rows else asked
    near = _blocks(base, id_col, vector_col, "b").crossJoin(sent).mapInArrow(best, "query_id long, id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return near.withColumn("place", place).where(F.col("place") <= k)
