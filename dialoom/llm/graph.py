"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gathered, keyed, lookup, stored_with

Keyed = tuple[DataFrame, int, int]


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The components of the edges a, b that one task holds, as edges (node, least node) for all but the least nodes."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while (label[x] != label[y]).any():
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        while (label[label] != label).any():
            label = label[label]
    led = label != np.arange(len(nodes))
    return nodes[led], nodes[label[led]]


def _edges(pairs: DataFrame, rows: int | None = None) -> tuple[DataFrame, tuple]:
    """Distinct u > v, stored, with their number and the sum of their hashes; rows is the most that pairs can have."""
    e = pairs.where("u <> v").distinct()
    e, seen = stored_with(e if rows is None else gathered(e, rows), "edges", F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40))).alias("s"))
    return e, (seen["n"], seen["s"])


def _least(pairs: DataFrame, rows: int) -> Keyed:
    """u, m (the least v or u itself), key_rows (the number of its pairs) of pairs, of which there are at most rows."""
    return keyed(gathered(pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("key_rows")).withColumn("m", F.least("u", "m")), rows), "least")


def components(edges: DataFrame, a: str, b: str, rows: int | None = None) -> DataFrame:
    """node, root (the least node of its component) for every node of an edge between different nodes. Each round is
    written to the shared folder; the number of rounds is about the logarithm of the longest path. The centre of a star
    may have any number of edges: see lookup. Edges that are stars already, as tasks should give them, need half a round.
    rows is the most that edges can have, if known; of later rounds it is known, so that few edges are few tasks."""
    e, state = _edges(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")), rows)
    while state[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _least(both, 2 * state[0])
        # larger neighbours, and the node itself, go to the least neighbour
        large = lookup(both.where("v > u"), least, ["u"]).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large, grouped = _edges(large.unionByName(least[0].select("u", F.col("m").alias("v"))), 3 * state[0])
        if grouped == state:  # stars only
            break
        low = _least(large, grouped[0])
        # smaller neighbours, and the node itself, go to the least one
        small = lookup(large, low, ["u"]).select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        before = state
        e, state = _edges(small.unionByName(low[0].select("u", F.col("m").alias("v"))), 2 * grouped[0])
        if state == before:
            break
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
