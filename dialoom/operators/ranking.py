"""Ranked lists against gold titles: popularity, metrics by instance and conversation, fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def popularity(interactions: DataFrame, n: int, order: list[str]) -> DataFrame:
    """title, n, rank of the n most frequent titles; of equally frequent ones the first to occur by order, then by title; blank ones
    dropped."""
    counted = interactions.where("title <> ''").groupBy("title").agg(F.count("*").alias("n"), F.min(F.struct(*order)).alias("first"))
    top = counted.orderBy(F.desc("n"), "first", "title").limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "first", "title"))).drop("first")


def matches(gold: DataFrame, ranked: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct gold titles of each instance with the rank at which a list for all (title, rank) has them, else null.
    The list is one row a rank; Spark broadcasts it by its size."""
    return gold.select(*keys, "title").distinct().join(ranked.select("title", "rank"), "title", "left")


def at_most(k: int) -> Column:
    return F.coalesce(F.col("rank") <= k, F.lit(False))


def gain(k: int) -> Column:
    """Discounted gain of the matches up to rank k."""
    return F.sum(F.when(at_most(k), F.lit(1.0) / F.log2(F.col("rank") + F.lit(1.0))).otherwise(F.lit(0.0)))


def ideal_gain(n: Column, k: int) -> Column:
    """The gain of n gold titles, duplicates counted, at ranks 1 to n or k."""
    return F.aggregate(F.sequence(F.lit(1), F.least(n.cast("int"), F.lit(k))), F.lit(0.0), lambda acc, i: acc + F.lit(1.0) / F.log2(i + F.lit(1.0)))


def instance_metrics(found: DataFrame, keys: list[str], ks: tuple[int, ...]) -> DataFrame:
    """keys, n_gold, first_rank (0: not found), and hit, precision and dcg at each k, from matches."""
    cols = [F.count("*").alias("n_gold"), F.coalesce(F.min("rank"), F.lit(0)).alias("first_rank")]
    for k in ks:
        cols += [F.max(at_most(k).cast("int")).alias(f"hit_{k}"), (F.count(F.when(at_most(k), 1)) / F.lit(float(k))).alias(f"precision_{k}"), gain(k).alias(f"dcg_{k}")]
    return found.groupBy(*keys).agg(*cols).withColumn("mrr", F.when(F.col("first_rank") > 0, F.lit(1.0) / F.col("first_rank")).otherwise(F.lit(0.0)))


def fused(base: DataFrame, extra: DataFrame, by: list[str], *, preserved: int, most_extra: int, top_k: int, same: str = "title") -> DataFrame:
    """base (by, id, title, rank) with up to most_extra rows of extra (by, id, title, pos) that are new by id and by same
    (a column of both) set in after the first `preserved` ones; renumbered and cut to top_k."""
    new = extra.join(base.select(*by, "id"), [*by, "id"], "left_anti").join(base.select(*by, same), [*by, same], "left_anti")
    # the first of equal ids, then of equal titles
    for col in ("id", same):
        new = new.withColumn("_n", F.row_number().over(Window.partitionBy(*by, col).orderBy("pos"))).where("_n = 1").drop("_n")
    new = new.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("pos"))).where(F.col("_n") <= most_extra)
    rows = base.select(*by, "id", "title", F.when(F.col("rank") <= preserved, 0).otherwise(2).alias("block"), F.col("rank").alias("at")).unionByName(new.select(*by, "id", "title", F.lit(1).alias("block"), F.col("_n").alias("at")))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("block", "at"))).where(F.col("rank") <= top_k).drop("at")
