"""Per-session state over batches: turn counters, profiles of first-seen values, segments between resets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def segments(rows: DataFrame, session: str, order: list[str], reset: Column) -> DataFrame:
    """rows with segment: the number of resets up to and with the row."""
    w = Window.partitionBy(session).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("segment", F.sum(reset.cast("int")).over(w))


def profiles(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """rows with turn (1, 2, …) and profile: the distinct values so far, in the order first seen. Only first
    occurrences enter the running list, so a list is never longer than the number of distinct values."""
    w = Window.partitionBy(*keys).orderBy(*order)
    seen = Window.partitionBy(*keys, value).orderBy(*order)
    first = rows.withColumn("_first", F.when((F.row_number().over(seen) == 1) & F.col(value).isNotNull(), F.col(value)))
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    return first.withColumn("turn", F.row_number().over(w)).withColumn("profile", F.collect_list("_first").over(running)).drop("_first")
