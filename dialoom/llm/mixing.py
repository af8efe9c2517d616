"""Mixing sources to target weights by hash-threshold histograms, with DataFrame operations only.

Every document has a fixed place between 0 and 2**40, from a hash of its id. A source that shall give T of its S words
gives each document floor(T / S) times, and once more the documents below a threshold chosen so that their words come
nearest to the rest T - floor(T / S) * S. The threshold is found without sorting documents: words are summed by source
and 1,024 hash ranges, the range holding the budget is split into 1,024 again, and only the documents of that range are
looked at one by one. Thresholds are nested: a larger budget keeps what a smaller one took.

Weights are dealt to sources in order of code points, nulls last, repeating. Targets share `share` of all words; one
that passes `most` times its source's words stops there and the excess goes to the others by weight.

Null texts have no words; a null source is a source of its own; rows with equal ids share one place and one decision;
an empty table gives an empty result. Extra columns are ignored. The table of sources has a row for each source and is
sent to all executors only if it has at most `broadcast_rows` rows, and joined by shuffle else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import counted_lookup, stored, unused

RANGES, BITS = 1024, 40


def word_count(text: Column) -> Column:
    r"""The number of [^\x20\x09-\x0D]+ in text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def place(key: Column) -> Column:
    """A fixed hash of key, from 0 to 2**40 - 1."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 10), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """source, source_size, target: shares by weight, none above most times its size. Closed form of handing on excess:
    with sources in order of size / weight, those before the first that its share doesn't fill are full."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    nth = F.array(*[F.lit(float(w)) for w in weights])
    weighed = sizes.withColumn("w", F.element_at(nth, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    by_fill = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())
    all_rows = Window.partitionBy()
    full = (
        weighed.withColumn("before", F.coalesce(F.sum("source_size").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("w_left", F.sum("w").over(all_rows) - F.coalesce(F.sum("w").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("level", (F.sum("source_size").over(all_rows) * F.lit(float(share)) - F.lit(float(most)) * F.col("before")) / F.col("w_left"))
        .withColumn("open", F.col("level") * F.col("w") < F.lit(float(most)) * F.col("source_size"))
    )
    level = F.min(F.when(F.col("open"), F.struct(F.col("source_size") / F.col("w"), F.col("level").alias("level")))).over(all_rows)["level"]
    return full.withColumn("l", level).select("source", "source_size", F.least(F.lit(float(most)) * F.col("source_size"), F.coalesce(F.col("l") * F.col("w"), F.lit(float(most)) * F.col("source_size"))).alias("target"))


def boundary(sums: DataFrame, at: str) -> DataFrame:
    """Of sums (source, at, n) and each source's budget left: the last range that starts at or below the budget, and
    what is left of it there."""
    w = Window.partitionBy("source").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    return (
        sums.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))
        .where(F.col("before") <= F.col("rest"))
        .groupBy("source", "rest")
        .agg(F.max(F.struct(F.col(at), F.col("before"))).alias("b"))
        .select("source", F.col(f"b.{at}").alias(at), (F.col("rest") - F.col("b.before")).alias("rest"))
    )


def thresholds(sized: DataFrame, budgets: DataFrame, broadcastable: bool) -> DataFrame:
    """source, cut: documents with place < cut are taken once more. sized: source, size, place; budgets: source, rest."""
    small = F.broadcast if broadcastable else (lambda d: d)
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    coarse = sized.groupBy("source", F.floor(F.col("place") / (1 << BITS - 10)).alias("r1")).agg(F.sum("size").alias("n"))
    first = boundary(coarse.join(small(budgets), same(coarse, budgets)).select(coarse["source"], "r1", "n", "rest"), "r1")
    inside = sized.withColumn("r1", F.floor(F.col("place") / (1 << BITS - 10)))
    inside = inside.join(small(first), same(inside, first) & (inside["r1"] == first["r1"])).select(inside["source"], "size", "place", inside["r1"], "rest")
    fine = inside.groupBy("source", "rest", F.floor(F.col("place") / (1 << BITS - 20)).alias("r2")).agg(F.sum("size").alias("n"))
    second = boundary(fine, "r2")
    last = sized.withColumn("r2", F.floor(F.col("place") / (1 << BITS - 20)))
    last = last.join(small(second), same(last, second) & (last["r2"] == second["r2"])).select(last["source"], "size", "place", "rest")
    each = last.groupBy("source", "rest", "place").agg(F.sum("size").alias("n"))
    w = Window.partitionBy("source").orderBy("place")
    upto = F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))
    # the threshold stands behind the place where the running sum is nearest to the budget, or before the first one
    return (
        each.withColumn("upto", upto)
        .withColumn("takes", (F.col("upto") - F.col("rest")) < (F.col("rest") - (F.col("upto") - F.col("n"))))
        .groupBy("source")
        .agg(F.max(F.when(F.col("takes"), F.col("place") + 1)).alias("taken"), F.min("place").alias("first"))
        .select("source", F.coalesce("taken", "first").alias("cut"))
    )


def planned(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[float, ...], share: float, most: float, broadcast_rows: int) -> tuple[DataFrame, DataFrame, bool]:
    """(sized, plan, few): k, source, size, place of each row; s, source_size, target, times, cut of each source, which
    are the whole decision: a row is taken `times` times, and once more if its place is below `cut`; whether there are
    at most broadcast_rows sources."""
    sized = stored(docs.select(F.col(id_col).alias("k"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), place(F.col(id_col)).alias("place")), "mix")
    sizes = stored(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    few = sizes.count() <= broadcast_rows
    goal = targets(sizes, weights, share, most)
    goal = goal.withColumn("times", F.coalesce(F.floor(F.col("target") / F.nullif("source_size", F.lit(0))), F.lit(0)).cast("long"))
    budgets = stored(goal.withColumn("rest", F.col("target") - F.col("times") * F.col("source_size")), "mix-targets")
    cuts = thresholds(sized, budgets.where("rest > 0").select("source", "rest"), few)
    plan = budgets.join(cuts, budgets["source"].eqNullSafe(cuts["source"]), "left").select(budgets["source"].alias("s"), "source_size", "target", "times", F.coalesce("cut", F.lit(0)).alias("cut"))
    return sized, stored(plan, "mix-plan"), few


def by_source(rows: DataFrame, source: Column, plan: DataFrame, few: bool) -> DataFrame:
    """rows with the plan of their source."""
    key = unused(rows, "source_key")
    named = lambda c: F.coalesce(F.concat(F.lit("s"), c), F.lit("n"))
    left, right = rows.withColumn(key, named(source)), plan.withColumn(key, named(F.col("s"))).drop("s")
    return (left.join(F.broadcast(right), key) if few else counted_lookup(left, right, [key])).drop(key)


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, broadcast_rows: int = 20_000) -> DataFrame:
    """id_col, source, size, source_size, target, copies (how often the mix takes the document), taken = copies * size."""
    sized, plan, few = planned(docs, id_col, text_col, source_col, weights, share, most, broadcast_rows)
    copies = F.col("times") + (F.col("place") < F.col("cut")).cast("long")
    return by_source(sized, F.col("source"), plan, few).select(F.col("k").alias(id_col), "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, broadcast_rows: int = 20_000) -> DataFrame:
    """The rows of docs that the mix takes, with size, source_size, target, copies and taken, which replace columns of
    these names. Rows are filtered by their source's threshold where they are; up to broadcast_rows sources no text is
    moved."""
    made = ("size", "source_size", "target", "copies", "taken")
    _, plan, few = planned(docs, id_col, text_col, source_col, weights, share, most, broadcast_rows)
    names = {c: unused(docs, f"mix_{c}") for c in ("source_size", "target", "times", "cut", "size", "copies")}
    plan = plan.withColumnsRenamed({c: n for c, n in names.items() if c in plan.columns})
    rows = by_source(docs, F.col(source_col).cast("string"), plan, few)
    copies = F.col(names["times"]) + (place(F.col(id_col)) < F.col(names["cut"])).cast("long")
    rows = rows.withColumn(names["copies"], copies).where(F.col(names["copies"]) > 0).withColumn(names["size"], word_count(F.col(text_col)))
    own = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in made]
    size, took = F.col(names["size"]), F.col(names["copies"])
    return rows.select(*own, size.alias("size"), F.col(names["source_size"]).alias("source_size"), F.col(names["target"]).alias("target"), took.alias("copies"), (took * size).alias("taken"))


SQL = r"""
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                      ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 10))::BIGINT AS place FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, [5.0::DOUBLE, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM sizes),
levels AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - 2.0::DOUBLE * coalesce(sum(source_size) OVER f, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER f, 0)) AS level
           FROM weighed WINDOW f AS (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
chosen AS (SELECT arg_min(level, source_size / w) AS l FROM levels WHERE level * w < 2 * source_size),
goal AS (SELECT source, source_size, least(2.0::DOUBLE * source_size, coalesce(l * w, 2.0::DOUBLE * source_size)) AS target FROM levels, chosen),
budgets AS (SELECT *, coalesce(floor(target / nullif(source_size, 0)), 0)::BIGINT AS times FROM goal),
each AS (SELECT source, place, sum(size) AS n FROM sized GROUP BY source, place),
running AS (SELECT e.source, e.place, e.n, sum(e.n) OVER (PARTITION BY e.source ORDER BY e.place) AS upto, b.target - b.times * b.source_size AS rest
            FROM each e JOIN budgets b ON e.source IS NOT DISTINCT FROM b.source),
cuts AS (SELECT source, max(place) AS cut FROM running WHERE rest > 0 AND upto - n <= rest AND upto - rest < rest - (upto - n) GROUP BY source)
SELECT s.doc_id, s.size::BIGINT AS size, b.source_size, b.target,
       ((b.times + CASE WHEN s.place <= coalesce(c.cut, -1) THEN 1 ELSE 0 END) * s.size)::BIGINT AS taken
FROM sized s JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source LEFT JOIN cuts c ON s.source IS NOT DISTINCT FROM c.source
"""
