r"""Document fingerprints by SpotSigs, with DataFrame operations only.

A signature is an anchor (a common word) and the chain of the next three content words, those between which other
common words stand included; an anchor right before another anchor has the same chain and adds none. The set of a
text's signatures, each the first eight hex digits of an MD5, is its fingerprint. A text without any has one signature,
of all its words; a text without words has the empty fingerprint. The likeness of two fingerprints is the Jaccard
similarity of the sets (1 for two empty ones).

`near_pairs` finds near copies: sets are partitioned by length in bands, so that only sets whose lengths allow the
threshold meet, and compared only if they share one of their rarest signatures. A class is named by the least id of its
rows; one that stands in rows without an id only has no name and is in no pair.

Null texts are empty. Repeated rows stay, one after the other in the order of ids. Rows without an id come first.
Empty tables give empty results; a single row is followed by itself. Extra columns are ignored. Ids are integers.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Common words of English, German, French and Spanish.
ANCHORS = (
    "the of and to in is that it for as with was on be by are this have from at or an a "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als es "
    "de la le et les en un du une que est pour qui dans par sur au "
    "el y los del se las por para con no su al lo"
).split()
CHAIN = 3
#: Rows of a range of ids. There are 4 * sqrt(rows) ranges at most, so that both their table and each of them stay small.
ROWS_PER_BUCKET = 2000


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def with_signatures(df: DataFrame, text_col: str, out: str) -> DataFrame:
    """df with the sorted set of signatures of text_col as array out."""
    anchor = lambda x: x.isin(ANCHORS)
    w, c = f"{out}_w", f"{out}_c"
    content = F.filter(F.transform(w, lambda x, i: F.struct(x.alias("w"), F.get(F.col(w), i - 1).alias("p"))), lambda s: ~anchor(s["w"]))
    chain = lambda s, i: F.concat_ws(" ", s["p"], s["w"], *[F.get(F.col(c), i + k)["w"] for k in range(1, CHAIN)])
    digest = lambda x: F.substring(F.md5(x.cast("binary")), 1, 8)
    signed = F.array_distinct(F.filter(F.transform(c, lambda s, i: F.when(anchor(s["p"]), digest(chain(s, i)))), lambda x: x.isNotNull()))
    whole = F.when(F.size(w) > 0, F.array(digest(F.array_join(w, " ")))).otherwise(F.array().cast("array<string>"))
    made = df.withColumn(w, words(F.col(text_col))).withColumn(c, content).withColumn(out, signed)
    return made.withColumn(out, F.array_sort(F.when(F.size(out) > 0, F.col(out)).otherwise(whole))).drop(w, c)


def likeness(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def unpacked(fingerprint: Column) -> Column:
    return F.when(fingerprint == "", F.array().cast("array<string>")).otherwise(F.split(fingerprint, " "))


def texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def printed(df: DataFrame) -> DataFrame:
    """df with the fingerprint of its text."""
    return with_signatures(df, "text", "sigs").withColumn("fingerprint", F.array_join("sigs", " ")).drop("sigs")


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, text (null: empty) and fingerprint of each row."""
    return printed(texts(docs, id_col, text_col))


def bucket_of(key: Column, bounds: list, kind: str) -> Column:
    """The number of bounds (sorted) that are at most key, by bisection; 0 for null."""
    if not bounds:
        return F.lit(0)
    table = F.from_json(F.lit(json.dumps(bounds)), f"array<{kind}>")  # one literal, whatever their number
    steps = max(1, math.ceil(math.log2(len(bounds) + 1)))
    halving = F.array(*[F.lit(1 << k) for k in reversed(range(steps))])
    return F.coalesce(F.aggregate(halving, F.lit(0), lambda at, k: F.when((at + k <= len(bounds)) & (F.get(table, at + k - 1) <= key), at + k).otherwise(at)), F.lit(0))


def with_next(rows: DataFrame, id_col: str) -> DataFrame:
    """rows (id_col, text) with fingerprint, next_text and next_fingerprint, of the next row by id (after the last: the first). Rows are dealt to
    ranges of ids of about equal size; each range also gets the first row of the range after it."""
    ids = rows.select(F.col(id_col).alias("k"))
    n = ids.count()
    want = max(1, min(n // ROWS_PER_BUCKET, 4 * math.isqrt(n)))
    kind = rows.schema[id_col].dataType.simpleString()
    bounds = []
    if want > 1:
        cuts = [i / want for i in range(1, want)]
        bounds = sorted(set(ids.agg(F.percentile_approx("k", cuts, 100 * want).alias("b")).first()["b"] or []))
    placed = rows.withColumn("bucket", bucket_of(F.col(id_col), bounds, kind))
    # at most one row a bucket: its first id, and the bucket before it (the last one for the first)
    firsts = ids.withColumn("bucket", bucket_of(F.col("k"), bounds, kind)).groupBy("bucket").agg(F.min(F.struct(F.col("k").isNotNull().alias("set"), "k")).alias("f"))
    order = Window.orderBy("bucket")
    firsts = firsts.select("bucket", F.col("f.k").alias("first_id"), F.coalesce(F.lag("bucket").over(order), F.max("bucket").over(Window.partitionBy())).alias("to"))
    heads = placed.join(F.broadcast(firsts.withColumnRenamed("bucket", "own")), (F.col("bucket") == F.col("own")) & F.col(id_col).eqNullSafe(F.col("first_id")))
    heads = heads.groupBy("to").agg(F.min("text").alias("text")).select(F.lit(None).cast(rows.schema[id_col].dataType).alias(id_col), "text", F.col("to").alias("bucket"), F.lit(True).alias("guest"))
    both = printed(placed.withColumn("guest", F.lit(False)).unionByName(heads))
    w = Window.partitionBy("bucket").orderBy("guest", F.col(id_col).asc_nulls_first(), "text")
    return both.withColumn("next_text", F.lead("text").over(w)).withColumn("next_fingerprint", F.lead("fingerprint").over(w)).where("NOT guest").drop("guest", "bucket")


def compare_edited(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_signatures. The edited
    text is the text whose last half is replaced by as many leading code points of the next document."""
    nexts = with_next(texts(docs, id_col, text_col), id_col)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = nexts.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half)))
    kept = edited.select(id_col, n.cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "next_fingerprint", "edited")
    made = with_signatures(kept, "edited", "e").withColumn("a", unpacked(F.col("fingerprint"))).withColumn("b", unpacked(F.col("next_fingerprint")))
    return made.select(id_col, "n_chars", "edited_sha256", "fingerprint", F.array_join("e", " ").alias("edited_fingerprint"), likeness(F.col("a"), F.col("e")).alias("near_edited"), likeness(F.col("a"), F.col("b")).alias("near_next"), F.size("a").cast("long").alias("n_signatures"))


def near_pairs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.75) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): the fingerprint class of each row (class_id, its least id), and class_a < class_b, likeness of
    all pairs of classes at or above threshold."""
    prints = stored(fingerprints(docs, id_col=id_col, text_col=text_col).select(F.col(id_col).alias("k"), "fingerprint"), "spotsigs")
    classes = stored(prints.where("fingerprint <> ''").groupBy("fingerprint").agg(F.min("k").alias("class_id")), "spotsigs-classes")
    members = prints.join(classes, "fingerprint", "left").select(F.col("k").alias(id_col), "class_id")
    sets = classes.select("class_id", unpacked(F.col("fingerprint")).alias("s"))
    each = sets.select("class_id", F.size("s").alias("n"), F.explode("s").alias("sig"))
    freq = each.groupBy("sig").agg(F.count("*").alias("df"))
    rank = F.row_number().over(Window.partitionBy("class_id").orderBy("df", "sig"))
    prefix = each.join(freq, "sig").withColumn("r", rank).where(F.col("r") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1)
    band = F.floor(F.log(F.col("n").cast("double")) / -math.log(threshold)).cast("int")
    left = prefix.select(F.col("class_id").alias("a"), F.col("n").alias("na"), "sig", band.alias("band"))
    right = prefix.select(F.col("class_id").alias("b"), F.col("n").alias("nb"), "sig", F.explode(F.array(band, band - 1, band + 1)).alias("band"))
    maybe = left.join(right, ["sig", "band"]).where((F.col("a") < F.col("b")) & (F.least("na", "nb") >= threshold * F.greatest("na", "nb"))).select("a", "b").distinct()
    full = maybe.join(sets.select(F.col("class_id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("class_id").alias("b"), F.col("s").alias("sb")), "b")
    pairs = full.select(F.col("a").alias("class_a"), F.col("b").alias("class_b"), likeness(F.col("sa"), F.col("sb")).alias("likeness")).where(F.col("likeness") >= threshold)
    return members, pairs


def _sql_sigs(text: str) -> str:
    listed = ", ".join("'" + a.replace("'", "''") + "'" for a in ANCHORS)
    return f"""
      SELECT *, CASE WHEN len(g) > 0 THEN list_sort(g) WHEN len(w) > 0 THEN [substr(md5(array_to_string(w, ' ')), 1, 8)] ELSE [] END AS sigs FROM (
      SELECT *, list_distinct(list_filter(list_transform(range(1, len(c) + 1), lambda i: CASE WHEN list_contains([{listed}], c[i].p)
               THEN substr(md5(concat_ws(' ', c[i].p, c[i].w, c[i + 1].w, c[i + 2].w)), 1, 8) END), lambda x: x IS NOT NULL)) AS g FROM (
      SELECT *, list_filter(list_transform(range(1, len(w) + 1), lambda i: {{'w': w[i], 'p': CASE WHEN i > 1 THEN w[i - 1] END}}), lambda q: NOT list_contains([{listed}], q.w)) AS c FROM (
      SELECT *, list_filter(string_split_regex(lower({text}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM """


SQL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
p AS (SELECT doc_id, text, sigs FROM ({_sql_sigs("text")} t))))),
n AS (SELECT *, coalesce(lead(text) OVER o, first_value(text) OVER o) AS next_text, coalesce(lead(sigs) OVER o, first_value(sigs) OVER o) AS next_sigs FROM p WINDOW o AS (ORDER BY doc_id, text)),
e AS (SELECT doc_id, text, sigs AS s, next_sigs, substr(text, 1, length(text) - length(text) // 2) || substr(next_text, 1, length(text) // 2) AS edited FROM n),
f AS ({_sql_sigs("edited")} e)))),
c AS (SELECT *, len(list_intersect(s, sigs)) AS i, len(list_intersect(s, next_sigs)) AS j FROM f)
SELECT doc_id, length(text)::BIGINT AS n_chars, sha256(edited) AS edited_sha256, array_to_string(s, ' ') AS fingerprint, array_to_string(sigs, ' ') AS edited_fingerprint,
       CASE WHEN len(s) + len(sigs) = 0 THEN 1.0::DOUBLE ELSE i::DOUBLE / (len(s) + len(sigs) - i) END AS near_edited,
       CASE WHEN len(s) + len(next_sigs) = 0 THEN 1.0::DOUBLE ELSE j::DOUBLE / (len(s) + len(next_sigs) - j) END AS near_next, len(s)::BIGINT AS n_signatures
FROM c
"""
