"""Benchmark decontamination by winnowing.

The fingerprint of `span` consecutive words is the least hash among their k-grams; two texts that share `span` words
share the fingerprint of that window. Items of fewer than `span` words (but not none) are one window of their own
length, whose fingerprint is the hash of all its words.

1. The benchmark becomes a distributed table of its distinct windows (fingerprint, words, items that hold it); it is not
   collected.
2. One pass over the documents, whatever the size of the benchmark, keeps those windows whose fingerprint may be one of
   the benchmark's: it is looked up in a bitmap of all fingerprints, of 16 bits each and `bitmap_bits` in all at most,
   the only thing that tasks are sent. Neighbouring windows are kept as one stretch of words.
3. The windows of the stretches are joined with the benchmark's by fingerprint and words: a match is a match word by
   word, and one that goes on is extended by each window that matches beside it. The benchmark's windows are broadcast
   up to `broadcast_rows` (they are counted); beyond that only the hot ones are (see common.counted_lookup).
4. Matches are united for each document: hit words, items, spans.

Nulls: a null text has no words. Empty documents: no hits, not contaminated. Repeated rows each get their own result.
An item without an id counts under the id 'null'; items repeated with one id are one item. An empty benchmark gives zero
hits for all, an empty table of documents an empty result. Extra columns are ignored by `hits` and kept by `clean`.
Memory grows with the longest single text and with the items that share one window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytescan import ALNUM, Words, sliding_min
from .common import counted_lookup, released, slices, stored, unused

SPAN, GRAM = 13, 6
SLICE_BYTES = 1 << 19
BITMAP_BITS = 1 << 29
_BLOCK = 1 << 15  # bits of one of Spark's bitmaps


def windows_of(words: Words, n: int, span: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, fingerprint) of each window of n words inside one text."""
    if n < span:
        return words.grams(n)
    at, hashes = words.grams(gram)
    w = span - gram + 1
    if len(at) < w:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    low = sliding_min(hashes, w)
    whole = words.text[at[: len(low)]] == words.text[at[w - 1 :]]
    return at[: len(low)][whole], low[whole]


def item_windows(benchmark: DataFrame, id_col: str, text_col: str, span: int, gram: int) -> DataFrame:
    """n, f, w, items: the distinct windows of n words w with fingerprint f, and the sorted ids of the items that hold
    them; stored."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "t", SLICE_BYTES):
            words = Words(b.column(1), ALNUM)
            for n in sorted({min(int(c), span) for c in words.counts if c}):
                at, prints = windows_of(words, n, span, gram)
                mine = words.counts[words.text[at]] >= span if n == span else words.counts[words.text[at]] == n
                at, prints = at[mine], prints[mine]
                for i in range(0, len(at), 10_000):
                    part = at[i : i + 10_000]
                    texts = pa.array([words.joined(x, n).decode("utf-8", "replace") for x in part.tolist()], pa.string())
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(words.text[part])), pa.array(np.full(len(part), n, np.int32)), pa.array(prints[i : i + 10_000].view(np.int64)), texts], names=["i", "n", "f", "w"])

    slim = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("i"), F.col(text_col).cast("string").alias("t"))
    each = slim.mapInArrow(released(scan), "i string, n int, f long, w string")
    return stored(each.groupBy("n", "f", "w").agg(F.array_sort(F.collect_set("i")).alias("items")), "benchmark-windows")


def bitmap(windows: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of the fingerprints of windows, two bits set for each: `bits` bits, built in parts on the executors."""
    low, high = F.col("f").bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned("f", 32).bitwiseAND(F.lit(bits - 1))
    slots = windows.select(F.explode(F.array(low, high)).alias("slot"))
    parts = slots.groupBy(F.floor(F.col("slot") / _BLOCK).cast("int").alias("part")).agg(F.bitmap_construct_agg(F.col("slot") % _BLOCK).alias("bits"))
    out = np.zeros(max(bits, _BLOCK) // 8, np.uint8)
    for r in parts.toLocalIterator():
        out[r["part"] * (_BLOCK // 8) :][: _BLOCK // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def among(prints: np.ndarray, known: np.ndarray, bits: int) -> np.ndarray:
    """Which prints may be in the bitmap known."""
    out = np.ones(len(prints), bool)
    for slot in (prints & np.uint64(bits - 1), (prints >> np.uint64(32)) & np.uint64(bits - 1)):
        at = slot.astype(np.int64)
        out &= (known[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
    return out


def likely(docs: DataFrame, known: np.ndarray, bits: int, lengths: list[int], span: int, gram: int) -> DataFrame:
    """For each row of docs (k, r, t) one row with its number of words, and one for each stretch of words whose windows
    of n words, the first at word s, may be the benchmark's: the words w and the windows' fingerprints f; stored."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "t", SLICE_BYTES):
            words = Words(b.column(2), ALNUM)
            yield rows(b.column(0), b.column(1), pa.array(words.counts, pa.int64()))
            for n in lengths:
                at, prints = windows_of(words, n, span, gram)
                near = among(prints, known, bits)
                at, prints = at[near], prints[near]
                if not len(at):
                    continue
                edge = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1] + 1) | (words.text[at[1:]] != words.text[at[:-1]]), [True])))
                start, count = at[edge[:-1]], np.diff(edge)
                text = words.text[start]
                told = pa.array([words.joined(s, int(c) + n - 1).decode("utf-8", "replace") for s, c in zip(start.tolist(), count, strict=True)], pa.string())
                found = pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(prints.view(np.int64)))
                yield rows(pa.nulls(len(start), b.column(0).type), b.column(1).take(pa.array(text)), pa.nulls(len(start), pa.int64()), n, pa.array((start - words.first[text]).astype(np.int32)), told, found)

    def rows(k, r, n_words, n=None, s=None, w=None, f=None) -> pa.RecordBatch:
        m = len(r)
        cols = [k, r, n_words, pa.nulls(m, pa.int32()) if n is None else pa.array(np.full(m, n, np.int32)), pa.nulls(m, pa.int32()) if s is None else s, pa.nulls(m, pa.string()) if w is None else w, pa.nulls(m, pa.list_(pa.int64())) if f is None else f]
        return pa.RecordBatch.from_arrays(cols, names=["k", "r", "n_words", "n", "s", "w", "f"])

    kind = docs.schema["k"].dataType.simpleString()
    return stored(docs.mapInArrow(released(scan), f"k {kind}, r long, n_words long, n int, s int, w string, f array<long>"), "decontaminate")


def matched(stretches: DataFrame, windows: DataFrame, broadcast_rows: int) -> DataFrame:
    """r, p, n, items: each window of the stretches that is one of windows."""
    words = F.split("w", " ")
    each = F.transform("f", lambda f, i: F.struct((F.col("s") + i).alias("p"), f.alias("f"), F.array_join(F.slice(words, i + 1, F.col("n")), " ").alias("w")))
    rows = stretches.select("r", "n", F.explode(each).alias("x")).select("r", "n", "x.p", "x.f", "x.w")
    keys = ["n", "f", "w"]
    joined = rows.join(F.broadcast(windows), keys) if windows.count() <= broadcast_rows else counted_lookup(rows, windows, keys)
    return joined.select("r", "p", "n", "items")


def united(ranges: Column) -> Column:
    """(hit, spans) of sorted ranges (a, b): the words they cover together, and start:end of each run."""
    start = F.struct(F.lit(0).cast("long").alias("hit"), F.lit(0).cast("long").alias("to"), F.lit(0).cast("long").alias("since"), F.array().cast("array<string>").alias("spans"))
    run = lambda acc: F.array(F.concat_ws(":", acc["since"], acc["to"]))
    closed = lambda acc: F.when(acc["to"] > acc["since"], F.concat(acc["spans"], run(acc))).otherwise(acc["spans"])

    def step(acc: Column, x: Column) -> Column:
        goes_on = (x["a"] <= acc["to"]) & (acc["to"] > acc["since"])
        longer = F.struct((acc["hit"] + F.greatest(x["b"] - acc["to"], F.lit(0))).alias("hit"), F.greatest(acc["to"], x["b"]).alias("to"), acc["since"].alias("since"), acc["spans"].alias("spans"))
        return F.when(goes_on, longer).otherwise(F.struct((acc["hit"] + x["b"] - x["a"]).alias("hit"), x["b"].alias("to"), x["a"].alias("since"), closed(acc).alias("spans")))

    return F.aggregate(ranges, start, step, lambda acc: F.struct(acc["hit"].alias("hit"), F.array_join(closed(acc), ",").alias("spans")))


def measured(docs: DataFrame, benchmark: DataFrame, item_col: str, item_text_col: str, span: int, gram: int, bitmap_bits: int, broadcast_rows: int) -> DataFrame:
    """k, n_words, n_hit, items, hit_spans of each row of docs (k, t)."""
    windows = item_windows(benchmark, item_col, item_text_col, span, gram)
    size = windows.agg(F.count("*").alias("rows"), F.array_sort(F.collect_set("n")).alias("lengths")).first()
    bits = min(bitmap_bits, max(1 << 16, 1 << (16 * size["rows"]).bit_length()))
    rows = likely(docs.withColumn("r", F.monotonically_increasing_id()).select("k", "r", "t"), bitmap(windows, bits), bits, list(size["lengths"]), span, gram)
    each = matched(rows.where("n IS NOT NULL"), windows, broadcast_rows)
    ranges = F.array_sort(F.collect_list(F.struct(F.col("p").cast("long").alias("a"), (F.col("p") + F.col("n")).cast("long").alias("b"))))
    per = each.groupBy("r").agg(ranges.alias("ranges"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")).withColumn("h", united(F.col("ranges")))
    found = stored(per.select("r", F.col("h.hit").alias("n_hit"), "items", F.col("h.spans").alias("hit_spans")), "decontaminate-hits")
    none = F.array().cast("array<string>")
    return rows.where("n IS NULL").select("k", "r", "n_words").join(found, "r", "left").select("k", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", none).alias("items"), F.coalesce("hit_spans", F.lit("")).alias("hit_spans"))


CONTAMINATED = "n_hit > 0 AND 20 * n_hit >= n_words"


def hits(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", span: int = SPAN, gram: int = GRAM, bitmap_bits: int = BITMAP_BITS, broadcast_rows: int = 200_000) -> DataFrame:
    """id_col, n_words, n_hit, n_items, items_sha256, contaminated, hit_spans (word ranges start:end) of every row."""
    slim = docs.select(F.col(id_col).alias("k"), F.col(text_col).cast("string").alias("t"))
    got = measured(slim, benchmark, item_col, item_text_col, span, gram, bitmap_bits, broadcast_rows)
    return got.select(F.col("k").alias(id_col), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), F.expr(CONTAMINATED).alias("contaminated"), "hit_spans")


def clean(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", span: int = SPAN, gram: int = GRAM, bitmap_bits: int = BITMAP_BITS, broadcast_rows: int = 200_000) -> DataFrame:
    """The rows of docs, all columns, that are not contaminated. What goes is named by two hashes of its text, and
    filtered without moving texts up to broadcast_rows of them."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    slim = docs.select(F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b")).alias("k"), text.alias("t"))
    got = measured(slim, benchmark, item_col, item_text_col, span, gram, bitmap_bits, broadcast_rows)
    a, b = unused(docs, "hash_a"), unused(docs, "hash_b")
    bad = stored(got.where(CONTAMINATED).select(F.col("k.a").alias(a), F.col("k.b").alias(b)).distinct(), "decontaminate-bad")
    sent = F.broadcast(bad) if bad.count() <= broadcast_rows else bad
    return docs.join(sent, (F.xxhash64(text) == F.col(a)) & (F.xxhash64(F.lit(1), text) == F.col(b)), "left_anti")
