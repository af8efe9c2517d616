"""Removal of repeated byte strings with a sparse, distributed suffix array.

A byte goes if a string of `span` bytes that covers it also starts earlier in the corpus. Sorting all suffixes would
move every text many times over, so suffixes are thinned first and only those that can match are sorted:

1. Each string of `span` bytes has an anchor: the leftmost least hash among its `GRAM`-byte grams. Equal strings have
   their anchor at the same offset, so only strings with equal anchor grams can be equal. Neighbouring strings mostly
   share an anchor; together they are its context. Of equal contexts (by 64-bit hashes of the gram and of the whole) only
   the first in corpus order can keep strings, all others are marked at once: first inside a slice of the input, then
   over all.
2. Of the remaining contexts only those whose gram stands in another context too go on, with their bytes.
   `repartitionByRange` on the leading bytes of the anchored suffix samples splitters and range-partitions them. A
   range never splits equal leading bytes, so that no match crosses a boundary and none has to be compared there.
3. In its bucket every string of the contexts is a suffix cut to `span` bytes; they are sorted locally by multikey
   quicksort over eight-byte symbols (ties only are looked at further), and in each run of equal ones all but the
   first in corpus order are marked. What a bucket may hold is bounded: strings of grams in more than `hot_contexts`
   contexts are compared by 128 bits of hash instead, dealt by these, which gives the same marks.

Strings are judged on the input. Nulls are empty. Rows with equal ids count as one document: only a smaller id, or an
earlier start, is earlier; rows repeated in id and text get equal results. A null id comes before all others. Texts
shorter than `span` stay whole. An empty table gives an empty result. Extra columns are ignored. Ids are integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from .bytescan import mix, powers, sliding_min, text_bytes
from .common import hot_limit, keyed, lookup, shuffle_partitions, slices, stored, whole_groups

SPAN, GRAM = 100, 24
#: Grams in more contexts than this are settled by aggregation, not in one bucket.
HOT_CONTEXTS = 20_000
#: Of so many documents one is scanned beforehand, only to learn which grams to deal to several tasks: those found in
#: more contexts of this sample than SCOUT_ROWS and than a quarter of a partition's share.
SCOUT, SCOUT_ROWS = 64, 16
SLICE_BYTES = 2 << 20
_INDEX_BITS = 31


def anchors(buf: np.ndarray, start: np.ndarray, end: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, ...]:
    """For each anchor: text number, position of anchor, first and last string that it stands for (positions in buf),
    hash of its gram, and hash of its whole context."""
    n, w = len(buf), span - gram + 1
    nothing = (*(np.zeros(0, np.int64),) * 4, *(np.zeros(0, np.uint64),) * 2)
    if n < span:
        return nothing
    up, down = powers(n + 1)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[:n], out=prefix[1:])
    m = n - gram + 1
    hashes = mix((prefix[gram:] - prefix[:m]) * down[:m])
    bits = np.uint64(_INDEX_BITS)
    low = sliding_min(((hashes >> bits) << bits) | np.arange(m, dtype=np.uint64), w)
    anchor = (low & np.uint64((1 << _INDEX_BITS) - 1)).astype(np.int64)
    # strings that lie inside one text
    valid = np.zeros(n + 1, np.int32)
    fits = end - start >= span
    np.add.at(valid, start[fits], 1)
    np.add.at(valid, end[fits] - span + 1, -1)
    p = np.flatnonzero(np.cumsum(valid[: len(anchor)]) > 0)
    if not len(p):
        return nothing
    a = anchor[p]
    text = np.searchsorted(start, p, "right") - 1
    edge = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (p[1:] != p[:-1] + 1) | (text[1:] != text[:-1]))))
    lo, hi = p[edge], p[np.append(edge[1:], len(p)) - 1]
    a, text = a[edge], text[edge]
    context = mix((prefix[hi + span] - prefix[lo]) * down[lo] + mix((hi - lo).astype(np.uint64)))
    return text, a, lo, hi, hashes[a], context


def merged(k: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of adjacent intervals [lo, hi] of equal k, as (index of one row, lo, hi)."""
    order = np.lexsort((lo, k))
    k, lo, hi = k[order], lo[order], hi[order]
    new = np.concatenate(([True], (k[1:] != k[:-1]) | (lo[1:] > hi[:-1] + 1)))
    first = np.flatnonzero(new)
    return order[first], lo[first], np.maximum.reduceat(hi, first) if len(first) else hi[:0]


def scan_anchors(docs: DataFrame, span: int, gram: int) -> DataFrame:
    """k, th, marked, g, x, a, lo, hi: anchors with gram hash g and context hash x, the repeats inside a slice already
    merged into marked intervals. Positions count from the text's first byte; th is the hash of the text."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "t", SLICE_BYTES):
            buf, start, end = text_bytes(b.column(2))
            text, a, lo, hi, g, x = anchors(buf, start, end, span, gram)
            k, th = b.column(0).to_numpy()[text], b.column(1).to_numpy()[text]
            a, lo, hi = a - start[text], lo - start[text], hi - start[text]
            order = np.lexsort((a, k, x, g))
            first = np.concatenate(([True], (g[order][1:] != g[order][:-1]) | (x[order][1:] != x[order][:-1]))) if len(order) else np.zeros(0, bool)
            lead = order[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))] if len(order) else order
            later = (k[lead] < k[order]) | ((k[lead] == k[order]) & (a[lead] < a[order]))
            gone, kept = order[later], order[~later]
            if len(gone):
                at, m_lo, m_hi = merged(text[gone], lo[gone], hi[gone])
                at = gone[at]
                yield batch(k[at], th[at], True, np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64), m_lo, m_lo, m_hi)
            yield batch(k[kept], th[kept], False, g[kept], x[kept], a[kept], lo[kept], hi[kept])

    def batch(k, th, marked, g, x, a, lo, hi) -> pa.RecordBatch:
        longs = [pa.array(v.view(np.int64) if v.dtype == np.uint64 else v, pa.int64()) for v in (k, th, g, x)]
        ints = [pa.array(v.astype(np.int32)) for v in (a, lo, hi)]
        return pa.RecordBatch.from_arrays([*longs[:2], pa.array(np.full(len(k), marked)), *longs[2:], *ints], names=["k", "th", "marked", "g", "x", "a", "lo", "hi"])

    return docs.mapInArrow(scan, "k long, th long, marked boolean, g long, x long, a int, lo int, hi int")


def multikey_ties(run: np.ndarray, strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, group): the rows of strings (eight-byte symbols) that equal another row of their run, so ordered that
    equal ones are together, and the number of their group. Each symbol sorts only what all symbols before left tied."""
    order, group = np.arange(len(run)), run
    for j in range(-1, strings.shape[1]):
        if j >= 0:
            symbol = strings[order, j]
            by = np.lexsort((symbol, group))
            order, symbol, group = order[by], symbol[by], group[by]
            new = np.concatenate(([True], (group[1:] != group[:-1]) | (symbol[1:] != symbol[:-1])))
        else:
            by = np.argsort(group, kind="stable")
            order, group = order[by], group[by]
            new = np.concatenate(([True], group[1:] != group[:-1]))
        number = np.cumsum(new)
        tied = np.bincount(number, minlength=number[-1] + 1)[number] > 1
        order, group = order[tied], number[tied]
        if not len(order):
            break
    return order, group


def later_strings(g: np.ndarray, k: np.ndarray, a: np.ndarray, lo: np.ndarray, hi: np.ndarray, contexts: pa.Array, span: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, position) of the strings of contexts that equal one that starts earlier."""
    buf, base, _ = text_bytes(contexts)
    rows, places = [], []
    for offset in range(span - gram + 1):
        p = a - offset
        at = np.flatnonzero((p >= lo) & (p <= hi))
        if len(at) < 2:
            continue
        cut = np.zeros((len(at), -(-span // 8) * 8), np.uint8)
        cut[:, :span] = buf[(base[at] + p[at] - lo[at])[:, None] + np.arange(span)]
        order, group = multikey_ties(g[at], cut.view(">u8").astype(np.uint64))
        if not len(order):
            continue
        row = at[order]
        by = np.lexsort((p[row], k[row], group))
        row, group = row[by], group[by]
        first = np.concatenate(([True], group[1:] != group[:-1]))
        lead = row[np.maximum.accumulate(np.where(first, np.arange(len(row)), 0))]
        later = (k[lead] < k[row]) | ((k[lead] == k[row]) & (p[lead] < p[row]))
        rows.append(row[later])
        places.append(p[row[later]])
    none = np.zeros(0, np.int64)
    return (np.concatenate(rows), np.concatenate(places)) if rows else (none, none)


def sorted_marks(contexts: DataFrame, span: int, gram: int) -> DataFrame:
    """k, th, lo, hi: intervals of repeated strings found by sorting the contexts (g, k, th, a, lo, hi, lead, bytes)."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "g"):
            g, k, th, a, lo, hi = (table.column(c).to_numpy() for c in ("g", "k", "th", "a", "lo", "hi"))
            a, lo, hi = (v.astype(np.int64) for v in (a, lo, hi))
            row, p = later_strings(g, k, a, lo, hi, table.column("bytes").combine_chunks(), span, gram)
            if len(row):
                at, m_lo, m_hi = merged(row, p, p)
                at = row[at]
                yield pa.RecordBatch.from_arrays([pa.array(k[at]), pa.array(th[at]), pa.array(m_lo.astype(np.int32)), pa.array(m_hi.astype(np.int32))], names=["k", "th", "lo", "hi"])

    ranged = contexts.repartitionByRange(shuffle_partitions(contexts.sparkSession), "lead").sortWithinPartitions("lead", "g", "k", "a")
    return ranged.drop("lead").mapInArrow(compare, "k long, th long, lo int, hi int")


def hot_marks(contexts: DataFrame, docs: DataFrame, span: int) -> DataFrame:
    """k, th, lo, hi: repeated strings of contexts (k, th, lo, hi) whose grams are so frequent that no task may hold
    them: strings are counted by hash, with map-side combination, and joined with the first of their kind."""
    window = F.substring(F.col("t").cast("binary"), F.col("p") + 1, F.lit(span))
    each = stored(contexts.join(docs, ["k", "th"]).withColumn("p", F.explode(F.sequence("lo", "hi"))).select("k", "th", "p", F.xxhash64(F.lit(1), window).alias("w1"), F.xxhash64(F.lit(2), window).alias("w2")), "hot-strings")
    first = each.groupBy("w1", "w2").agg(F.min(F.struct("k", "p")).alias("f"), F.count("*").alias("key_rows")).where("key_rows > 1")
    later = (F.col("f.k") < F.col("k")) | ((F.col("f.k") == F.col("k")) & (F.col("f.p") < F.col("p")))
    return lookup(each, keyed(first, "hot-firsts"), ["w1", "w2"]).where(later).select("k", "th", F.col("p").alias("lo"), F.col("p").alias("hi"))


def frequent_grams(docs: DataFrame, span: int, gram: int, scout: int, scout_rows: int) -> DataFrame | None:
    """g of grams that are to be dealt to several tasks, judged by a sample of docs; None without any. A gram that the
    sample misses or names in vain changes no result. There are fewer than four a partition."""
    spark, seen = docs.sparkSession, Observation()
    some = scan_anchors(docs.sample(1 / scout, seed=0) if scout > 1 else docs, span, gram)
    sizes = some.where("NOT marked").groupBy("g").agg(F.count("*").alias("n")).where("n > 1").observe(seen, F.sum("n").alias("total"))
    # no more can be above the limit than four a partition, so that these come to the driver
    largest = sizes.orderBy(F.desc("n")).limit(4 * shuffle_partitions(spark)).collect()
    if not largest:
        return None
    limit = hot_limit(docs, seen.get.get("total") or sum(r["n"] for r in largest), scout_rows)
    often = [(r["g"],) for r in largest if r["n"] > limit]
    return spark.createDataFrame(often, "g long") if often else None


def settled(rows: DataFrame, hot_contexts: int) -> DataFrame:
    """rows (k, th, marked, g, x, a, lo, hi) of frequent grams, of which each part has kept the first of equal contexts:
    all but the first over all parts are marked, and grams left with one context go. A context has a row a part at most."""
    firsts = rows.groupBy("g", "x").agg(F.min(F.struct("k", "a")).alias("f"))
    contexts = firsts.groupBy("g").agg(F.count("*").alias("contexts"))  # a row a frequent gram
    later = (F.col("f.k") < F.col("k")) | ((F.col("f.k") == F.col("k")) & (F.col("f.a") < F.col("a")))
    ruled = rows.join(firsts, ["g", "x"]).join(F.broadcast(contexts), "g").withColumn("marked", later).where(F.col("marked") | (F.col("contexts") > 1))
    return stored(ruled.select("k", "th", "marked", "g", "a", "lo", "hi", (F.col("contexts") > hot_contexts).alias("hot")), "settled")


def marked_strings(docs: DataFrame, span: int, gram: int, hot_contexts: int, scout: int, scout_rows: int) -> DataFrame:
    """k, th, lo, hi: where strings start that also start earlier. docs: k, th, t."""
    frequent = frequent_grams(docs, span, gram, scout, scout_rows)
    found = scan_anchors(docs, span, gram)
    # marked rows only pass through: each is a group of its own by its place
    spread = found.withColumn("g", F.when(F.col("marked"), F.xxhash64("k", "th", "lo")).otherwise(F.col("g")))
    if frequent is None:
        dealt = spread.withColumn("part", F.lit(None).cast("long"))
    else:
        part = F.pmod(F.xxhash64("k", "th", "a"), F.lit(shuffle_partitions(docs.sparkSession)))
        dealt = spread.join(F.broadcast(frequent.withColumn("often", F.lit(True))), "g", "left").withColumn("part", F.when(F.col("often"), part)).drop("often")
    same = Window.partitionBy("g", "part", "x").orderBy("k", "a")
    gram_rows = Window.partitionBy("g", "part")
    ruled = dealt.withColumn("f", F.first(F.struct("k", "a")).over(same)).withColumn("least", F.min("x").over(gram_rows)).withColumn("most", F.max("x").over(gram_rows)).withColumn("rows", F.count("*").over(gram_rows))
    later = (F.col("f.k") < F.col("k")) | ((F.col("f.k") == F.col("k")) & (F.col("f.a") < F.col("a")))
    dealt_out = F.col("part").isNotNull()
    ruled = ruled.withColumn("marked", F.col("marked") | later).where(F.col("marked") | dealt_out | (F.col("least") != F.col("most")))
    ruled = stored(ruled.select("k", "th", "marked", "g", "a", "lo", "hi", (~dealt_out & (F.col("rows") > hot_contexts)).alias("hot"), F.when(dealt_out, F.col("x")).alias("x")), "anchors")
    if frequent is not None:
        parted = (F.col("x").isNotNull()) & ~F.col("marked")
        ruled = ruled.where(~parted).drop("x").unionByName(settled(ruled.where(parted).drop("hot"), hot_contexts))
    open_rows = ruled.where("NOT marked").drop("marked")
    size = (F.col("hi") - F.col("lo") + span).cast("int")
    raw = F.col("t").cast("binary")
    with_bytes = open_rows.where("NOT hot").join(docs, ["k", "th"]).select("g", "k", "th", "a", "lo", "hi", F.substring(raw, F.col("a") + 1, F.lit(gram)).alias("lead"), F.substring(raw, F.col("lo") + 1, size).alias("bytes")).dropDuplicates(["g", "k", "th", "a"])
    marks = ruled.where("marked").select("k", "th", "lo", "hi").unionByName(sorted_marks(with_bytes, span, gram))
    hot = open_rows.where("hot")
    return marks if hot.isEmpty() else marks.unionByName(hot_marks(hot.select("k", "th", "lo", "hi").distinct(), docs, span))


def cut(text: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, bytes]:
    """(removed bytes, maximal removed runs, what is left) of text without the intervals spans."""
    left, at, removed, n = [], 0, 0, 0
    reach = -1
    for a, b in sorted(spans):
        if a > reach:
            n += 1
            left.append(text[at:a])
            removed += b - a
        elif b > reach:
            removed += b - reach
        reach = max(reach, b)
        at = reach
    left.append(text[at:])
    return removed, n, b"".join(left)


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, gram: int = GRAM, hot_contexts: int = HOT_CONTEXTS, scout: int = SCOUT, scout_rows: int = SCOUT_ROWS, with_bytes: bool = False) -> DataFrame:
    """id_col, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the bytes left, if asked for) of each row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lowest = F.lit(-(1 << 63)).cast("long")
    slim = docs.select(F.coalesce(F.col(id_col).cast("long"), lowest).alias("k"), F.xxhash64(text).alias("th"), text.alias("t"))
    marks = marked_strings(slim, span, gram, hot_contexts, scout, scout_rows).groupBy("k", "th").agg(F.collect_list(F.struct("lo", (F.col("hi") + span).alias("to"))).alias("spans"))
    whole = slim.join(marks, ["k", "th"], "left").select("k", "t", "spans")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "t", SLICE_BYTES):
            got = []
            for t, spans in zip(b.column(1).cast(pa.binary()), b.column(2), strict=True):
                raw = t.as_py()
                got.append((len(raw), *cut(raw, [(s["lo"], s["to"]) for s in spans.as_py() or []])))
            cols = [b.column(0), *(pa.array([g[i] for g in got], pa.int64()) for i in range(3)), pa.array([hashlib.sha256(g[3]).hexdigest() for g in got], pa.string())]
            names = ["k", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([g[3] for g in got], pa.binary())] if with_bytes else cols, names=[*names, "kept"] if with_bytes else names)

    out = whole.mapInArrow(apply, "k long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_bytes)
    return out.select(F.nullif("k", lowest).cast(docs.schema[id_col].dataType).alias(id_col), *out.columns[1:])
