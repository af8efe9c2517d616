"""MinHash near-duplicates by a chosen-path set similarity join.

Each text is the set of its distinct word 5-grams, and has a signature of `WIDTH` minwise hashes. Texts with equal sets
are one class. Every tree sends each class to the node of one of its minwise tokens; a node with more than `node_rows`
classes branches by two more tokens, at positions that its path has not used, which a hash of the node chooses. Small
nodes are compared exhaustively by signature. A large node of which more than half are like one of its members (by
signature; a few members are tried) is a crowd of near copies: it is not branched on, its members become candidates of
its least one. So do those of a node that is still large after `DEPTH` branchings. A pair at the threshold t meets in a
tree with probability t at least, times 1 - (1 - t)**2 for each branching. Independent trees are repeated until all of
them miss such a pair with probability `miss` at most, for as many branchings as were needed.

Candidates found this way form clusters. In each cluster the full sets are compared exactly, breadth first: whatever a
text is linked with joins its component and need not be compared with the rest of it. Nothing emits all pairs. A
cluster whose sets are too many for one task is dealt to chunks; then all members outside its largest component are
compared with every chunk, so no link between components is lost.

Null and blank texts have empty sets and are linked with nothing. Repeated rows are linked as equal texts and share one
decision. Rows without an id are compared like others, by the hash of their text. They take the least id of their
component, and are kept only if none of it has an id: then its component id is null and one of its rows is kept. Blank
texts without an id are all kept. Empty tables give empty results. Extra columns are ignored by
`near_duplicates` and kept by `one_of_each`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytescan import SPACED, Words, mix
from .common import gathered, keyed, lookup, released, shuffle_partitions, slices, stored, stored_with, unused, whole_groups
from .graph import components, stars

SHINGLE, WIDTH, NODE_ROWS = 5, 64, 1000
#: The share of pairs at the threshold that all trees together may miss; the most branchings of a tree.
MISS, DEPTH = 1e-6, 8
SLICE_BYTES = 1 << 19
#: Full sets of about so many elements are compared in one task.
TASK_ELEMENTS = 3_000_000
_FACTORS = mix(np.arange(1, WIDTH + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text number, element) of the distinct elements of all texts, by text."""
    words = Words(texts, SPACED)
    at, hashes = words.grams(SHINGLE)
    short = np.flatnonzero((words.counts > 0) & (words.counts < SHINGLE))
    text = np.concatenate((words.text[at], short))
    hashes = np.concatenate((hashes, words.sequences(short)))
    order = np.lexsort((hashes, text))
    text, hashes = text[order], hashes[order]
    fresh = np.ones(len(text), bool)
    fresh[1:] = (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])
    return text[fresh], hashes[fresh]


def set_keys(text: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(size, two 64-bit sums that name the set) of each of n texts."""
    counts = np.bincount(text, minlength=n)
    first = np.concatenate(([0], np.cumsum(counts)))
    sums = []
    for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(hashes ^ np.uint64(salt)), dtype=np.uint64)))
        sums.append((total[first[1:]] - total[first[:-1]]).view(np.int64))
    return counts, sums[0], sums[1]


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """k, n, s1, s2, sig (WIDTH 32-bit minwise hashes), h (hash of a text without an id) and a row number of each row;
    stored."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "t", SLICE_BYTES):
            n = b.num_rows
            text, hashes = shingle_sets(b.column(1))
            counts, s1, s2 = set_keys(text, hashes, n)
            sig = np.full((n, WIDTH), 0xFFFFFFFF, np.uint32)
            some = np.flatnonzero(counts)
            if len(some):
                first = np.concatenate(([0], np.cumsum(counts)))[some]
                for j in range(WIDTH):
                    sig[some, j] = np.minimum.reduceat(((hashes * _FACTORS[j]) >> np.uint64(32)).astype(np.uint32), first)
            packed = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * 4 * WIDTH), pa.py_buffer(sig)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(s1), pa.array(s2), packed, b.column(2)], names=["k", "n", "s1", "s2", "sig", "h"])

    slim = docs.select(F.col(id_col).alias("k"), F.col(text_col).cast("string").alias("t")).withColumn("h", F.when(F.col("k").isNull(), F.xxhash64("t")))
    made = slim.mapInArrow(released(scan), f"k {docs.schema[id_col].dataType.simpleString()}, n long, s1 long, s2 long, sig binary, h long")
    return stored(made.withColumn("row", F.monotonically_increasing_id()), "sketches")


def token(at) -> F.Column:
    """The minwise token at position at of sig."""
    return F.substring(F.col("sig"), at * 4 + 1, F.lit(4))


def crowded(members: DataFrame, rows: int) -> tuple[DataFrame, int]:
    """members (key, ...; rows of them) of nodes with two at least, with the node's count as size; the greatest size."""
    counts = keyed(gathered(members.groupBy("key").agg(F.count("*").alias("key_rows")).where("key_rows > 1").withColumn("size", F.col("key_rows")), rows), "node-sizes")
    return lookup(members, counts, ["key"]), counts[2]


def least_equal(percent: int) -> int:
    """Five standard deviations below the expected number of equal tokens at the threshold."""
    t = percent / 100
    return max(1, int(WIDTH * t - 5 * (WIDTH * t * (1 - t)) ** 0.5))


def crowds(large: DataFrame, percent: int, leaders: int = 3, tried: int = 300) -> tuple[DataFrame, int, int]:
    """key, crowd, b (its least member) of each node of large: whether more than half of it is like one of a few members,
    chosen by hash, judged by some `tried` others. As `keyed` gives it."""
    led = large.groupBy("key").agg(F.count("*").alias("key_rows"), F.min("c").alias("b"), *[F.min_by(F.struct("sig", "n"), F.xxhash64(F.lit(j), "c")).alias(f"l{j}") for j in range(leaders)])
    led = stored(led, "leaders")
    some = large.where(F.pmod(F.xxhash64("c", F.lit(11)), F.greatest(F.lit(1), F.floor(F.col("size") / tried))) == 0).select("key", "n", "sig")
    equal = lambda j: F.aggregate(F.sequence(F.lit(0), F.lit(WIDTH - 1)), F.lit(0), lambda acc, i: acc + (F.substring("sig", i * 4 + 1, F.lit(4)) == F.substring(F.col(f"l{j}.sig"), i * 4 + 1, F.lit(4))).cast("int"))
    near = lambda j: (100 * F.least("n", f"l{j}.n") >= percent * F.greatest("n", f"l{j}.n")) & (equal(j) >= least_equal(percent))
    shares = some.join(led.drop("key_rows", "b"), "key").groupBy("key").agg(F.greatest(*[F.avg(near(j).cast("int")) for j in range(leaders)]).alias("share"))
    return keyed(led.select("key", "key_rows", "b").join(shares, "key", "left").select("key", "key_rows", "b", F.coalesce(F.col("share") > 0.5, F.lit(False)).alias("crowd")), "crowds")


NODE = ["key", "size", "c", "n", "sig"]


def planted(classes: DataFrame, trees: range) -> tuple[DataFrame, int]:
    """The nodes (with path) of the roots of trees, stored, and the greatest size."""
    root = lambda t: F.struct(F.xxhash64(F.lit(t), token(F.lit(t))).alias("key"), F.array(F.lit(t)).alias("path"))
    roots = classes.select("c", F.explode(F.array(*[root(t) for t in trees])).alias("node")).select("c", "node.*")
    rows = classes.count() * len(trees)
    nodes, most = crowded(roots, rows)
    return stored(gathered(nodes.join(classes.select("c", "n", "sig"), "c"), rows), "nodes"), most


def grown(level: DataFrame, most: int, node_rows: int, percent: int) -> tuple[DataFrame, DataFrame, int]:
    """(small, stuck, depth) from the nodes of roots, of which the greatest has most rows: NODE of the nodes with at most
    node_rows classes; c and b, the least of its node, of larger ones that are crowds or have been branched DEPTH times;
    and the number of branchings."""
    small, stuck, depth = level.where(F.col("size") <= node_rows).select(NODE), level.where("false").select("c", F.col("c").alias("b")), 0
    while most > node_rows:
        large = level.where(F.col("size") > node_rows)
        judged = stored(lookup(large, crowds(large, percent), ["key"]), "large-nodes")
        if depth == DEPTH:
            return small, stuck.unionByName(judged.select(stuck.columns)), depth
        stuck = stuck.unionByName(judged.where("crowd").select(stuck.columns))
        free = F.array_except(F.sequence(F.lit(0), F.lit(WIDTH - 1)), F.col("path"))
        pick = lambda c, salt: F.get(F.col(c), F.pmod(F.xxhash64("key", F.lit(salt)), F.size(c)).cast("int"))
        chosen = judged.where("NOT crowd").withColumn("free", free).withColumn("p1", pick("free", 1)).withColumn("free", F.array_remove("free", F.col("p1"))).withColumn("p2", pick("free", 2))
        branch = lambda p: F.struct(F.xxhash64("key", F.col(p), token(F.col(p))).alias("key"), F.array_append("path", F.col(p)).alias("path"))
        rows = 2 * judged.count()
        nodes, most = crowded(chosen.select("c", "n", "sig", F.explode(F.array(branch("p1"), branch("p2"))).alias("node")).select("c", "n", "sig", "node.*"), rows)
        if not most:
            break
        level = stored(gathered(nodes, rows), "nodes")
        small = small.unionByName(level.where(F.col("size") <= node_rows).select(NODE))
        depth += 1
    return small, stuck, depth


def trees_needed(percent: int, depth: int, miss: float) -> int:
    t = percent / 100
    meets = t * (1 - (1 - t) ** 2) ** depth
    return min(WIDTH, math.ceil(math.log(miss) / math.log(1 - meets))) if meets < 1 else 1


def tree_nodes(classes: DataFrame, percent: int, node_rows: int, miss: float) -> tuple[DataFrame, DataFrame]:
    """(small, stuck) of as many trees as the depth that they reach asks for; the first ones do for two branchings."""
    small, stuck, done, need = None, None, 0, trees_needed(percent, 2, miss)
    while done < need:
        more_small, more_stuck, depth = grown(*planted(classes, range(done, need)), node_rows, percent)
        small, stuck = (more_small, more_stuck) if small is None else (small.unionByName(more_small), stuck.unionByName(more_stuck))
        done, need = need, max(need, trees_needed(percent, depth, miss))
    return small, stuck


def alike(sig: np.ndarray, n: np.ndarray, x: int, others: np.ndarray, percent: int, least: int) -> np.ndarray:
    """Which others may be linked with x: enough equal minwise tokens and sizes that allow it."""
    sizes = 100 * np.minimum(n[others], n[x]) >= percent * np.maximum(n[others], n[x])
    return sizes & ((sig[others] == sig[x]).sum(1) >= least)


def node_edges(small: DataFrame, percent: int) -> DataFrame:
    """a, b: the components of the pairs in each node that may be linked, as stars for each task."""
    least = least_equal(percent)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for table in whole_groups(batches, "key"):
            table = table.combine_chunks()
            key, c, n = (table.column(x).to_numpy() for x in ("key", "c", "n"))
            sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint32).reshape(-1, WIDTH)
            edge = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]))
            pairs = edge[:-1][np.diff(edge) == 2]
            good = (100 * np.minimum(n[pairs], n[pairs + 1]) >= percent * np.maximum(n[pairs], n[pairs + 1])) & ((sig[pairs] == sig[pairs + 1]).sum(1) >= least)
            found.append((c[pairs[good]], c[pairs[good] + 1]))
            for s, e in zip(edge[:-1], edge[1:], strict=True):
                if e - s == 2:
                    continue
                left = np.arange(s, e)
                while len(left):
                    queue, left = [int(left[0])], left[1:]
                    while queue and len(left):
                        x = queue.pop()
                        near = alike(sig, n, x, left, percent, least)
                        new, left = left[near], left[~near]
                        found.append((np.full(len(new), c[x]), c[new]))
                        queue += new.tolist()
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in stars(*(np.concatenate([f[i] for f in found]) for i in (0, 1)))], names=["a", "b"])

    dealt = small.select("key", "c", "n", "sig").repartition(shuffle_partitions(small.sparkSession), "key").sortWithinPartitions("key", "c")
    return dealt.mapInArrow(released(compare), "a long, b long").distinct()


def exact_edges(texts: pa.Array, c: np.ndarray, s1: np.ndarray, s2: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Spanning edges between all texts whose full sets are similar enough, breadth first. Texts whose set isn't the
    class's own (rows that share an id) are left out."""
    text, hashes = shingle_sets(texts)
    size, mine1, mine2 = set_keys(text, hashes, len(c))
    valid = (mine1 == s1) & (mine2 == s2)
    _, first_of = np.unique(c, return_index=True)
    once = np.zeros(len(c), bool)
    order = np.flatnonzero(valid)
    _, pos = np.unique(c[order], return_index=True)
    once[order[pos]] = True
    element, slot = np.unique(hashes, return_inverse=True)
    by = np.argsort(slot, kind="stable")
    owners = text[by]
    begin = np.concatenate(([0], np.cumsum(np.bincount(slot, minlength=len(element)))))
    first = np.concatenate(([0], np.cumsum(size)))
    left, edges = once.copy(), []
    n_left = int(left.sum())
    for seed in np.flatnonzero(once):
        if not left[seed]:
            continue
        left[seed] = False
        n_left -= 1
        queue = [int(seed)]
        while queue and n_left:
            x = queue.pop()
            own = slot[first[x] : first[x + 1]]
            lens = begin[own + 1] - begin[own]
            take = np.repeat(begin[own] - np.concatenate(([0], np.cumsum(lens)[:-1])), lens) + np.arange(lens.sum())
            both = np.bincount(owners[take], minlength=len(c))
            near = np.flatnonzero(left & (100 * both >= percent * (size + size[x] - both)) & (both > 0))
            left[near] = False
            n_left -= len(near)
            edges += [(int(c[x]), int(c[y])) for y in near]
            queue += near.tolist()
    return edges


def verified(docs: DataFrame, members: DataFrame, id_col: str, text_col: str, percent: int, broadcast_rows: int) -> DataFrame:
    """a, b: exact spanning edges inside each group of members (c, k or h, s1, s2, grp)."""
    sizes = members.agg(F.count("*").alias("all"), F.count("k").alias("named")).first()
    sent = F.broadcast if sizes["all"] <= broadcast_rows else lambda x: x
    texts = docs.select(F.col(id_col).alias("k"), F.col(text_col).cast("string").alias("t"))
    rows = texts.join(sent(members.drop("h")), "k").select("grp", "c", "s1", "s2", "t")
    if sizes["named"] < sizes["all"]:
        unnamed = texts.where("k IS NULL").withColumn("h", F.xxhash64("t")).drop("k").join(sent(members.where("k IS NULL").drop("k")), "h")
        rows = rows.unionByName(unnamed.dropDuplicates(["grp", "c"]).select("grp", "c", "s1", "s2", "t"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "grp"):
            grp = table.column("grp").to_numpy()
            edge = np.concatenate(([0], np.flatnonzero(grp[1:] != grp[:-1]) + 1, [len(grp)]))
            for s, e in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                part = table.slice(s, e - s).combine_chunks()
                found = exact_edges(part.column("t").combine_chunks(), *(part.column(x).to_numpy() for x in ("c", "s1", "s2")), percent)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in stars(*np.array(found, np.int64).T)], names=["a", "b"])

    return rows.repartition(shuffle_partitions(docs.sparkSession), "grp").sortWithinPartitions("grp", "c").mapInArrow(released(compare), "a long, b long")


def linked_classes(docs: DataFrame, classes: DataFrame, id_col: str, text_col: str, percent: int, miss: float, node_rows: int, task_elements: int, broadcast_rows: int) -> DataFrame:
    """node, root: classes that are linked with others, and the least class of their component."""
    small, stuck = tree_nodes(classes, percent, node_rows, miss)
    clusters = components(node_edges(small, percent).unionByName(stuck.select(F.col("c").alias("a"), "b")), "a", "b")
    members, known = stored_with(clusters.join(classes, F.col("node") == F.col("c")).select("c", F.col("first").alias("k"), F.when(F.col("first").isNull(), F.col("h")).alias("h"), "n", "s1", "s2", F.col("root").alias("cluster")), "members", F.count("*").alias("rows"))
    few = lambda df: gathered(df, known["rows"])  # noqa: E731  tables of a row a member at most, made of members alone
    sizes = keyed(few(members.groupBy("cluster").agg(F.ceil(F.sum("n") / task_elements).alias("chunks"), F.count("*").alias("key_rows"))), "cluster-sizes")
    members, seen = stored_with(few(lookup(members, sizes, ["cluster"]).withColumn("chunk", F.pmod(F.xxhash64("c"), F.col("chunks")))), "clusters", F.max("chunks").alias("chunks"))
    keys = members.withColumn("grp", F.xxhash64("cluster", "chunk")).select("c", "k", "h", "s1", "s2", "grp")
    edges, linked = stored_with(verified(docs, keys, id_col, text_col, percent, broadcast_rows), "links", F.count("*").alias("rows"))
    if (seen["chunks"] or 0) > 1:
        labels = components(edges, "a", "b", linked["rows"])
        parted = stored(few(members.where("chunks > 1").join(labels, F.col("c") == F.col("node"), "left").withColumn("label", F.coalesce("root", "c")).drop("node", "root")), "cluster-parts")
        weight = parted.groupBy("cluster", "label").agg(F.count("*").alias("w"))
        main = keyed(weight.groupBy("cluster").agg(F.max(F.struct("w", "label")).alias("m"), F.sum("w").alias("key_rows")).select("cluster", F.col("m.label").alias("main"), "key_rows"), "cluster-mains")
        rest = stored(lookup(parted, main, ["cluster"]).where(F.col("label") != F.col("main")), "cluster-rests")
        rests = keyed(rest.groupBy("cluster").agg(F.ceil(F.sum("n") / task_elements).alias("rests"), F.count("*").alias("key_rows")), "rest-sizes")
        rest = lookup(rest, rests, ["cluster"]).withColumn("rest", F.pmod(F.xxhash64("c", F.lit(7)), F.col("rests")))
        # each chunk meets each part of the rest in a task of its own
        whole = keyed(main[0].select("cluster", "key_rows").join(rests[0].select("cluster", "rests"), "cluster"), "cluster-rest-counts")
        chunk_side = lookup(parted, whole, ["cluster"]).withColumn("rest", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rests") - 1)))
        rest_side = rest.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
        cols = ["c", "k", "h", "s1", "s2", F.xxhash64("cluster", "chunk", "rest").alias("grp")]
        more = stored(chunk_side.select(*cols).unionByName(rest_side.select(*cols)).distinct(), "cluster-tasks")
        again, more_linked = stored_with(verified(docs, more, id_col, text_col, percent, broadcast_rows), "links", F.count("*").alias("rows"))
        return components(edges.unionByName(again), "a", "b", linked["rows"] + more_linked["rows"])
    return components(edges, "a", "b", linked["rows"])


def judged(docs: DataFrame, id_col: str, text_col: str, percent: int, miss: float, node_rows: int, task_elements: int, broadcast_rows: int) -> DataFrame:
    """k, h, n, component (least id of the component, if any has one), kept of each row."""
    rows = sketches(docs, id_col, text_col)
    all_rows = rows.count()
    classes = rows.where("n > 0").groupBy("n", "s1", "s2").agg(F.min("k").alias("first"), F.min("h").alias("h"), F.min("row").alias("row"), F.first("sig").alias("sig"), F.count("*").alias("key_rows"))
    classes = stored(gathered(classes, all_rows).withColumn("c", F.monotonically_increasing_id()), "classes")
    linked = linked_classes(docs, classes.drop("key_rows"), id_col, text_col, percent, miss, node_rows, task_elements, broadcast_rows)
    named, seen = stored_with(linked.join(classes.select("c", "first", "row"), F.col("node") == F.col("c")).select("c", "root", "first", "row"), "linked", F.count("*").alias("rows"))
    least = keyed(gathered(named.groupBy("root").agg(F.min("first").alias("least"), F.min("row").alias("least_row"), F.count("*").alias("key_rows")), seen["rows"]), "linked-least")
    labels = lookup(named.select("c", "root"), least, ["root"]).select(F.col("c").alias("x"), "least", "least_row")
    of_class = classes.join(labels, F.col("c") == F.col("x"), "left").select("n", "s1", "s2", "key_rows", F.coalesce("least", "first").alias("component"), F.coalesce("least_row", "row").alias("chosen"))
    kept = F.when(F.col("k").isNull(), F.col("component").isNull() & (F.col("row") == F.col("chosen"))).otherwise(F.col("k") == F.col("component"))
    out = lookup(rows.where("n > 0").select("k", "h", "n", "s1", "s2", "row"), keyed(gathered(of_class, all_rows), "components"), ["n", "s1", "s2"])
    out = out.select("k", "h", "n", "component", kept.alias("kept"))
    return out.unionByName(rows.where("n = 0").select("k", "h", "n", F.col("k").alias("component"), F.lit(True).alias("kept")))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, miss: float = MISS, node_rows: int = NODE_ROWS, task_elements: int = TASK_ELEMENTS, broadcast_rows: int = 100_000) -> DataFrame:
    """id_col, n_shingles, component_id (least id of the component), kept (id = component_id) of each row."""
    out = judged(docs, id_col, text_col, percent, miss, node_rows, task_elements, broadcast_rows)
    return out.select(F.col("k").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), "kept")


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, miss: float = MISS, node_rows: int = NODE_ROWS, task_elements: int = TASK_ELEMENTS, broadcast_rows: int = 100_000) -> DataFrame:
    """The rows of docs, all columns, whose id is the least of its component; of a component without ids, one row."""
    out = judged(docs, id_col, text_col, percent, miss, node_rows, task_elements, broadcast_rows)
    lost = stored(out.where("NOT kept OR k IS NULL").select("k", "h", "n", "kept").distinct(), "copies")
    id_name, hash_name = unused(docs, "gone"), unused(docs, "text_hash")
    gone = lost.where("k IS NOT NULL").select(F.col("k").alias(id_name))
    small = F.broadcast(gone) if gone.count() <= broadcast_rows else gone
    rest = docs.join(small, docs[id_col] == F.col(id_name), "left_anti")
    unnamed = lost.where("k IS NULL")
    if unnamed.isEmpty():
        return rest
    hashed = docs.where(docs[id_col].isNull()).withColumn(hash_name, F.xxhash64(F.col(text_col).cast("string")))
    those = lambda rule: hashed.join(unnamed.where(rule).select(F.col("h").alias(hash_name)).distinct(), hash_name, "left_semi")
    lone = those("n > 0 AND kept").dropDuplicates([hash_name]).unionByName(those("n = 0"))
    return rest.where(F.col(id_col).isNotNull()).unionByName(lone.drop(hash_name).select(*docs.columns))
