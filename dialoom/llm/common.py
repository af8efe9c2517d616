"""Shared plumbing: scratch tables in the cluster's shared folder, joins with hot keys, bounded Arrow slices, grouped Arrow
streams."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import math
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

_LOCAL: list[str] = []
_SCRATCH: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor sees: spark.checkpoint.dir of the session; a temporary one only where it is unset and
    driver and executors are one process (tests)."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if set_dir:
        return set_dir.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors see")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="dialoom-"))
    return f"file://{_LOCAL[0]}"


def scratch_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_folder(spark)}/dialoom-{label}-{uuid.uuid4().hex}"
    _SCRATCH[path] = spark
    return path


#: Tables known to be small are written in parts of about so many rows, but in some parts at least.
PART_ROWS, LEAST_PARTS = 20_000, 8


def gathered(df: DataFrame, rows: int) -> DataFrame:
    """df in no more parts than `rows` need, the most that it and what its last stage reads can have: a small table dealt
    over all shuffle partitions is a file and a task each for a handful of rows, again in each step that follows."""
    parts = max(LEAST_PARTS, math.ceil(rows / PART_ROWS))
    return df.coalesce(parts) if parts < shuffle_partitions(df.sparkSession) else df


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written as Parquet in the shared folder and read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_with(df: DataFrame, label: str, *facts: Column) -> tuple[DataFrame, Row]:
    """stored, and aggregates of df that are taken while it is written (a stage that is run again may count twice: use them
    for choices that any value leaves right)."""
    seen = Observation()
    out = stored(df.observe(seen, *facts), label)
    told = seen.get
    return out, Row(**told) if told else out.agg(*facts).first()  # a plan that was cut short tells nothing


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release_scratch() -> None:
    """Delete all scratch tables of this process; frames that read them can't be used afterwards."""
    for path, spark in list(_SCRATCH.items()):
        with contextlib.suppress(Exception):  # the session may have ended already
            delete_path(spark, path)
        _SCRATCH.pop(path, None)


atexit.register(release_scratch)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def unused(df: DataFrame, name: str) -> str:
    """name, with as many underscores behind it as it takes to clash with no column of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


KEY_ROWS = "key_rows"


def keyed(df: DataFrame, label: str) -> tuple[DataFrame, int, int]:
    """df (with key_rows, how many rows of some other table have the key) stored, the sum and the greatest of key_rows."""
    out, seen = stored_with(df, label, F.sum(KEY_ROWS).alias("total"), F.max(KEY_ROWS).alias("most"))
    return out, seen["total"] or 0, seen["most"] or 0


def hot_limit(left: DataFrame, total: int, least: int) -> int:
    return max(least, total // (4 * shuffle_partitions(left.sparkSession)))


def lookup(left: DataFrame, right: tuple[DataFrame, int, int], keys: list[str], *, how: str = "inner", least: int = 1000) -> DataFrame:
    """left joined (inner or left) with right, a table of `keyed`: one row a key, with the number of rows of left that have
    it. Keys that hold more rows of left than a quarter of a shuffle partition's even share (and than `least`) meet right
    by broadcast, so that none of them fills a task: there are fewer than four a partition of them. All other keys
    meet by shuffle."""
    table, total, most = right
    limit = hot_limit(left, total, least)
    if most <= limit:
        return left.join(table.drop(KEY_ROWS), keys, how)
    hot, cold = table.where(F.col(KEY_ROWS) > limit).drop(KEY_ROWS), table.where(F.col(KEY_ROWS) <= limit).drop(KEY_ROWS)
    first = left.join(F.broadcast(hot), keys)
    return first.unionByName(left.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys, how))


def counted_lookup(left: DataFrame, right: DataFrame, keys: list[str], *, how: str = "inner", least: int = 1000) -> DataFrame:
    """lookup in a right (at most one row a key) that does not know how many rows of left have a key: they are counted."""
    sizes, total, most = keyed(left.groupBy(*keys).agg(F.count("*").alias(KEY_ROWS)), "key-sizes")
    limit = hot_limit(left, total, least)
    if most <= limit:
        return left.join(right, keys, how)
    hot = sizes.where(F.col(KEY_ROWS) > limit).select(*keys)
    hot_right = stored(right.join(F.broadcast(hot), keys, "left_semi"), "hot-rows")
    first = left.join(F.broadcast(hot), keys, "left_semi").join(F.broadcast(hot_right), keys, how)
    return first.unionByName(left.join(F.broadcast(hot), keys, "left_anti").join(right, keys, how))


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Consecutive row slices holding at most max_bytes of the text column each (one row at least), so that memory
    does not depend on Arrow's batch size."""
    import numpy as np

    for batch in batches:
        if not batch.num_rows:
            continue
        arr = batch.column(batch.schema.get_field_index(column))
        kind = np.int64 if pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type) else np.int32
        offsets = np.frombuffer(arr.buffers()[1], kind)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offsets, offsets[at] + max_bytes, "right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


def released(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """work, after which a worker gives memory it has freed back to the system: workers are kept for later tasks and stages, and
    what they hold counts against the executor while other stages run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # not every system's C library can trim
                ctypes.CDLL(None).malloc_trim(0)

    return run


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables holding whole runs of equal keys, from batches sorted by key; what is kept is one batch and one run."""
    import numpy as np

    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        keys = table.column(key).to_numpy(zero_copy_only=False)
        if held and held[-1].column(key)[-1].as_py() != keys[0]:
            yield pa.concat_tables(held)
            held = []
        changes = np.flatnonzero(keys[1:] != keys[:-1])
        if len(changes):
            cut = int(changes[-1]) + 1
            yield pa.concat_tables([*held, table.slice(0, cut)])
            held = [table.slice(cut)]
        else:
            held.append(table)
    if held:
        yield pa.concat_tables(held)
