"""Tables between the steps of a chain, written to the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []
_WRITTEN: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a temporary folder only where it is unset and all run in one process."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors see")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="dialoom-core-"))
    return f"file://{_LOCAL[0]}"


def stored(df: DataFrame) -> DataFrame:
    """df written once and read back, so that what reads it several times doesn't plan and run it again. Deleted at the
    end of the process."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/dialoom-step-{uuid.uuid4().hex}"
    _WRITTEN[path] = spark
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def release() -> None:
    """Delete all tables of this process; frames that read them can't be used afterwards."""
    for path, spark in list(_WRITTEN.items()):
        with contextlib.suppress(Exception):  # the session may have ended already
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        _WRITTEN.pop(path, None)
