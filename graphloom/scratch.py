"""Where intermediate tables go that several steps read: a folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir; in a temporary folder only where that is unset and all tasks run on this machine. It goes when the driver ends."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="loom-scratch-")
        spark.conf.set("spark.checkpoint.dir", shared)
    path = f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return path


#: Shuffled bytes a task is given at most where it sorts texts, which take some ten times that in memory.
TASK_BYTES = 8 << 20
_ADVISORY = "spark.sql.adaptive.advisoryPartitionSizeInBytes"


@contextmanager
def bounded_tasks(spark: SparkSession) -> Iterator[None]:
    """Writes in the block are shuffled to partitions of TASK_BYTES, or of the session's setting where that is less."""
    before = spark.conf.get(_ADVISORY, None)
    if before is None or spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before) > TASK_BYTES:
        spark.conf.set(_ADVISORY, str(TASK_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(_ADVISORY) if before is None else spark.conf.set(_ADVISORY, before)


def materialised(df: DataFrame, name: str) -> DataFrame:
    """The table written once and read back."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
