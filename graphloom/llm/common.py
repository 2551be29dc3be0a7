"""Helpers shared by the training-data operators.

Intermediate results that are used more than once are written as Parquet below
the cluster's checkpoint folder (``spark.checkpoint.dir``): the files are
compressed, shared by all executors and survive the loss of any of them.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes that an Arrow batch shall have, where the session sets none: two tasks with two batches each stay small.
BATCH_ROWS, BATCH_BYTES = 2048, 16 << 20
#: Rows a side may have, at a few fixed-width columns, to be broadcast by hint.
BROADCAST_ROWS = 500_000
#: Spark's setting that removes a finished execution's shuffle files.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Paths of the tables cut inside each open ``passing`` block.
_CUTS: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder; a temporary one only where none is set and all tasks run on this machine."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = tempfile.mkdtemp(prefix="loom-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here.

    The shuffle files of the write go when it ends, rather than when the driver's heap happens to be collected.
    The files are removed at the end of the ``passing`` block around, else when the driver's JVM exits.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loom-{name}-{uuid.uuid4().hex}"
    if _CUTS:
        _CUTS[-1].append(path)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    jvm_path = jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(conf).deleteOnExit(jvm_path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jvm_path, True)


def forget(df: DataFrame) -> None:
    """Remove the files of a ``cut`` that nothing reads any more."""
    files = df.inputFiles()
    if files:
        _delete(df.sparkSession, files[0].rsplit("/", 1)[0])


@contextmanager
def passing(spark: SparkSession):
    """Files of tables that are ``cut`` inside go when the block ends, but those of the tables given to the yielded function."""
    paths: list[str] = []
    _CUTS.append(paths)

    def keep(df: DataFrame) -> DataFrame:
        kept = {f.rsplit("/", 1)[0].rsplit("/", 1)[-1] for f in df.inputFiles()}
        for path in [p for p in paths if p.rsplit("/", 1)[-1] in kept]:
            paths.remove(path)
            if len(_CUTS) > 1:
                _CUTS[-2].append(path)
        return df

    try:
        yield keep
    finally:
        _CUTS.remove(paths)
        for path in paths:
            _delete(spark, path)


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast where a count proves ``df`` small; else leave the join to Spark."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def eq(*pairs: tuple[Column, Column]) -> Column:
    """Null-safe equality of every pair."""
    out = None
    for a, b in pairs:
        out = a.eqNullSafe(b) if out is None else out & a.eqNullSafe(b)
    return out


def _give_back() -> None:
    """Free memory of this Python worker goes back to the system: idle workers hold little."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim is not None:
        trim(0)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow over batches of bounded size, whose workers keep no free memory when a task ends."""
    conf = df.sparkSession.conf
    for name, bound in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        if conf.get(f"spark.sql.execution.arrow.{name}", None) is None:
            conf.set(f"spark.sql.execution.arrow.{name}", str(bound))

    def run(batches):
        try:
            yield from fn(batches)
        finally:
            _give_back()

    return df.mapInArrow(run, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
