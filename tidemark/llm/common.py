"""Small helpers of the corpus operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: files of finished shuffles go at the end of the job, not when the driver's garbage happens to be collected
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local folder serves a local
    session (tests); on a cluster that is an error."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tidemark-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session for the time being."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def materialized(df: DataFrame, name: str, compression: str = "snappy", by: str | None = None) -> DataFrame:
    """df written once to the shared folder and read from there: lineage ends, and a lost executor loses nothing. The
    shuffle files of the job go with its end. `by`: a column that parts the folder."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark-{uuid.uuid4().hex}/{name}"
    writer = df.write.option("compression", compression)
    with setting(spark, CLEANUP, "true"):
        (writer.partitionBy(by) if by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder, in whatever store it is."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def discard(df: DataFrame, part: str = "") -> None:
    """Deletes the files of a materialized table that nothing reads any more, or one part of its folder."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/tidemark-" in folder and folder.endswith(part):
            removed(df.sparkSession, folder)


_HELD: dict[str, Any] = {}


def worker_state(key: str, make: Callable[[], Any] | None = None) -> Any:
    """What a Python worker keeps from task to task, made when it is first asked for. A worker serves one operator after
    the other and keeps the state of one: that of any other goes, and its memory goes back to the system."""
    if key not in _HELD:
        if _HELD:
            _HELD.clear()
            trimmed()
        _HELD[key] = make() if make else None
    return _HELD[key]


def trimmed() -> None:
    """Gives the memory that Python has freed back to the system, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def released(spark: SparkSession, workers: bool = True) -> None:
    """Has every executor give back the memory that nothing uses any more: the heap that the steps before have grown, which
    would otherwise stay beside the workers of the steps to come, and, if `workers`, the state of Python workers. One task
    a core; with workers each waits a little, so that no core runs two of them."""

    def idle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("released")
        trimmed()
        time.sleep(0.3)
        yield from batches

    cores = spark.sparkContext.defaultParallelism
    tasks = spark.range(0, cores, 1, cores)
    if workers:
        tasks = tasks.mapInArrow(idle, "id long")
    tasks.select(F.reflect(F.lit("java.lang.System"), F.lit("gc"))).collect()


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The batches, cut where the column's bytes come to more than `most`; a longer value is a piece of its own."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(at, stop - at)
            at = stop
