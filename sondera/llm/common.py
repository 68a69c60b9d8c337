"""What the corpus operators share: tables, shared-folder writes, chunked passes."""

from __future__ import annotations

import ctypes
import ctypes.util
import tempfile
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words: runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; only a local session may do without it and gets a folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: it names the folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex[:12]}-{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a few numbers each that are broadcast at most.
BROADCAST_ROWS = 1 << 18


def small(df: DataFrame, name: str) -> DataFrame:
    """``df``, written, and broadcast to joins while it has no more than ``BROADCAST_ROWS`` rows; else such joins are plain shuffles of both sides."""
    df = cut(df, name)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


#: Tasks of a stage over a table of no more than ``BROADCAST_ROWS`` rows, whatever the session's shuffle partitions.
FEW_TASKS = 8


def in_few_tasks(df: DataFrame, few: bool = True) -> DataFrame:
    """``df``, whose shuffle partitions are read by ``FEW_TASKS`` tasks where its rows are known to be ``few``."""
    return df.coalesce(FEW_TASKS) if few else df


#: Rows of an Arrow batch of texts, at most: a batch and its copies lie outside the heap, for each task.
TEXT_ROWS = 1024


def text_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to ``TEXT_ROWS`` rows where they are larger; texts are thousands of bytes, not a number or two."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= TEXT_ROWS:
        spark.conf.set(name, TEXT_ROWS)


@cache
def _libc():
    """The C library, if it gives freed memory back; found once a worker, since looking for it starts a process."""
    name = ctypes.util.find_library("c")
    found = ctypes.CDLL(name) if name else None
    return found if hasattr(found, "malloc_trim") else None


def tidied(batches):
    """A mapInArrow function that gives freed memory back when its partition ends: Python workers wait for further tasks, and several wait at once."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches(found)
        pa.default_memory_pool().release_unused()
        if _libc():
            _libc().malloc_trim(0)

    return run


def sliced(found: Iterator[pa.RecordBatch], text: str = "text", most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of text, so that what a worker makes of a batch stays small."""
    for batch in found:
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text)).cast(pa.binary())), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes, dtype=np.int64) // most
        ends = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(ends, ends[1:], strict=False):
            if hi > lo:
                yield batch.slice(lo, hi - lo)


def text_or_empty(text: str) -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))
