"""Named parquet tables of a data directory."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The table ``name`` below ``root``: one parquet file or a folder of them.

    >>> table(spark, "/data/sf1", "events")  # doctest: +SKIP
    """
    return spark.read.parquet(f"{root}/{name}.parquet")


def epoch(at: str) -> Column:
    """Seconds since 1970 of a timestamp column, with or without time zone (the session zone is to be UTC)."""
    return F.unix_micros(F.col(at).cast("timestamp")) / 1e6


def _shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; only a local session may do without the setting."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: it names the folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir().rstrip("/")


def durable(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the shared folder: rounds of an iteration survive lost executors."""
    _shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again. Unlike a checkpoint it has the size it has, not one estimated from the plans
    before it, which grows with every round of joins until planning takes longer than the work."""
    path = f"{_shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt (by ``keys``, if any) to a task for each shuffle partition, two a core at least, for work that takes long per row:
    adaptive execution puts partitions of few bytes together, however long their rows take."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism), *keys)
