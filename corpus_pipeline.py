"""A corpus pipeline of five stages over ``documents``; each stage is one operator of ``sondera.llm``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sondera.llm import exact_dedup, mixing, near_dedup, packing, quality
from sondera.llm.common import cut, documents

STAGES = [
    ("quality rules", quality.stage),
    ("exact dedup", exact_dedup.stage),
    ("near dedup", near_dedup.stage),
    ("source mixing", mixing.stage),
    ("packing", packing.stage),
]

#: The posterior of the quality rules and the packing have no SQL form; tests hold run() against the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; every result but the last is written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
