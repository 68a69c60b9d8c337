"""Ordered work on one hot key: blocks of an ordered column, summaries of blocks, and what a block gets from those around it.

A window over a whole key is one task, however long the key's history. Here a
key's rows fall into blocks of ``width`` on their ordered column, windows run
within blocks, and each block is summed up in a few numbers; windows over those
alone go over a whole key, and their results are joined back by (key, block). A
task holds a block's rows, or a key's summaries: one for every ``width``.

Rows whose key or ordered column is null join nothing and are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400.0
BLOCK = "__block"
_AGG = {"sum": F.sum, "max": F.max, "min": F.min}


def blocked(df: DataFrame, at: str, width: float) -> DataFrame:
    return df.withColumn(BLOCK, F.floor(F.col(at) / width))


def before(keys: list[str]):
    """The blocks of a key before this one."""
    return Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)


def after(keys: list[str]):
    """The blocks of a key after this one, nearest first: a growing frame in falling order."""
    return Window.partitionBy(*keys).orderBy(F.desc(BLOCK)).rowsBetween(Window.unboundedPreceding, -1)


def running(df: DataFrame, keys: list[str], order: list[Column | str], outs: dict[str, tuple[str, Column, bool]]) -> DataFrame:
    """``df`` (blocked) with running sums, maxima or minima over a key's rows in order: name -> (sum | max | min, column, row itself included).

    What nothing is before is null for maxima and minima, 0 for sums.
    """
    whole = Window.partitionBy(*keys, BLOCK).orderBy(*order)
    frame = {True: whole.rowsBetween(Window.unboundedPreceding, 0), False: whole.rowsBetween(Window.unboundedPreceding, -1)}
    own = df.withColumns({f"__own_{k}": _AGG[kind](c).over(frame[inside]) for k, (kind, c, inside) in outs.items()})
    totals = df.groupBy(*keys, BLOCK).agg(*[_AGG[kind](c).alias(f"__all_{k}") for k, (kind, c, _) in outs.items()])
    carried = totals.select(*keys, BLOCK, *[_AGG[kind](f"__all_{k}").over(before(keys)).alias(f"__from_{k}") for k, (kind, _, _) in outs.items()])

    def total(k: str, kind: str) -> Column:
        a, b = F.col(f"__own_{k}"), F.col(f"__from_{k}")
        return F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)) if kind == "sum" else (F.greatest if kind == "max" else F.least)(a, b)

    joined = own.join(carried, [*keys, BLOCK]).withColumns({k: total(k, kind) for k, (kind, _, _) in outs.items()})
    return joined.drop(*[f"__{s}_{k}" for k in outs for s in ("own", "from")])
