"""Numerical integration, products and densities as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sondera.operators import blocks


def simpson_weight(i: Column, n: Column) -> Column:
    """Composite Simpson weight of point i of n (n odd, i from 0), without the spacing / 3."""
    return F.when((i == 0) | (i == n - 1), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)


def simpson(df: DataFrame, keys: list[str], x: str, y: str, out: str = "integral", block: float | None = None) -> DataFrame:
    """Composite Simpson integral of y over equally spaced x for each key.

    An even number of points leaves its last interval to the trapezoid rule; one point gives 0. A point's weight depends on its number and
    on how many there are; with ``block`` (of x) both come from counts of blocks, so a key's points are never in one task.
    """
    if block is None:
        order = Window.partitionBy(*keys).orderBy(x)
        every = Window.partitionBy(*keys)
        df = df.withColumns({"__i": F.row_number().over(order) - 1, "__n": F.count(F.lit(1)).over(every)})
        step = (F.max(x).over(every) - F.min(x).over(every)) / F.greatest(F.col("__n") - 1, F.lit(1))
    else:
        sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), ((F.max(x) - F.min(x)) / F.greatest(F.count(F.lit(1)) - 1, F.lit(1))).alias("__step"))
        df = blocks.running(blocks.blocked(df, x, block), keys, [x], {"__i": ("sum", F.lit(1), False)}).join(sizes, keys)
        step = F.col("__step")
    odd = F.when(F.col("__n") % 2 == 1, F.col("__n")).otherwise(F.col("__n") - 1)
    w = F.when((F.col("__i") < odd) & (odd > 1), simpson_weight(F.col("__i"), odd) / 3).otherwise(0.0)
    w = w + F.when((F.col("__n") % 2 == 0) & (F.col("__i") >= F.col("__n") - 2), 0.5).otherwise(0.0)
    return df.withColumn("__t", w * step * F.col(y)).groupBy(*keys).agg(F.sum("__t").alias(out))


def product(x: Column) -> Column:
    """Product of non-negative values through logarithms, exact zero if one is zero; the range of a double is no limit on the way."""
    return F.when(F.min(x) <= 0, F.lit(0.0)).otherwise(F.exp(F.sum(F.log(F.when(x > 0, x)))))


def weighted_mean(x: Column, w: Column) -> Column:
    return F.sum(w * x) / F.sum(w)


def fixed_histogram(df: DataFrame, keys: list[str], x: str, lo: float, hi: float, bins: int) -> DataFrame:
    """Counts per bin of equal width; the last bin includes its right end, values outside are left out."""
    width = (hi - lo) / bins
    inside = df.where(F.col(x).between(lo, hi))
    b = F.least(F.floor((F.col(x) - lo) / width), F.lit(bins - 1)).cast("int")
    return inside.groupBy(*keys, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def at_least_k(probabilities: Column, k: int) -> Column:
    """Probability that k or more independent events happen: the Poisson-binomial recurrence folded over the array.

    The fold keeps the probabilities of 0, 1, .., k - 1 events only.
    """
    start = F.array(*[F.lit(1.0 if i == 0 else 0.0) for i in range(k)])
    step = lambda acc, p: F.transform(acc, lambda x, i: x * (1 - p) + F.when(i > 0, F.element_at(acc, F.greatest(i, F.lit(1)))).otherwise(0.0) * p)
    return 1 - F.aggregate(F.aggregate(probabilities, start, step), F.lit(0.0), lambda a, x: a + x)


def highest_density(df: DataFrame, keys: list[str], x: str, p: str, level: float) -> DataFrame:
    """Smallest set of grid cells that holds ``level`` of each key's mass: its ends, size and mass."""
    rank = Window.partitionBy(*keys).orderBy(F.desc(p), x)
    share = F.col(p) / F.sum(p).over(Window.partitionBy(*keys))
    df = df.withColumn("__p", share).withColumn("__c", F.sum("__p").over(rank.rowsBetween(Window.unboundedPreceding, 0)))
    inside = df.where(F.col("__c") - F.col("__p") < level)
    return inside.groupBy(*keys).agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.count(F.lit(1)).alias("cells"), F.sum("__p").alias("mass"))
