"""Static reference tables (travel times, noise curves, models) and curves through them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondera.functions import numeric
from sondera.operators.relational import band_join

#: Rows of a curve that are handled on the driver; a reference table has some hundred.
MOST = 5000


def read_columns(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Numbers in white-space columns; lines that do not begin with a number (headers, comments, blanks) are left out."""
    p = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).select(p.alias("p")).where(F.expr("try_cast(element_at(p, 1) AS DOUBLE)").isNotNull())
    return lines.select(*[F.try_element_at("p", F.lit(i + 1)).cast("double").alias(n) for i, n in enumerate(names)])


def curve(table: DataFrame, x: str, y: str, kind: str = "linear") -> DataFrame:
    """Pieces of a curve through a table: lo, hi and the coefficients c0 to c3 of powers of (x - lo).

    ``cubic`` is the spline whose third derivative is continuous at the second and the last but one point.
    """
    rows = table.select(F.col(x).cast("double"), F.col(y).cast("double")).dropna().orderBy(x).limit(MOST + 1).collect()
    if not 2 <= len(rows) <= MOST:
        raise ValueError(f"a curve takes 2 to {MOST} points")
    a, b = np.array(rows, float).T
    if kind == "cubic":
        c = numeric.spline(a, b)
    else:
        c = np.stack([b[:-1], np.diff(b) / np.diff(a), np.zeros(len(a) - 1), np.zeros(len(a) - 1)])
    parts = zip(a[:-1], a[1:], *c, strict=True)
    return table.sparkSession.createDataFrame([tuple(map(float, p)) for p in parts], "lo double, hi double, c0 double, c1 double, c2 double, c3 double")


def along(points: DataFrame, x: str, pieces: DataFrame, out: str) -> DataFrame:
    """``points`` with the curve's value at ``x``; null outside of it. An equi-join on buckets, the pieces (at most MOST) broadcast."""
    width = pieces.agg((F.max("hi") - F.min("lo")) / F.count(F.lit(1))).first()[0]
    top = pieces.agg(F.max("hi")).first()[0]
    marked = points.withColumn("__pid", F.monotonically_increasing_id())
    spans = pieces.withColumn("__hi", F.when(F.col("hi") == top, F.col("hi")).otherwise(F.col("hi") - F.abs(F.col("hi")) * 1e-15 - 1e-300))
    d = F.col(x) - F.col("lo")
    value = F.col("c0") + d * (F.col("c1") + d * (F.col("c2") + d * F.col("c3")))
    hit = band_join(marked.where(F.col(x).isNotNull()), F.broadcast(spans), [], x, "lo", "__hi", float(width)).where((F.col(x) < F.col("hi")) | (F.col("hi") == top))
    inside = hit.select(*points.columns, value.alias(out))
    ends = pieces.agg(F.min("lo").alias("a"), F.max("hi").alias("b")).first()
    outside = points.where(F.col(x).isNull() | (F.col(x) < ends["a"]) | (F.col(x) > ends["b"])).withColumn(out, F.lit(None).cast("double"))
    return inside.unionByName(outside)


def save_model(model: DataFrame, path: str, kind: str) -> None:
    """A model table (path geometry, loss) with its kind, as parquet; never overwrites."""
    model.withColumn("model_kind", F.lit(kind)).write.mode("errorifexists").parquet(path)


def load_model(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A saved model; an error if it is of another kind."""
    found = spark.read.parquet(path)
    return found.withColumn("__ok", F.assert_true(F.col("model_kind") == kind, F.lit(f"not a model of kind {kind}"))).where("__ok is null").drop("__ok", "model_kind")
