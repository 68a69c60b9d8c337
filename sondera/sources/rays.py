"""Ray predictions as text: propagation results for models, and eigenrays as detections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sondera.sources.tables import read_columns

#: Columns of the two layouts; the older one has no celerity.
NEW = ("theta", "phi", "n", "x", "y", "t", "cel", "z_max", "incl", "back_az", "amp_geo", "amp_atmo")
OLD = tuple(c for c in NEW if c != "cel")


def _half_turn(z: Column) -> Column:
    return F.when(z > 180, z - 360).when(z < -180, z + 360).otherwise(z)


def read_rays(spark: SparkSession, path: str, layout: str = "new") -> DataFrame:
    """One row per ray of Cartesian results: rng (km), rcel (s/km), az, az_dev (degrees), phi, loss (dB, geometric and absorption), and the columns read."""
    rows = read_columns(spark, path, list(NEW if layout == "new" else OLD))
    rng = F.hypot("x", "y")
    az = 90 - F.degrees(F.atan2("y", "x"))
    back = 90 - F.degrees(F.atan2(-F.col("y"), -F.col("x")))
    made = {"rng": rng, "rcel": F.col("t") / rng, "az": _half_turn(az), "az_dev": _half_turn(back - F.col("back_az")), "phi": _half_turn(F.col("phi")), "loss": F.col("amp_geo") + F.col("amp_atmo")}
    return rows.withColumns(made)


def eigenray_detections(spark: SparkSession, path: str, source_time: float, ground_speed: float, f_stat: float, channels: int) -> DataFrame:
    """Detections from eigenrays to stations: latitude and longitude (columns 4 and 5), travel time (6), inclination (9), back azimuth (10).

    The trace velocity is the sound speed at the ground over the cosine of the inclination.
    """
    rows = read_columns(spark, path, [f"c{i}" for i in range(12)])
    return rows.select(
        F.bround("c3", 3).alias("latitude"), F.bround("c4", 3).alias("longitude"), F.timestamp_micros(F.round((F.lit(source_time) + F.col("c5")) * 1e6).cast("long")).alias("time"), F.bround("c9", 2).alias("back_az"),
        F.bround(ground_speed / F.cos(F.radians("c8")), 1).alias("trace_vel"), F.lit(float(f_stat)).alias("f_stat"), F.lit(int(channels)).alias("array_dim"), F.lit("ray arrival").alias("note"),
    )

