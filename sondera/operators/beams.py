"""Slowness grids, delays and beam projections as columns; the array kernels are in ``beamforming``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def slowness(az: Column, velocity: Column) -> tuple[Column, Column]:
    """Slowness (s/m) of a back azimuth (degrees) and trace velocity (m/s)."""
    return F.sin(F.radians(az)) / velocity, F.cos(F.radians(az)) / velocity


def plane_delay(dx: Column, dy: Column, az: Column, velocity: Column) -> Column:
    """Plane-wave delay (s) of an element at (dx, dy) metres."""
    sx, sy = slowness(az, velocity)
    return dx * sx + dy * sy


def spherical_delay(dx: Column, dy: Column, px: Column, py: Column, velocity: float = 340.0, height: float = 0.0) -> Column:
    """Delay (s) of a spherical wave from a source at (px, py) metres and a height."""
    return F.sqrt((px - dx) * (px - dx) + (py - dy) * (py - dy) + height * height) / velocity


def bartlett_power(x: Column, phase: Column) -> Column:
    """Normalised Bartlett power of one (real) spectrum column: |a^H x|^2 / (M x^H x)."""
    total = lambda arr: F.aggregate(arr, F.lit(0.0), lambda s, v: s + v)
    re = total(F.zip_with(x, phase, lambda v, p: v * F.cos(p)))
    im = total(F.zip_with(x, phase, lambda v, p: v * F.sin(p)))
    return (re * re + im * im) / (F.size(x) * total(F.transform(x, lambda v: v * v)))


def project(df: DataFrame, keys: list[str], power: str) -> DataFrame:
    """Beam power projected on the remaining axis: most and mean."""
    return df.groupBy(*keys).agg(F.max(power).alias("most"), F.avg(power).alias("mean"))


def coherent_f(power: Column, channels: Column) -> Column:
    """Fisher statistic of a normalised beam power: p / (1 - p) * (M - 1)."""
    return power / (1 - power) * (channels - 1)
