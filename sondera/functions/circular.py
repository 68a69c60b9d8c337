"""Circular and spherical aggregates as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sondera.functions.geodesy import _c, from_xyz, to_xyz


def circular_mean(az) -> Column:
    """Mean direction in degrees; nulls are left out."""
    a = F.radians(_c(az))
    return F.degrees(F.atan2(F.avg(F.sin(a)), F.avg(F.cos(a))))


def circular_std(az) -> Column:
    """Circular standard deviation in degrees."""
    a = F.radians(_c(az))
    r = F.hypot(F.avg(F.sin(a)), F.avg(F.cos(a)))
    return F.degrees(F.sqrt(-2 * F.log(F.least(r, F.lit(1.0)))))


def geographic_mean(lat, lon) -> tuple[Column, Column]:
    """Mean position as the mean of unit vectors."""
    x, y, z = (F.avg(v) for v in to_xyz(lat, lon))
    mean_lat, mean_lon, _ = from_xyz(x, y, z)
    return mean_lat, mean_lon


def von_mises_kappa(f_stat, channels) -> Column:
    """Beam width of a detection: 2 (M - 1) F, held between the widths of 4 and 12 degrees, then widened by 4 degrees.

    The half-maximum angle of a von Mises density with parameter k satisfies cos(angle) = 1 - ln 2 / k.
    """
    from math import cos, log, radians

    width = lambda deg: log(2) / (1 - cos(radians(deg)))
    k0 = F.greatest(F.least(2 * (_c(channels) - 1) * _c(f_stat), F.lit(width(4))), F.lit(width(12)))
    half = F.acos(1 - log(2) / k0) + radians(4)
    return log(2) / (1 - F.cos(half))


#: Abramowitz and Stegun 9.8.1 and 9.8.2: polynomial coefficients of the modified Bessel function I0, fixed values.
_I0_SMALL = (1.0, 3.5156229, 3.0899424, 1.2067492, 0.2659732, 0.0360768, 0.0045813)
_I0_LARGE = (0.39894228, 0.01328592, 0.00225319, -0.00157565, 0.00916281, -0.02057706, 0.02635537, -0.01647633, 0.00392377)


def _horner(t: Column, coefficients: tuple[float, ...]) -> Column:
    out = F.lit(coefficients[-1])
    for c in coefficients[-2::-1]:
        out = out * t + c
    return out


def log_i0(k) -> Column:
    """ln I0(k), k >= 0."""
    x = _c(k)
    small = F.log(_horner(F.pow(x / 3.75, 2), _I0_SMALL))
    return F.when(x <= 3.75, small).otherwise(x - 0.5 * F.log(x) + F.log(_horner(3.75 / x, _I0_LARGE)))


def von_mises_pdf(delta, kappa) -> Column:
    """Density (per radian) of an azimuth deviation in degrees."""
    from math import log, pi

    return F.exp(_c(kappa) * F.cos(F.radians(_c(delta))) - log(2 * pi) - log_i0(kappa))
