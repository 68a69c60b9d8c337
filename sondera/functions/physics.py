"""Propagation and source models as Spark columns (closed forms from the open literature)."""

from __future__ import annotations

from math import exp, gamma, pi, sqrt

from pyspark.sql import Column
from pyspark.sql import functions as F

from sondera.functions.geodesy import _c

#: Reciprocal-celerity mixture, fixed values: weights, means and standard deviations (s/km).
RCEL_WEIGHTS = (0.0539, 0.0899, 0.8562)
RCEL_MEANS = (1 / 0.327, 1 / 0.293, 1 / 0.26)
RCEL_SDS = (0.066, 0.08, 0.33)


def normal_pdf(x, mean, sd) -> Column:
    z = (_c(x) - _c(mean)) / _c(sd)
    return F.exp(-0.5 * z * z) / (_c(sd) * sqrt(2 * pi))


def rcel_pdf(rcel) -> Column:
    """Density of a reciprocal celerity (s/km)."""
    return sum((w * normal_pdf(rcel, m, s) for w, m, s in zip(RCEL_WEIGHTS, RCEL_MEANS, RCEL_SDS, strict=True)), F.lit(0.0))


def _scaled(kg, km, p_amb: float, t_amb: float) -> Column:
    factor = (p_amb / 101.325) ** (1 / 3) * (t_amb / 288.15) ** (1 / 3)
    return F.lit(factor) / F.pow(_c(kg), F.lit(1 / 3)) * _c(km) * 1000.0


def overpressure(kg, km, p_amb: float = 101.325, t_amb: float = 288.15, kind: str = "chemical") -> Column:
    """Kinney-Graham peak overpressure (Pa) of a yield (kg TNT) at a range (km)."""
    z = _scaled(kg, km, p_amb, t_amb)
    root = lambda d: F.sqrt(1 + F.pow(z / d, 2))
    if kind == "chemical":
        ratio = 808.0 * (1 + F.pow(z / 4.5, 2)) / (root(0.048) * root(0.32) * root(1.35))
    else:
        ratio = 3.2e6 / F.pow(z, 3) * (1 + z / 800.0) * root(87.0)
    return ratio * p_amb * 1e3


def duration(kg, km, p_amb: float = 101.325, t_amb: float = 288.15, kind: str = "chemical") -> Column:
    """Kinney-Graham positive phase duration (s)."""
    z = _scaled(kg, km, p_amb, t_amb)
    if kind == "chemical":
        ms = 980.0 * (1 + F.pow(z / 0.54, 10)) / ((1 + F.pow(z / 0.02, 3)) * (1 + F.pow(z / 0.74, 6)) * F.sqrt(1 + F.pow(z / 6.9, 2)))
    else:
        low = F.sqrt(1 + z / 40.0) * F.pow(1 + F.pow(z / 285.0, 5), F.lit(1 / 6)) * F.pow(1 + z / 50000.0, F.lit(1 / 6))
        ms = 180.0 * F.sqrt(1 + F.pow(z / 100.0, 3)) / low
    return ms * F.pow(_c(kg), F.lit(1 / 3)) / 1e3


def _norm(a: float) -> float:
    x0 = (1 + a) - sqrt(1 + a)
    return x0**a * (1 - x0 / (1 + a)) * exp(-x0)


def blastwave(t, kg, km, shape: float = 0.0, **ambient) -> Column:
    """Overpressure (Pa) at time t (s) of a generalised Friedlander pulse; shape 0 is the Friedlander pulse."""
    x = _c(t) / duration(kg, km, **ambient) + (1 + shape)
    pulse = overpressure(kg, km, **ambient) / _norm(shape) * F.pow(x, F.lit(shape)) * (1 - x / (1 + shape)) * F.exp(-x)
    return F.when(x >= 0, pulse).otherwise(F.lit(0.0))


def blast_spectrum(f, kg, km, shape: float = 0.0, **ambient) -> Column:
    """Amplitude spectrum (Pa s) of the pulse at frequency f (Hz)."""
    t0 = duration(kg, km, **ambient)
    wt = 2 * pi * _c(f) * t0
    return overpressure(kg, km, **ambient) / _norm(shape) * t0 * gamma(shape + 1) * wt / F.pow(1 + wt * wt, F.lit(shape / 2 + 1))


def signal_duration(km, slow: float = 0.28, fast: float = 0.34) -> Column:
    """Length (s) of the window between the fastest and slowest arrivals, 5 s at least."""
    return F.greatest(F.lit(5.0), _c(km) * (fast - slow) / (slow * fast))


def arrival_window(t0, km, slow: float = 0.24, fast: float = 0.35) -> tuple[Column, Column]:
    """Earliest and latest arrival (epoch seconds) of a signal from km away."""
    return _c(t0) + _c(km) / fast, _c(t0) + _c(km) / slow


def celerity(km, seconds) -> Column:
    """km/s; null for no travel time."""
    return _c(km) / F.when(_c(seconds) != 0, _c(seconds))


def decibel(x) -> Column:
    return 10 * F.log10(_c(x))


def octave_bands(center: Column | float, order: float, n: int) -> Column:
    """2 n band frequencies around a centre, ascending: centre * 2 ** (k / order), k = -n..n without 0."""
    steps = F.array(*[F.lit(2.0 ** (k / order)) for k in [*range(-n, 0), *range(1, n + 1)]])
    return F.transform(steps, lambda s: s * _c(center))


def conf_ellipse_axes(sd_x, sd_y, cov, level: float) -> tuple[Column, Column, Column]:
    """(major, minor half axis, angle in degrees from x) of a confidence ellipse; the chi-square quantile is -2 ln(1 - p)."""
    from math import log

    q = sqrt(-2 * log(1 - level))
    xx, yy, xy = _c(sd_x) * _c(sd_x), _c(sd_y) * _c(sd_y), _c(cov)
    mid, gap = (xx + yy) / 2, F.sqrt(F.pow((xx - yy) / 2, 2) + xy * xy)
    return q * F.sqrt(mid + gap), q * F.sqrt(F.greatest(mid - gap, F.lit(0.0))), F.degrees(F.atan2(2 * xy, xx - yy) / 2)


def skew_normal_pdf(x, mean, sd, alpha) -> Column:
    """2 / sd * phi(z) * Phi(alpha z); Phi by the rational approximation of Abramowitz and Stegun 7.1.26 (error below 1.5e-7)."""
    z = (_c(x) - _c(mean)) / _c(sd)
    u = F.abs(_c(alpha) * z) / sqrt(2)
    t = 1 / (1 + 0.3275911 * u)
    #: Fixed values of 7.1.26.
    tail = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    erf = (1 - tail * F.exp(-u * u)) * F.signum(_c(alpha) * z)
    return 2 * normal_pdf(x, mean, sd) * (1 + erf) / 2
