"""Likelihoods of a source position and time, as columns. A detection is a struct with lat, lon, t, az, f_stat, channels."""

from __future__ import annotations

from itertools import product
from math import pi, sqrt

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondera.functions import circular, geodesy, numeric, physics


def range_km(det: Column, lat: Column, lon: Column) -> Column:
    return F.radians(geodesy.haversine(det["lat"], det["lon"], lat, lon)) * geodesy.SPHERE_KM


def azimuth_pdf(det: Column, lat: Column, lon: Column, kappa: Column | None = None) -> Column:
    """Von Mises density of the back azimuth; 1 for a detection without one."""
    kappa = circular.von_mises_kappa(det["f_stat"], det["channels"]) if kappa is None else kappa
    _, az, _ = geodesy.spherical_inv(det["lat"], det["lon"], lat, lon)
    return F.coalesce(circular.von_mises_pdf(az - det["az"], kappa), F.lit(1.0))


def range_celerity_pdf(det: Column, lat: Column, lon: Column, t: Column) -> Column:
    """Density of the travel time, from the reciprocal-celerity mixture; 1 for a detection without a time."""
    km = F.greatest(range_km(det, lat, lon), F.lit(1e-3))
    return F.coalesce(physics.rcel_pdf((det["t"] - t) / km) / km, F.lit(1.0))


def joint_pdf(det: Column, lat: Column, lon: Column, t: Column) -> Column:
    return azimuth_pdf(det, lat, lon) * range_celerity_pdf(det, lat, lon, t)


def pair_time_marginal(t1: Column, t2: Column, km1: Column, km2: Column) -> Column:
    """Two detections' travel-time density with the origin time integrated out, in closed form: nine Gaussian terms.

    For components i, j the product of N(t1 - km1 m_i, km1 s_i) and N(t2 - km2 m_j, km2 s_j) integrates to a Gaussian of the difference.
    """
    out = F.lit(0.0)
    for (wi, mi, si), (wj, mj, sj) in product(zip(physics.RCEL_WEIGHTS, physics.RCEL_MEANS, physics.RCEL_SDS, strict=True), repeat=2):
        gap = (t1 - km1 * mi) - (t2 - km2 * mj)
        var = km1 * km1 * (si * si) + km2 * km2 * (sj * sj)
        out = out + wi * wj * F.exp(-0.5 * gap * gap / var) / F.sqrt(2 * pi * var)
    return out


#: Standard deviations (s) of a first P and S arrival about its table's travel time.
PHASE_SD = {"p": 3.0, "s": 6.0}


def seismic_pdf(seconds: Column, expected: Column, phase: str = "p") -> Column:
    """Density of a seismic arrival ``seconds`` after the origin about the travel time of a table (see ``travel_times``)."""
    sd = PHASE_SD[phase]
    z = (seconds - expected) / sd
    return F.exp(-0.5 * z * z) / (sd * sqrt(2 * pi))


def travel_times(points: DataFrame, km: str, table: DataFrame, phase: str = "p", out: str = "expected") -> DataFrame:
    """``points`` with the table's travel time at a distance. ``table``: deg, p, s as read from a first-arrival table; a cubic spline through it."""
    from sondera.sources.tables import along, curve

    pieces = curve(table.withColumn("km", F.radians("deg") * geodesy.SPHERE_KM), "km", phase, "cubic")
    return along(points, km, pieces, out)


def time_marginals(points: DataFrame, most: int = 100) -> DataFrame:
    """``points`` (t, km: arrays of arrival times and ranges; optionally st, stt, ssd: seismic arrivals, travel times, deviations) with
    pdf: their joint density with the origin time integrated out.

    Up to ``most`` sequences of components (3 to the number of arrivals) the integral is a sum of Gaussians in closed form; beyond,
    it is Simpson's rule on ``most`` times between the earliest and latest possible origin.
    """
    schema = points.withColumn("pdf", F.lit(0.0)).schema
    mixture = tuple(np.array(x, float) for x in (physics.RCEL_WEIGHTS, physics.RCEL_MEANS, physics.RCEL_SDS))

    def batches(found):
        for pdf in found:
            made = []
            for row in pdf.to_dict("records"):
                seismic = [np.asarray(row.get(c) if row.get(c) is not None else [], float) for c in ("st", "stt", "ssd")]
                made.append(time_marginal(np.asarray(row["t"], float), np.asarray(row["km"], float), mixture, *seismic, most=most))
            yield pdf.assign(pdf=made)

    return points.mapInPandas(batches, schema)


def time_marginal(t: np.ndarray, km: np.ndarray, mixture: tuple, st: np.ndarray, stt: np.ndarray, ssd: np.ndarray, most: int = 100) -> float:
    """See ``time_marginals``; without any arrival that has a mixture, 1."""
    n, (wt, mn, sd) = len(t), mixture
    if not n:
        return 1.0
    km = np.maximum(km, 1e-3)
    base = t[0]
    t, st = t - base, st - base
    if len(wt) ** n <= most:
        picks = np.array(list(product(range(len(wt)), repeat=n)))
        shift, width = t - km * mn[picks], km * sd[picks]
        a = (width**-2.0).sum(axis=1) + (ssd**-2.0).sum()
        b = (shift / width**2).sum(axis=1) + ((st - stt) / ssd**2).sum()
        c = ((shift / width) ** 2).sum(axis=1) + (((st - stt) / ssd) ** 2).sum()
        terms = np.prod(wt[picks] / width, axis=1) / np.sqrt(a) * np.exp(-0.5 * (c - b * b / a))
        return float(terms.sum() / np.prod(ssd) / (2 * np.pi) ** ((n + len(st) - 1) / 2))
    lo, hi = (t - km / 0.2).max(), (t - km / 0.4).min()
    if len(st):
        lo, hi = max(lo, (st - stt - 6 * ssd).max()), min(hi, (st - stt + 6 * ssd).min())
    if hi <= lo:
        return 0.0
    x = np.linspace(lo, hi, most)
    rc = (t[:, None] - x) / km[:, None]
    dens = (wt[:, None, None] / sd[:, None, None] * np.exp(-0.5 * ((rc - mn[:, None, None]) / sd[:, None, None]) ** 2)).sum(axis=0) / np.sqrt(2 * np.pi) / km[:, None]
    value = dens.prod(axis=0)
    for s, m, d in zip(st, stt, ssd, strict=True):
        value = value * np.exp(-0.5 * ((s - m - x) / d) ** 2) / (d * np.sqrt(2 * np.pi))
    return numeric.simpson_sum(value, (hi - lo) / (most - 1))
