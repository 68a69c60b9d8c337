"""The older array analysis: a Cartesian slowness grid, power without coherence normalisation, and time-domain statistics of the lined-up channels."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondera.functions import geodesy, numeric
from sondera.operators.records import aligned, windows_of

#: method -> (kind, sub-windows, number of sources from a criterion)
METHODS = {
    "bartlett": ("bartlett", 1, None), "music": ("music", 16, None), "music16": ("music", 16, None), "music32": ("music", 32, None),
    "music16D": ("music", 16, "mdl"), "music32D": ("music", 32, "mdl"), "capon16": ("capon", 16, None), "capon32": ("capon", 32, None),
}
SCHEMA = "array_id string, t double, back_az double, slowness double, f_stat double, corr_min double, corr_mean double, corr_max double, rms double, sx double, sy double, source int"


@dataclass(frozen=True)
class Classic:
    """``slowness``: from, to, step (s/km) of both axes; ``overlap``: seconds that neighbouring windows share."""

    method: str = "bartlett"
    freq: tuple[float, float] = (0.5, 5.0)
    length: float = 30.0
    overlap: float = 15.0
    slowness: tuple[float, float, float] = (-3.6, 3.6, 0.05)
    sources: int = 1


def site_xy(sites: DataFrame, keys: list[str], lat: str = "lat", lon: str = "lon") -> DataFrame:
    """``sites`` with x and y: km east and north of the mean position of their group."""
    mean = sites.groupBy(*keys).agg(F.avg(lat).alias("__la"), F.avg(lon).alias("__lo"))
    arc, az, _ = geodesy.spherical_inv("__la", "__lo", lat, lon)
    km = F.radians(arc) * geodesy.SPHERE_KM
    return sites.join(mean, keys).withColumns({"x": km * F.sin(F.radians(az)), "y": km * F.cos(F.radians(az))}).drop("__la", "__lo")


def direction(sx: Column | str, sy: Column | str) -> tuple[Column, Column]:
    """(azimuth 0 to 360, slowness) of east and north slowness; the azimuth is counted from the second axis to the first."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (sx, sy))
    z = F.degrees(F.atan2(a, b))
    return F.when(z < 0, z + 360).otherwise(z), F.hypot(a, b)


#: Samples that a covariance averaged over frequencies counts as when sources are counted.
FEW = 3


def array_response(geometry: np.ndarray, f: np.ndarray, axis: np.ndarray, at: tuple[float, float] = (0.0, 0.0)) -> np.ndarray:
    """Mean power over frequencies of the array for a wave of slowness ``at``, on the grid axis x axis (rows: north)."""
    sx, sy = np.meshgrid(axis - at[0], axis - at[1])
    delays = sx[..., None] * geometry[:, 0] + sy[..., None] * geometry[:, 1]
    return np.mean([np.abs(np.exp(2j * np.pi * x * delays).mean(axis=-1)) ** 2 for x in f], axis=0)


def grid_power(x: np.ndarray, dt: float, geometry: np.ndarray, run: Classic) -> tuple[np.ndarray, np.ndarray, int]:
    """(power with rows north and columns east, axis, number of sources) of one window's channels."""
    kind, parts, criterion = METHODS[run.method]
    axis = np.arange(*run.slowness)
    m, n = x.shape
    size = n // parts
    taper = numeric.tukey(size, 0.2 if parts == 1 else 0.1)
    spec = np.stack([np.fft.rfft(x[:, k * size : (k + 1) * size] * taper, axis=1) for k in range(parts)])
    f = np.fft.rfftfreq(size, dt)
    band = (f >= run.freq[0]) & (f <= run.freq[1])
    spec, f = spec[:, :, band], f[band]
    cov = np.einsum("pmf,pnf->fmn", spec, spec.conj()) / parts
    sources = run.sources
    if criterion:
        values = np.linalg.eigvalsh(cov.mean(axis=0))  # a mean over frequencies, whose phases differ, counts as few samples
        sources = int(np.clip(numeric.model_order(np.maximum(values, 1e-300), criterion, FEW)[1], 1, m - 1))
    sx, sy = np.meshgrid(axis, axis)
    delays = np.stack([sx.ravel(), sy.ravel()], axis=1) @ geometry.T
    power = np.zeros(len(delays))
    for i, freq in enumerate(f):
        a = np.exp(-2j * np.pi * freq * delays) / np.sqrt(m)  # conjugate steering
        if kind == "bartlett":
            power += (np.abs(a @ spec[:, :, i].T) ** 2).sum(axis=1)
            continue
        s = cov[i]
        if kind == "capon":
            inner = np.linalg.inv(s + 1e-4 * np.trace(s).real / m * np.eye(m))
            power += ((a @ inner) * a.conj()).sum(axis=1).real  # inverted behind the sum over frequencies
        else:
            power += 1 / np.maximum((np.abs(a @ np.linalg.eigh(s)[1][:, : m - sources]) ** 2).sum(axis=1), 1e-12)
    power = 1 / power if kind == "capon" else power
    return power.reshape(len(axis), len(axis)), axis, sources


def run_classic(segments: DataFrame, run: Classic, extra: Callable[[np.ndarray, float, np.ndarray], None] | None = None) -> DataFrame:
    """Rows of SCHEMA: per window and source the direction of the power's peak and, for channels lined up along it, the F ratio, the
    least, mean and greatest positive correlation and the beam's root mean square. dx and dy of ``segments`` are in km here.

    A window without a peak, or one that fails, gives a row with slowness 0 and F -1. ``extra`` is called with each window's
    channels, sampling interval and geometry, in the workers.
    """
    w = windows_of(segments, run.length, run.length - run.overlap)
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def batches(found: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in found:
            out = []
            for array_id, start, channels, pieces in zip(pdf["array_id"], pdf["start"], pdf["channels"], pdf["pieces"], strict=True):
                x, dt, geometry = aligned(list(channels), list(pieces), start, run.length)
                geometry = geometry - geometry.mean(axis=0)
                if extra:
                    extra(x, dt, geometry)
                empty = (array_id, start, 0.0, 0.0, -1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)
                try:
                    power, axis, sources = grid_power(x, dt, geometry, run)
                    tops = numeric.grid_peaks(power, 5, sources)
                except np.linalg.LinAlgError:
                    tops, sources = [], 1
                spec = np.fft.rfft(x, axis=1)
                f = np.fft.rfftfreq(x.shape[1], dt)
                spec[:, (f < run.freq[0]) | (f > run.freq[1])] = 0
                narrow = np.fft.irfft(spec, x.shape[1], axis=1)
                for k in range(max(1, sources)):
                    if k >= len(tops):
                        out.append((*empty, k))
                        continue
                    i, j, _ = tops[k]
                    sx, sy = float(axis[j]), float(axis[i])
                    az = float(np.degrees(np.arctan2(sx, sy)) % 360)
                    beam = numeric.rolled_beam(narrow, 1 / dt, az, float(np.hypot(sx, sy)), geometry)
                    f_stat, low, mean, high, rms = numeric.fisher_and_correlations(beam)
                    out.append((array_id, start, az, float(np.hypot(sx, sy)), f_stat, low, mean, high, rms, sx, sy, k))
            yield pd.DataFrame(out, columns=names)

    return w.mapInPandas(batches, SCHEMA)
