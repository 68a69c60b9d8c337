"""The density of one event's place and origin time on a polar grid that is refined where the density is.

Cells are (distance, azimuth) about the centre of the region, and times. A cell
has its density in the middle and an upper bound of it anywhere inside: azimuths
may be nearer by the angle that half the cell spans from an array, travel times
by what crossing half of it takes. Cells whose bound can hold no share of the
mass that counts stay as they are, all others are divided by two in every
direction, and again, so the finest grid is reached only where it is needed.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from sondera.functions.numeric import _azimuth_and_km

#: Distances, azimuths and times of the coarsest grid.
COARSE = (12, 24, 24)
SPAN = (0.22, 0.34)  # celerities (km/s) that bound the origin time
PART = 1 << 13  # cells whose times are worked out at once


def _forward(lat0: float, lon0: float, arc: np.ndarray, az: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    la = np.radians(lat0)
    sine = np.sin(la) * np.cos(arc) + np.cos(la) * np.sin(arc) * np.cos(az)
    lon = np.radians(lon0) + np.arctan2(np.sin(az) * np.sin(arc) * np.cos(la), np.cos(arc) - np.sin(la) * sine)
    return np.degrees(np.arcsin(np.clip(sine, -1, 1))), np.degrees(lon)


def origin_span(dets: dict, centre: tuple, radius: float, sphere_km: float) -> tuple[float, float]:
    """Earliest and latest origin time that all detections with a time allow; nan if none has one."""
    timed = np.isfinite(dets["t"])
    if not timed.any():
        return np.nan, np.nan
    km = _azimuth_and_km(dets["lat"], dets["lon"], *centre, sphere_km)[1][timed]
    t = dets["t"][timed]
    return float((t - (km + radius) / SPAN[0]).max()), float((t - np.maximum(km - radius, 0) / SPAN[1]).min())


@lru_cache(maxsize=8)
def _celerities(mixture: tuple) -> tuple[float, float, tuple]:
    """Density of a mixture of normals as cubics with its own values and slopes at nodes: the first node, nodes per unit, coefficients.

    Nodes are a 128th of the least deviation apart (an error of some 1e-11 of the peak) and go to where every term underflows.
    """
    w, m, s = (np.array(v, float)[:, None] for v in mixture)
    step, lo = float(s.min()) / 128, float((m - 39 * s).min())
    x = lo + step * np.arange(int(np.ceil((float((m + 39 * s).max()) - lo) / step)) + 2)
    parts = w / (s * np.sqrt(2 * np.pi)) * np.exp(-0.5 * ((x - m) / s) ** 2)
    y, d = parts.sum(axis=0), (parts * (m - x) / s**2).sum(axis=0) * step
    rise = np.diff(y)
    return lo, 1 / step, (y[:-1], d[:-1], 3 * rise - 2 * d[:-1] - d[1:], d[:-1] + d[1:] - 2 * rise)


def density(dets: dict, lat: np.ndarray, lon: np.ndarray, at: np.ndarray, t: np.ndarray, mixture: tuple, sphere_km: float, half_km: np.ndarray | None = None, half_s: float = 0.0) -> np.ndarray:
    """Product over detections at places (lat, lon)[at] and times t; with ``half_km``, its upper bound within that distance and ``half_s``."""
    place, timed = np.ones(len(lat)), []
    for d_lat, d_lon, d_t, d_az, kappa in zip(*(dets[c] for c in ("lat", "lon", "t", "az", "kappa")), strict=True):
        az, km = _azimuth_and_km(d_lat, d_lon, lat, lon, sphere_km)
        km = np.maximum(km, 1e-3)
        half = np.zeros_like(km) if half_km is None else half_km
        if np.isfinite(d_az):
            away = np.abs((az - np.radians(d_az) + np.pi) % (2 * np.pi) - np.pi)
            slack = np.where(km > half, np.arcsin(np.minimum(half / km, 1.0)), np.pi)
            # i0 for large kappa: exp(kappa (cos - 1)) keeps the exponent small
            place *= np.exp(kappa * (np.cos(np.maximum(away - slack, 0)) - 1)) / (2 * np.pi * np.i0(kappa) * np.exp(-kappa))
        if np.isfinite(d_t):
            place /= np.maximum(km - half, 1e-3)
            timed.append((d_t, km, half))
    first, per, curve = _celerities(tuple(map(tuple, mixture)))

    def exact(since: np.ndarray, km: np.ndarray, own: np.ndarray) -> np.ndarray:
        since *= (per / km)[own]
        since -= first * per
        np.clip(since, 0.0, len(curve[0]) - 1e-6, out=since)
        i = since.astype(np.intp)
        since -= i
        f = curve[3][i]
        for c in curve[2::-1]:
            f *= since
            f += c[i]
        return f

    def above(since: np.ndarray, km: np.ndarray, half: np.ndarray, own: np.ndarray) -> np.ndarray:
        total = 0.0
        for w, m, s in zip(*mixture, strict=True):
            gap = np.maximum(np.abs(since - (km * m)[own]) - (half * m + half_s)[own], 0)
            total = total + w / (s * np.sqrt(2 * np.pi)) * np.exp(-0.5 * (gap / ((km + half) * s)[own]) ** 2)
        return total

    out = place[at]
    for lo in range(0, len(at), PART):
        part, own = slice(lo, lo + PART), at[lo : lo + PART]
        for d_t, km, half in timed:
            out[part] *= exact(d_t - t[part], km, own) if half_km is None else above(d_t - t[part], km, half, own)
    return out


def _numbered(x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct whole numbers below ``most``, and where each of ``x`` is among them."""
    if most > 8 * len(x) + 65_536:
        return np.unique(x, return_inverse=True)
    seen = np.zeros(most, bool)
    seen[x] = True
    return np.flatnonzero(seen), (np.cumsum(seen) - 1)[x]


def refined(dets: dict, centre: tuple, radius: float, mixture: tuple, sphere_km: float, coarse: tuple = COARSE, levels: int = 3, drop: float = 0.02) -> dict[str, np.ndarray]:
    """Cells of all levels: level, place (of its level's grid), k, lat, lon, t, p and the cell's size w (radians squared times seconds).

    A level's cells that are not divided hold, by their bounds, less than ``drop`` of the mass.
    """
    begin, end = origin_span(dets, centre, radius, sphere_km)
    timed = np.isfinite(begin)
    if timed and end <= begin:
        return {}
    base = begin if timed else 0.0
    dets = {**dets, "t": dets["t"] - base}
    nr, nz, nt = coarse if timed else (*coarse[:2], 1)
    i, j, k = (x.ravel() for x in np.meshgrid(np.arange(nr), np.arange(nz), np.arange(nt), indexing="ij"))
    found = []
    for level in range(levels + 1):
        dr, dz, dt = radius / (nr << level), 2 * np.pi / (nz << level), (end - begin) / (nt << level) if timed else 1.0
        places, at = _numbered(i * (nz << level) + j, (nr << level) * (nz << level))
        r = (places // (nz << level) + 0.5) * dr
        lat, lon = _forward(*centre, r / sphere_km, (places % (nz << level) + 0.5) * dz)
        t = (k + 0.5) * dt if timed else np.zeros(len(k))
        w = (np.sin(r / sphere_km) * dr / sphere_km * dz)[at] * dt
        p = density(dets, lat, lon, at, t, mixture, sphere_km)
        if level < levels:
            bound = density(dets, lat, lon, at, t, mixture, sphere_km, np.hypot(dr, r * dz) / 2, dt / 2) * w
            split = bound > drop * max((p * w).sum(), 1e-3 * bound.sum()) / len(k)
        if level == levels:
            found.append((np.full(len(k), level), places[at], k, lat[at], lon[at], t + base, p, w))
            break
        leaf = ~split
        found.append((np.full(leaf.sum(), level), places[at[leaf]], k[leaf], lat[at[leaf]], lon[at[leaf]], t[leaf] + base, p[leaf], w[leaf]))
        i, j, k = i[split], j[split], k[split]
        steps = [(a, b, c) for a in (0, 1) for b in (0, 1) for c in ((0, 1) if timed else (0,))]
        i, j = (np.concatenate([2 * x + s[n] for s in steps]) for n, x in ((0, i), (1, j)))
        k = np.concatenate([(2 * k + s[2]) if timed else k for s in steps])
    return dict(zip(("level", "place", "k", "lat", "lon", "t", "p", "w"), map(np.concatenate, zip(*found, strict=True)), strict=True))


def summary(cells: dict, level: float, sphere_km: float) -> tuple:
    """mass, mean lat, lon, t, deviations and covariance (km), deviation of t, most likely lat, lon, t, bounds of t that hold ``level``, cells."""
    m = cells["p"] * cells["w"]
    mass = m.sum()
    mean = lambda x: float(m @ x / mass)
    lat, lon, t0 = mean(cells["lat"]), mean(cells["lon"]), cells["t"].min()
    t = cells["t"] - t0
    deg = np.radians(1.0) * sphere_km
    y, x = (cells["lat"] - lat) * deg, (cells["lon"] - lon) * deg * np.cos(np.radians(lat))
    fine = cells["level"] == cells["level"].max()
    places, at = _numbered(cells["place"][fine], int(cells["place"][fine].max()) + 1)
    best = np.flatnonzero(fine)[at == np.argmax(np.bincount(at, weights=cells["p"][fine]))]
    best = best[np.argmax(cells["p"][best])]
    times, at = _numbered(cells["k"][fine], int(cells["k"][fine].max()) + 1)
    q = np.bincount(at, weights=m[fine]) / m[fine].sum()
    step = np.argsort(-q, kind="stable")
    inside = step[: int(np.searchsorted(np.cumsum(q[step]), level)) + 1]
    when = np.zeros(len(times))
    when[at] = cells["t"][fine]
    mt = mean(t)
    return (float(mass), lat, lon, t0 + mt, mean(x * x) ** 0.5, mean(y * y) ** 0.5, mean(x * y), mean((t - mt) ** 2) ** 0.5, float(cells["lat"][best]), float(cells["lon"][best]), float(cells["t"][best]), float(when[inside].min()), float(when[inside].max()), len(m))
