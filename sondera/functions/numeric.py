"""Small numpy kernels that run inside Arrow batches. Nothing in here knows Spark."""

from __future__ import annotations

from functools import lru_cache
from math import exp, lgamma, log, log1p
from statistics import NormalDist

import numpy as np

# ------------------------------------------------------------------ densities


def incomplete_beta(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(1 - x, b, a)
    front = exp(a * log(x) + b * log1p(-x) + lgamma(a + b) - lgamma(a) - lgamma(b)) / a
    tiny, c = 1e-300, 1.0
    d = 1 / (1 - (a + b) * x / (a + 1) or tiny)
    total = d
    for m in range(1, 500):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + step * d) or tiny)
            c = (1 + step / c) or tiny
            total *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * total


def f_cdf(x: float, d1: float, d2: float) -> float:
    return incomplete_beta(d1 * x / (d1 * x + d2), d1 / 2, d2 / 2) if x > 0 else 0.0


@lru_cache(maxsize=256)
def f_ppf(p: float, d1: float, d2: float) -> float:
    """Quantile of the F distribution, by bisection."""
    lo, hi = 0.0, 1.0
    while f_cdf(hi, d1, d2) < p:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f_cdf(mid, d1, d2) < p else (lo, mid)
    return (lo + hi) / 2


def f_mode(d1: float, d2: float) -> float:
    return (d1 - 2) / d1 * d2 / (d2 + 2) if d1 > 2 else 0.0


def kde(points: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Gaussian kernel density with Scott's bandwidth n ** (-1/5) times the sample deviation."""
    n = len(points)
    width = max(np.std(points, ddof=1) * n**-0.2 if n > 1 else 0.0, 1e-12)
    z = (at[:, None] - points[None, :]) / width
    return np.exp(-0.5 * z * z).sum(axis=1) / (n * width * np.sqrt(2 * np.pi))


def kde_mode(points: np.ndarray, grid: int = 200) -> float:
    """The highest point of the density: a grid, then a parabola through its top three points."""
    lo, hi = points.min(), points.max()
    if hi <= lo:
        return float(lo)
    at = np.linspace(lo, hi, grid)
    y = kde(points, at)
    i = int(np.clip(np.argmax(y), 1, grid - 2))
    curve = y[i - 1] - 2 * y[i] + y[i + 1]
    shift = 0.5 * (y[i - 1] - y[i + 1]) / curve if curve < 0 else 0.0
    return float(at[i] + np.clip(shift, -1, 1) * (at[1] - at[0]))


def detection_threshold(values: np.ndarray, p: float, time_bandwidth: float, channels: int) -> float:
    """F threshold of false-alarm probability p, scaled to where the noise's F values have their mode."""
    d1, d2 = time_bandwidth, time_bandwidth * (channels - 1)
    return f_ppf(1 - p, d1, d2) * kde_mode(values) / f_mode(d1, d2)


# --------------------------------------------------------------------- arrays

TAPERS = {
    "boxcar": np.ones,
    "hanning": np.hanning,
    "hamming": np.hamming,
    "bartlett": np.bartlett,
    "blackman": np.blackman,
    "tukey": lambda n: tukey(n, 0.5),
}


def tukey(n: int, share: float) -> np.ndarray:
    """Cosine-tapered window; ``share`` of it is taper."""
    x = np.arange(n) / max(n - 1, 1)
    edge = np.minimum(np.minimum(x, 1 - x) / max(share / 2, 1e-12), 1.0)
    return 0.5 * (1 - np.cos(np.pi * edge))


def detrended(x: np.ndarray) -> np.ndarray:
    """Rows without their least-squares line."""
    t = np.arange(x.shape[-1]) - (x.shape[-1] - 1) / 2
    slope = (x * t).sum(axis=-1) / max((t * t).sum(), 1e-300)
    return x - x.mean(axis=-1, keepdims=True) - slope[..., None] * t


def spectra(x: np.ndarray, dt: float, sub: int | None = None, overlap: float = 0.5, taper: str = "hanning") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spectrum X[M, F], covariance S[F, M, M] and frequencies of channels x[M, N].

    With sub-windows of ``sub`` samples, X and S are means over them.
    """
    if not 0 <= overlap <= 0.9:
        raise ValueError("overlap is to be between 0 and 0.9")
    n = sub or x.shape[1]
    starts = range(0, x.shape[1] - n + 1, max(1, int(n * (1 - overlap)))) if sub else [0]
    size = 1 << max(0, n - 1).bit_length()
    parts = np.stack([np.fft.rfft(x[:, s : s + n] * TAPERS[taper](n), size) * dt for s in starts])
    cov = np.einsum("wmf,wnf->fmn", parts, parts.conj()) / len(parts)
    return parts.mean(axis=0), cov, np.fft.rfftfreq(size, dt)


METHODS = {"bartlett": "bartlett", "bartlett_covar": "bartlett_covar", "gls": "gls", "capon": "capon", "mvdr": "capon", "music": "music"}


def _powers(x: np.ndarray, cov: np.ndarray, freq: float, delays: np.ndarray, method: str, signals: int, noise_inverse: np.ndarray | None) -> np.ndarray:
    """Power [W, K] of W windows at one frequency; x[W, M], cov[W, M, M], noise_inverse[M, M]."""
    m = x.shape[1]
    a = np.exp(-2j * np.pi * freq * delays) / np.sqrt(m)  # conjugate steering, K x M
    size = np.maximum((np.abs(x) ** 2).sum(axis=1), 1e-300)[:, None]
    form = lambda b: ((a @ b) * a.conj()).sum(axis=-1).real  # noqa: E731  # of one matrix, or of a stack
    if method == "bartlett":
        return np.abs(x @ a.T) ** 2 / size
    if method == "gls":
        b = np.eye(m) if noise_inverse is None else noise_inverse
        return np.abs(x @ (a @ b).T) ** 2 / form(b) ** 2 / size
    if method == "bartlett_covar":
        return form(cov) / np.maximum(np.trace(cov, axis1=1, axis2=2).real, 1e-300)[:, None]
    if method == "capon":
        load = 1e-3 * np.trace(cov, axis1=1, axis2=2).real / m
        top = np.maximum(np.linalg.eigvalsh(cov)[:, -1], 1e-300)
        return 1 / form(np.linalg.inv(cov + np.maximum(load, 1e-300)[:, None, None] * np.eye(m))) / top[:, None]
    vectors = np.linalg.eigh(cov)[1][:, :, : m - signals]
    return 1 / np.maximum((np.abs(a @ vectors) ** 2).sum(axis=2), 1e-12)


def beam_power(x: np.ndarray, cov: np.ndarray, f: np.ndarray, delays: np.ndarray, method: str = "bartlett", signals: int = 1, noise_inverse: np.ndarray | None = None, weights: np.ndarray | None = None) -> np.ndarray:
    """Mean power over frequencies, [W, K], of W windows for each row of delays[K, M]; x[W, M, F], cov[W, F, M, M].

    Steering vectors are made once per frequency and serve all windows. ``noise_inverse[F, M, M]`` is for generalised least
    squares, ``weights[F]`` or ``weights[W, F]`` for a weighted mean over frequencies.
    """
    method, total = METHODS[method.lower()], np.zeros((len(x), len(delays)))
    w = np.ones((1, len(f))) if weights is None else np.atleast_2d(weights)
    for i, freq in enumerate(f):
        total += w[:, i, None] * _powers(x[:, :, i], cov[:, i], freq, delays, method, signals, None if noise_inverse is None else noise_inverse[i])
    return total / np.maximum(w.sum(axis=1), 1e-300)[:, None]


def arrival_weights(x: np.ndarray, cov: np.ndarray, f: np.ndarray, delays: np.ndarray, slowness: np.ndarray, method: str, signals: int = 1, noise_inverse: np.ndarray | None = None) -> np.ndarray:
    """Weights [W, F] of frequencies by how well the direction of their own peak agrees with the mean direction.

    A peak's direction is the unit vector of its horizontal slowness, scaled by the grid's least velocity, and what is left upwards;
    the weight is half of one plus the projection on the mean, plus the directions' spread.
    """
    c = 1 / np.hypot(*slowness.T).max()
    rows = []
    for i, freq in enumerate(f):
        p = _powers(x[:, :, i], cov[:, i], freq, delays, METHODS[method.lower()], signals, None if noise_inverse is None else noise_inverse[i])
        rows.append(c * slowness[np.argmax(p, axis=1)])
    flat = np.stack(rows, axis=1)  # W x F x 2
    way = np.concatenate([flat, np.sqrt(1 - 0.99 * (flat**2).sum(axis=2, keepdims=True))], axis=2)
    return (1 + (way * way.mean(axis=1, keepdims=True)).sum(axis=2)) / 2 + np.sqrt(way.var(axis=1).sum(axis=1))[:, None]


def _top(grid: np.ndarray, i: int, j: int, az: np.ndarray, vel: np.ndarray) -> tuple[float, float, float]:
    """(azimuth, velocity, power) of the quadric through a grid point and its neighbours; the point itself at an edge or where the quadric has no extreme."""
    if not (0 < i < len(vel) - 1 and 0 < j < len(az) - 1):
        return float(az[j]), float(vel[i]), float(grid[i, j])
    near = grid[i - 1 : i + 2, j - 1 : j + 2]
    slope = np.array([near[1, 2] - near[1, 0], near[2, 1] - near[0, 1]]) / 2
    cross = (near[2, 2] - near[2, 0] - near[0, 2] + near[0, 0]) / 4
    bend = np.array([[near[1, 2] - 2 * near[1, 1] + near[1, 0], cross], [cross, near[2, 1] - 2 * near[1, 1] + near[0, 1]]])
    if np.linalg.det(bend) <= 0:
        return float(az[j]), float(vel[i]), float(near[1, 1])
    move = -np.linalg.solve(bend, slope)
    return float(az[j] + move[0] * (az[1] - az[0])), float(vel[i] + move[1] * (vel[1] - vel[0])), float(near[1, 1] + slope @ move / 2)


def peaks(power: np.ndarray, az: np.ndarray, vel: np.ndarray, signals: int = 1) -> list[tuple[float, float, float]]:
    """(azimuth, velocity, power) of up to ``signals`` tops of a velocity-major grid, the highest first.

    One signal is the grid's top; several are the maxima along azimuth of the highest power over velocities.
    """
    grid = power.reshape(len(vel), len(az))
    if signals < 2:
        i, j = np.unravel_index(np.argmax(grid), grid.shape)
        return [_top(grid, i, j, az, vel)]
    line = grid.max(axis=0)
    at = [j for j in range(1, len(az) - 1) if line[j - 1] <= line[j] >= line[j + 1]]
    found = [_top(grid, int(np.argmax(grid[:, j])), j, az, vel) for j in at]
    return sorted(found, key=lambda t: -t[2])[:signals]


def best_beam(x: np.ndarray, f: np.ndarray, delays: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spectrum of the beam along one delay vector and what is left of each channel without it."""
    a = np.exp(2j * np.pi * f[None, :] * delays[:, None])
    beam = (a.conj() * x).sum(axis=0) / (np.abs(a) ** 2).sum(axis=0)
    return beam, x - beam * a


def pure_state(cov: np.ndarray) -> np.ndarray:
    """Degree of polarisation per frequency of S[F, M, M]; 1 for one coherent wave, 0 for white noise."""
    m = cov.shape[1]
    d = np.sqrt(np.einsum("fmm->fm", cov).real)
    c = cov / np.maximum(d[:, :, None] * d[:, None, :], 1e-300)
    tr, tr2 = np.einsum("fmm->f", c).real, np.einsum("fmn,fnm->f", c, c).real
    return np.sqrt(np.maximum(m * tr2 - tr**2, 0) / ((m - 1) * tr**2))


# ----------------------------------------------------------------- clustering

#: Lance-Williams updates: weights of the two merged clusters' distances (and of their difference).
_LINKAGE = {
    "single": lambda a, b, na, nb: np.minimum(a, b),
    "complete": lambda a, b, na, nb: np.maximum(a, b),
    "average": lambda a, b, na, nb: (na * a + nb * b) / (na + nb),
    "weighted": lambda a, b, na, nb: (a + b) / 2,
}


def cut_linkage(dist: np.ndarray, threshold: float, linkage: str = "weighted") -> np.ndarray:
    """Flat clusters of hierarchical clustering cut at a distance, numbered by their first member.

    Chains of nearest neighbours: all four linkages are reducible, so pairs that are each other's nearest may be merged
    in any order, and the whole takes n squared steps. Merges above the threshold are made, but not kept.
    """
    n = len(dist)
    d = dist.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    size, alive, chain = np.ones(n), np.ones(n, bool), []
    up = np.arange(n)
    for _ in range(n - 1):
        if not chain:
            chain = [int(np.argmax(alive))]
        while True:
            i = chain[-1]
            row = np.where(alive, d[i], np.inf)
            j = int(np.argmin(row))
            if len(chain) > 1 and row[chain[-2]] <= row[j]:
                j = chain[-2]
                break
            chain.append(j)
        gap = d[i, j]
        del chain[-2:]
        row = _LINKAGE[linkage](d[i], d[j], size[i], size[j])
        i, j = min(i, j), max(i, j)
        d[i], d[:, i] = row, row
        d[i, i] = np.inf
        size[i] += size[j]
        alive[j] = False
        if gap <= threshold:
            up[up == up[j]] = up[i]
    _, first, number = np.unique(up, return_index=True, return_inverse=True)
    return np.argsort(np.argsort(first))[number]


def trimmed_clusters(dist: np.ndarray, threshold: float, linkage: str, ratio: float, smallest: int = 3) -> np.ndarray:
    """Clusters after outliers are cut off: while a cluster's largest distance is over ``ratio`` times its median, its worst member's nearest link is cut and all is clustered again."""
    work = dist.astype(float).copy()
    for _ in range(len(dist)):
        labels, cut = cut_linkage(work, threshold, linkage), False
        for k in range(labels.max() + 1 if len(labels) else 0):
            own = np.flatnonzero(labels == k)
            if len(own) < smallest:
                continue
            part = work[np.ix_(own, own)]
            upper = part[np.triu_indices(len(own), 1)]
            if upper.max() > ratio * np.median(upper):
                mean = part.sum(axis=1)
                worst = int(np.argmax(mean))
                others = np.delete(np.arange(len(own)), worst)
                near = others[np.argmin(part[worst, others])]
                far = max(dist.max(), threshold) + 1
                work[own[worst], own[near]] = work[own[near], own[worst]] = far
                cut = True
        if not cut:
            break
    return labels


def spectrogram(x: np.ndarray, dt: float, n: int, overlap: float = 0.8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(times, frequencies, power density) with a quarter-cosine taper and no mean."""
    step = max(1, n - int(n * overlap))
    parts = np.lib.stride_tricks.sliding_window_view(x, n)[::step]
    w = tukey(n, 0.25)
    power = np.abs(np.fft.rfft((parts - parts.mean(axis=1, keepdims=True)) * w, axis=1)) ** 2 * dt / (w * w).sum()
    power[:, 1 : (n + 1) // 2] *= 2
    return (np.arange(len(parts)) * step + n / 2) * dt, np.fft.rfftfreq(n, dt), power


def fitted(model, x: np.ndarray, y: np.ndarray, start: np.ndarray, rounds: int = 60) -> np.ndarray | None:
    """Least-squares parameters of model(x, *p) by damped Gauss-Newton steps with numerical slopes; null if it does not settle."""
    p, damp = np.array(start, float), 1e-3
    rest = y - model(x, *p)
    for _ in range(rounds):
        step = 1e-4 * np.maximum(np.abs(p), 1e-2)
        slopes = np.stack([(model(x, *(p + step * (np.arange(len(p)) == k))) - model(x, *p)) / step[k] for k in range(len(p))], axis=1)
        normal, way = slopes.T @ slopes, slopes.T @ rest
        if not np.isfinite(normal).all():
            return None
        move = np.linalg.lstsq(normal + damp * np.diag(np.diag(normal) + 1e-12), way, rcond=None)[0]
        new = y - model(x, *(p + move))
        if np.isfinite(new).all() and (new**2).sum() <= (rest**2).sum():
            done = (rest**2).sum() - (new**2).sum() <= 1e-9 * max((rest**2).sum(), 1e-300)
            p, rest, damp = p + move, new, max(damp / 5, 1e-12)
            if done:
                return p
        else:
            damp *= 10
            if damp > 1e9:
                return p
    return None


def _normal(z: np.ndarray) -> np.ndarray:
    return np.exp(-0.5 * z * z) / np.sqrt(2 * np.pi)


def _normal_cdf(z: np.ndarray) -> np.ndarray:
    """By the approximation 7.1.26 of Abramowitz and Stegun (error below 1.5e-7); its coefficients are fixed values."""
    u = np.abs(z) / np.sqrt(2)
    t = 1 / (1 + 0.3275911 * u)
    tail = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * np.exp(-u * u)
    return np.where(z >= 0, 1 - tail / 2, tail / 2)


def skew_normal(x: np.ndarray, skew: float, at: float, width: float) -> np.ndarray:
    z = (x - at) / width
    return 2 / width * _normal(z) * _normal_cdf(skew * z)


def skew_normal_quantile(p: float, skew: float, at: float, width: float) -> float:
    """Quantile by the trapezoid rule on 4,001 points of plus and minus 10 widths."""
    x = at + width * np.linspace(-10, 10, 4001)
    y = skew_normal(x, skew, at, width)
    mass = np.r_[0, np.cumsum((y[1:] + y[:-1]) / 2) * (x[1] - x[0])]
    return float(np.interp(p, mass / mass[-1], x))


def simpson_sum(y: np.ndarray, step: float) -> float:
    """Simpson's rule; an even number of points leaves the last interval to the trapezoid rule."""
    odd = len(y) if len(y) % 2 else len(y) - 1
    w = np.ones(odd)
    w[1:-1:2], w[2:-1:2] = 4, 2
    return float((w * y[:odd]).sum() * step / 3 + (0.0 if len(y) % 2 else (y[-1] + y[-2]) * step / 2))


#: Shapes of skew normals that are told apart, and the quantiles that tell them; bursts lie above the last.
_SHAPES = np.linspace(-8, 8, 161)
_CORE = (0.05, 0.4, 0.75)


@lru_cache(maxsize=64)
def _skew_quantiles(p: float) -> np.ndarray:
    """The ``p`` quantile of the standard skew normal of every shape; p below 0 gives the modes."""
    z = np.linspace(-8, 8, 6401)
    y = np.stack([skew_normal(z, a, 0.0, 1.0) for a in _SHAPES])
    if p < 0:
        return z[np.argmax(y, axis=1)]
    mass = np.cumsum(y, axis=1) * (z[1] - z[0])
    return np.array([np.interp(p, m, z) for m in mass / mass[:, -1:]])


def background_thresholds(groups: list[np.ndarray], p: float) -> tuple[np.ndarray, np.ndarray]:
    """(thresholds, peaks) of levels' backgrounds: each the lower of two quantiles of false-alarm probability ``p``.

    One is that of the normal with the mean and deviation of the values' kernel density, which are the sample's own, the variance and
    that of the kernel (Scott's bandwidth) added. The other is that of the skew normal with three of the sample's quantiles, which bursts
    do not reach: how far the middle one is from half-way gives the shape, the outer ones the width.
    """
    n = np.array([len(v) for v in groups], float)
    mean, sd = np.array([np.mean(v) for v in groups]), np.array([np.std(v, ddof=1) if len(v) > 1 else 0.0 for v in groups])
    plain = mean + np.sqrt(sd**2 * ((n - 1) / n + n**-0.4)) * NormalDist().inv_cdf(1 - p)
    low, middle, high = np.array([np.quantile(v, _CORE) for v in groups]).T
    a, b, c = (_skew_quantiles(q) for q in _CORE)
    shapes = (c + a - 2 * b) / (c - a)
    lean = (high + low - 2 * middle) / np.maximum(high - low, 1e-300)
    shape = np.interp(lean, shapes, _SHAPES)
    of = lambda q: np.interp(shape, _SHAPES, q)
    width = (high - low) / (of(c) - of(a))
    at = middle - width * of(b)
    out, peak = np.minimum(plain, at + width * of(_skew_quantiles(1 - p))), at + width * of(_skew_quantiles(-1.0))
    flat = high <= low
    return np.where(flat, np.where(sd > 0, plain, mean), out), np.where(flat, middle, peak)


def background_threshold(values: np.ndarray, p: float) -> tuple[float, float]:
    """(threshold, peak) of one level's background, see ``background_thresholds``."""
    threshold, peak = background_thresholds([values], p)
    return float(threshold[0]), float(peak[0])


def smoothed(y: np.ndarray, width: int = 49, order: int = 3) -> np.ndarray:
    """Local polynomials of odd ``width``; the ends take the polynomial of the first and last whole window."""
    width = min(width, len(y) - 1 + len(y) % 2)
    if width <= order:
        return y.astype(float)
    half = width // 2
    t = np.arange(-half, half + 1)
    fit = np.linalg.pinv(np.vander(t, order + 1, increasing=True))
    out = np.convolve(y, fit[0][::-1], "same").astype(float)
    head, tail = fit @ y[:width], fit @ y[-width:]
    out[:half] = np.vander(t[:half], order + 1, increasing=True) @ head
    out[-half:] = np.vander(t[-half:], order + 1, increasing=True) @ tail
    return out


def spline(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Coefficients [power, piece, ...] in (x - lower end) of the cubic spline through y[point, ...] whose third derivative is continuous
    at the second and the last but one point; a parabola through three points, a line through two.

    The end conditions give the outer second derivatives by the next two, which leaves a tridiagonal system, solved by elimination.
    """
    x, y = np.asarray(x, float), np.asarray(y, float)
    shape, y = y.shape[1:], y.reshape(len(x), -1)
    h = np.diff(x)
    slope = np.diff(y, axis=0) / h[:, None]
    bend, n = np.zeros_like(y), len(x)
    if n == 3:
        bend[:] = 2 * (slope[1] - slope[0]) / (h[0] + h[1])
    elif n > 3:
        low, main, up, rest = h[:-1].copy(), 2 * (h[:-1] + h[1:]), h[1:].copy(), 6 * np.diff(slope, axis=0)
        a, b = h[0] / h[1], h[-1] / h[-2]
        main[0], up[0] = main[0] + h[0] * (1 + a), up[0] - h[0] * a
        main[-1], low[-1] = main[-1] + h[-1] * (1 + b), low[-1] - h[-1] * b
        for k in range(1, n - 2):
            w = low[k] / main[k - 1]
            main[k] -= w * up[k - 1]
            rest[k] -= w * rest[k - 1]
        bend[n - 2] = rest[-1] / main[-1]
        for k in range(n - 4, -1, -1):
            bend[k + 1] = (rest[k] - up[k] * bend[k + 2]) / main[k]
        bend[0], bend[-1] = bend[1] + a * (bend[1] - bend[2]), bend[-2] + b * (bend[-2] - bend[-3])
    h = h[:, None]
    out = np.stack([y[:-1], slope - h * (2 * bend[:-1] + bend[1:]) / 6, bend[:-1] / 2, np.diff(bend, axis=0) / (6 * h)])
    return out.reshape(4, n - 1, *shape)


def wavelet_power(x: np.ndarray, dt: float, f: np.ndarray, cycles: float = 5.0) -> np.ndarray:
    """|CWT|^2 [F, N] with Morlet wavelets whose width is cycles / (2 pi f)."""
    n = len(x)
    size = 1 << (2 * n - 1).bit_length()
    spec, w = np.fft.fft(x, size), 2 * np.pi * np.fft.fftfreq(size, dt)
    scale = cycles / (2 * np.pi * np.asarray(f))[:, None]
    wave = np.pi**-0.25 * np.sqrt(2 * np.pi * scale / dt) * np.exp(-0.5 * (w * scale - cycles) ** 2) * (w > 0)
    return np.abs(np.fft.ifft(spec * wave, axis=1)[:, :n]) ** 2


def stft(x: np.ndarray, dt: float, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(times, frequencies, complex spectra [T, F]) with half-overlapping periodic Hann windows, zeros beyond both ends."""
    half, w = n // 2, 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    padded = np.r_[np.zeros(half), x, np.zeros(half + (-len(x)) % half)]
    parts = np.lib.stride_tricks.sliding_window_view(padded, n)[::half]
    return np.arange(len(parts)) * half * dt, np.fft.rfftfreq(n, dt), np.fft.rfft(parts * w, axis=1) / w.sum()


# ------------------------------------------------------------- source counting


def model_order(values: np.ndarray, penalty: str = "aic", snapshots: int = 1) -> tuple[np.ndarray, int]:
    """(criterion of 0, 1, .. m - 1 sources, the number with the least) of a covariance's eigenvalues from ``snapshots`` samples.

    After Wax and Kailath (1985): if k sources are there, the m - k smallest eigenvalues are equal, and by how much they are not is the
    ratio of their geometric to their arithmetic mean, to the power of (m - k) snapshots. A model of k sources has k (2 m - k) free
    parameters, which "aic" counts twice against twice the log likelihood and "mdl" by half the logarithm of the snapshots.
    """
    values = np.sort(np.asarray(values, float))
    m = len(values)
    sizes = np.arange(m, 0, -1)  # of the noise, for 0, 1, .. sources
    arithmetic, geometric = np.cumsum(values)[::-1] / sizes, np.cumsum(np.log(values))[::-1] / sizes
    misfit = snapshots * sizes * (np.log(arithmetic) - geometric)
    free = np.arange(m) * (2 * m - np.arange(m))
    out = 2 * (misfit + free) if penalty == "aic" else misfit + free * np.log(snapshots) / 2
    return out, int(np.argmin(out))


def grid_peaks(grid: np.ndarray, size: int = 3, count: int = 1) -> list[tuple[int, int, float]]:
    """(row, column, value) of the points that are the highest of the square of ``size`` about them and not zero, the highest first."""
    half = size // 2
    padded = np.pad(grid, half, mode="symmetric")
    around = np.lib.stride_tricks.sliding_window_view(padded, (size, size)).max(axis=(2, 3))
    rows, cols = np.nonzero((grid == around) & (grid != 0))
    order = np.argsort(-grid[rows, cols], kind="stable")[:count]
    return [(int(rows[i]), int(cols[i]), float(grid[rows[i], cols[i]])) for i in order]


def rolled_beam(x: np.ndarray, fs: float, az: float, slowness: float, geometry: np.ndarray) -> np.ndarray:
    """Channels rolled by whole samples so that a plane wave from ``az`` (degrees) with ``slowness`` lines up."""
    way = np.array([np.sin(np.radians(az)), np.cos(np.radians(az))])
    lag = np.rint(geometry @ way * slowness * fs).astype(int)
    return np.stack([np.roll(row, k) for row, k in zip(x, lag, strict=True)])


def correlation_beam(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(channels rolled to where they correlate best with the first, those greatest correlations)."""
    n = x.shape[1]
    z = (x - x.mean(axis=1, keepdims=True)) / np.maximum(x.std(axis=1, keepdims=True), 1e-300)
    size = 1 << (2 * n - 1).bit_length()
    cross = np.fft.irfft(np.fft.rfft(z[0], size) * np.fft.rfft(z, size, axis=1).conj(), size)
    cross = np.concatenate([cross[:, -(n - 1) :], cross[:, :n]], axis=1) / n  # lags -(n - 1) .. n - 1
    top = np.argmax(cross, axis=1)
    return np.stack([np.roll(row, k - n + 1) for row, k in zip(x, top, strict=True)]), cross.max(axis=1)


def fisher_and_correlations(x: np.ndarray) -> tuple[float, float, float, float, float]:
    """(F ratio, least, mean and greatest of the positive correlations of channel pairs, root mean square of the beam) of aligned channels."""
    m, n = x.shape
    beam = x.mean(axis=0)
    inner = ((x - beam) ** 2).sum()
    f = n * (m - 1) * m * ((beam - beam.mean()) ** 2).sum() / max(n - 1, 1) / max(inner, 1e-300)
    c = np.corrcoef(x)[np.triu_indices(m, 1)]
    c = c[c > 0]
    low, mean, high = (c.min(), c.mean(), c.max()) if len(c) else (0.0, 0.0, 0.0)
    return float(f), float(low), float(mean), float(high), float(np.sqrt((beam**2).mean()))


# ------------------------------------------------------------ pair likelihoods


def _azimuth_and_km(lat0, lon0, lat1, lon1, radius: float):
    a0, a1, d = np.radians(lat0), np.radians(lat1), np.radians(lon1 - lon0)
    h = np.sin((a1 - a0) / 2) ** 2 + np.cos(a0) * np.cos(a1) * np.sin(d / 2) ** 2
    az = np.arctan2(np.sin(d) * np.cos(a1), np.cos(a0) * np.sin(a1) - np.sin(a0) * np.cos(a1) * np.cos(d))
    return az, 2 * radius * np.arctan2(np.sqrt(h), np.sqrt(np.maximum(1 - h, 0)))


#: Nodes of the 15-point Kronrod rule from the middle outwards, their weights, and those of the 7-point Gauss rule on every second node.
_KRONROD = np.array([0.0, 0.207784955007898467600689403773245, 0.405845151377397166906606412076961, 0.586087235467691130294144691258, 0.741531185599394439863864773280788, 0.864864423359769072789712788640926, 0.949107912342758524526189684047851, 0.991455371120812639206854697526329])
_KRONROD_WEIGHTS = np.array([0.209482141084727828012999174891714, 0.204432940075298892414161999234649, 0.190350578064785409913256402421014, 0.169004726639267902826583426598550, 0.140653259715525918745189590510238, 0.104790010322250183839876322541518, 0.063092092629978553290700663189204, 0.022935322010529224963732008058970])
_GAUSS_WEIGHTS = np.array([0.417959183673469387755102040816327, 0.0, 0.381830050505118944950369775488975, 0.0, 0.279705391489276667901467771423780, 0.0, 0.129484966168869693270611432679082, 0.0])


def nested_rule() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes in -1..1, Kronrod weights and the embedded Gauss weights (0 where it has no node)."""
    both = lambda v, sign: np.r_[sign * v[:0:-1], v]
    return both(_KRONROD, -1), both(_KRONROD_WEIGHTS, 1), both(_GAUSS_WEIGHTS, 1)


def _frame(lat: np.ndarray, lon: np.ndarray) -> tuple[tuple, tuple, tuple]:
    """Unit vectors up, north and east at places (degrees)."""
    la, lo = np.radians(lat), np.radians(lon)
    sa, ca, so, co = np.sin(la), np.cos(la), np.sin(lo), np.cos(lo)
    return (ca * co, ca * so, sa), (-sa * co, -sa * so, ca), (-so, co, np.zeros_like(so))


def _dot(a: tuple, b: tuple) -> np.ndarray:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def _pair_density(a: dict, b: dict, centre: dict, flat: np.ndarray, of: np.ndarray, km: np.ndarray, z: np.ndarray, radius: float, mixture: tuple) -> np.ndarray:
    """Joint density of pairs ``of`` at distance km and azimuth z from their discs' centres, times the element of area; km, z: [panel, node, node]."""
    col = lambda v: np.asarray(v, float)[of][:, None, None]
    arc = km / radius
    cos_r, sin_r, cos_z, sin_z = np.cos(arc), np.sin(arc), np.cos(z), np.sin(z)
    c, north, east = _frame(col(centre["lat"]), col(centre["lon"]))
    value, far = 1.0, []
    for d in (a, b):
        # the node's parts along the array, its north and its east: cosine of the distance, and its sine times the azimuth's cosine and sine
        up, y, x = (_dot(c, v) * cos_r + sin_r * (_dot(north, v) * cos_z + _dot(east, v) * sin_z) for v in _frame(col(d["lat"]), col(d["lon"])))
        flat_part = np.sqrt(x * x + y * y)
        k, az = col(d["kappa"]), np.radians(col(d["az"]))
        along = np.where(flat_part > 0, x * np.sin(az) + y * np.cos(az), np.cos(az)) / np.where(flat_part > 0, flat_part, 1.0)
        value = value * np.exp(k * along - np.log(2 * np.pi * np.i0(k)))
        far.append(np.maximum(radius * np.arctan2(flat_part, up), 0.1))
    total, gap = 0.0, col(a["t"]) - col(b["t"])
    squares = [f * f for f in far]
    for wi, mi, si in zip(*mixture, strict=True):
        first, var_i = gap - far[0] * mi, squares[0] * si**2
        for wj, mj, sj in zip(*mixture, strict=True):
            var = squares[1] * sj**2
            var += var_i
            e = far[1] * mj
            e += first
            e *= e
            e /= var
            e *= -0.5
            np.exp(e, out=e)
            np.sqrt(var, out=var)
            e /= var
            e *= wi * wj / np.sqrt(2 * np.pi)
            total = total + e
    return value * total * np.where(np.asarray(flat)[of][:, None, None], 180 / np.pi, km)


def disc_integrals(a: dict, b: dict, centre: dict, flat: np.ndarray, radius: float, mixture: tuple, tolerance: float = 1e-4, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Joint density of many pairs of detections integrated over their discs, and a bound of each integral's relative error.

    a, b: lat, lon, az, t, kappa (arrays of n pairs); centre: lat, lon, radius; where ``flat`` is set, azimuth (in degrees) and range
    are integrated without the factor r. A disc begins as four panels of azimuth; a panel has the value of a 15-point Kronrod rule
    each way and, as its error, how far the embedded Gauss rule is from it. Of all pairs that are not within the tolerance the panels
    that add more than their share of the error are divided in four, for at most ``rounds`` rounds.
    """
    x, wk, wg = nested_rule()
    weights = [np.outer(w, w) for w in (wk, wg)]
    n = len(flat)
    size = np.asarray(centre["radius"], float)
    good = np.flatnonzero(np.isfinite(size))
    of = np.repeat(good, 4)
    box = np.stack([np.zeros(len(of)), size[of], np.tile(np.arange(4), len(good)) * np.pi / 2, np.tile(np.arange(1, 5), len(good)) * np.pi / 2], axis=1)
    value, error = np.full(n, np.nan), np.full(n, np.nan)
    value[good] = error[good] = 0.0
    kept_of, kept, kept_value, kept_error = np.zeros(0, np.int64), np.zeros((0, 4)), np.zeros(0), np.zeros(0)
    for last in range(rounds, -1, -1):
        made = np.empty((len(of), 2))
        for lo in range(0, len(of), 32):  # what 32 panels need stays near the processor
            q, who = box[lo : lo + 32], of[lo : lo + 32]
            half = (q[:, 1::2] - q[:, ::2]) / 2
            km, z = ((q[:, 2 * k] + half[:, k])[:, None] + half[:, k, None] * x for k in (0, 1))
            f = _pair_density(a, b, centre, flat, who, np.broadcast_to(km[:, :, None], (len(q), 15, 15)), z[:, None, :], radius, mixture)
            for k, w in enumerate(weights):
                made[lo : lo + 32, k] = (f * w).sum(axis=(1, 2)) * half[:, 0] * half[:, 1]
        kept_of, kept = np.r_[kept_of, of], np.r_[kept, box]
        kept_value, kept_error = np.r_[kept_value, made[:, 0]], np.r_[kept_error, np.abs(made[:, 0] - made[:, 1])]
        value, error = (np.where(np.isfinite(size), np.bincount(kept_of, weights=v, minlength=n), np.nan) for v in (kept_value, kept_error))
        share = tolerance * np.abs(value) / np.maximum(np.bincount(kept_of, minlength=n), 1)
        split = (error > tolerance * np.abs(value))[kept_of] & (kept_error > share[kept_of] / 2)
        if not last or not split.any():
            break
        (r0, r1, z0, z1), who = kept[split].T, kept_of[split]
        rm, zm = (r0 + r1) / 2, (z0 + z1) / 2
        box = np.concatenate([np.stack(q, axis=1) for q in ((r0, rm, z0, zm), (rm, r1, z0, zm), (r0, rm, zm, z1), (rm, r1, zm, z1))])
        of = np.tile(who, 4)
        kept_of, kept, kept_value, kept_error = kept_of[~split], kept[~split], kept_value[~split], kept_error[~split]
    with np.errstate(divide="ignore", invalid="ignore"):
        return value, np.where(value > 0, error / value, 0.0)
