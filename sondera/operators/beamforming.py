"""From channel segments to beam rows: Spark cuts and gathers the windows, a numpy kernel handles a batch of them at a time."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondera.functions import numeric
from sondera.operators.records import aligned, windows_of
from sondera.operators.relational import small

#: Windows that are beamformed together.
AT_ONCE = 32


@dataclass(frozen=True)
class Beam:
    """Parameters of a beamforming run; the defaults are those of the literature for regional infrasound.

    ``span``: signal window (epoch s) that the record is trimmed to, where it lies inside. ``noise``: span whose covariance
    generalised least squares inverts; without one that method has white noise and is bartlett. ``weights``: None (plain mean
    over frequencies), "arrival" (by agreement of the frequencies' own directions) or "pure" (pure-state filter).
    """

    freq: tuple[float, float] = (0.5, 5.0)
    az: tuple[float, float, float] = (-180.0, 180.0, 2.0)  # from, to (exclusive), step
    vel: tuple[float, float, float] = (300.0, 600.0, 2.5)
    method: str = "bartlett"
    length: float = 10.0
    step: float = 5.0
    sub_length: float | None = None
    taper: str = "hanning"
    signals: int = 1
    span: tuple[float, float] | None = None
    noise: tuple[float, float] | None = None
    weights: str | None = None

    def axes(self) -> tuple[np.ndarray, np.ndarray]:
        return np.arange(*self.az), np.arange(*self.vel)


def slowness_of(az: np.ndarray, vel: np.ndarray) -> np.ndarray:
    """East and north slowness of a velocity-major grid."""
    a = np.radians(az)
    return np.stack([np.tile(np.sin(a), len(vel)), np.tile(np.cos(a), len(vel))], axis=1) / np.repeat(vel, len(az))[:, None]


def delays_of(geometry: np.ndarray, az: np.ndarray, vel: np.ndarray) -> np.ndarray:
    """Plane-wave delays K x M of a velocity-major grid."""
    return slowness_of(az, vel) @ geometry.T


def spherical_delays(geometry: np.ndarray, places: np.ndarray, height: float = 0.0, velocity: float = 340.0) -> np.ndarray:
    """Delays K x M of waves from points (m east and north of the first element, and a height above it), relative to that element."""
    far = np.sqrt(((geometry[None, :, :] - places[:, None, :]) ** 2).sum(axis=2) + height**2)
    return (far[:, :1] - far) / velocity


def noise_inverse(segments: DataFrame, beam: Beam) -> DataFrame:
    """array_id and the inverse noise covariance of each frequency (``inverse``: BINARY, complex128 F x M x M).

    The covariance is the mean over half-overlapping windows inside ``beam.noise``, with a thousandth of its mean diagonal added.
    Every partition adds up its own windows, so only one matrix per array and partition shuffles.
    """
    w = windows_of(segments, beam.length, beam.length / 2, beam.noise)
    schema = "array_id string, n long, f int, m int, cov binary"

    def sums(found: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, list] = {}
        for pdf in found:
            for array_id, start, c, p in zip(pdf["array_id"], pdf["start"], pdf["channels"], pdf["pieces"], strict=True):
                x, dt, _ = aligned(list(c), list(p), start, beam.length)
                own = total.setdefault(array_id, [0, 0.0])
                own[0] += 1
                own[1] = own[1] + numeric.spectra(x, dt, taper=beam.taper)[1]
        yield pd.DataFrame([(k, n, len(s), s.shape[1], s.astype(complex).tobytes()) for k, (n, s) in total.items()], columns=["array_id", "n", "f", "m", "cov"])

    def invert(pdf: pd.DataFrame) -> pd.DataFrame:
        m = int(pdf["m"].iloc[0])
        s = sum(np.frombuffer(x, complex) for x in pdf["cov"]).reshape(-1, m, m) / pdf["n"].sum()
        load = 1e-3 * np.trace(s, axis1=1, axis2=2).real / m
        inv = np.linalg.inv(s + np.maximum(load, 1e-300)[:, None, None] * np.eye(m))
        return pd.DataFrame({"array_id": [pdf["array_id"].iloc[0]], "inverse": [inv.tobytes()]})

    return w.mapInPandas(sums, schema).groupBy("array_id").applyInPandas(invert, "array_id string, inverse binary")


def beam_rows(windows: DataFrame, beam: Beam, inverse: DataFrame | None = None) -> DataFrame:
    """One row per window and signal: array_id, t (middle, whole seconds), back_az, trace_vel, power, f_stat, channels, signal."""
    schema = "array_id string, t double, back_az double, trace_vel double, power double, f_stat double, channels int, signal int"
    az, vel = beam.axes()
    coherent = numeric.METHODS[beam.method.lower()] in ("bartlett", "bartlett_covar", "gls")
    names = [x.split()[0] for x in schema.split(", ")]
    windows = windows.withColumn("inverse", F.lit(None).cast("binary")) if inverse is None else windows.join(small(inverse, 4096), "array_id", "left")

    def of_windows(rows: list[tuple]) -> pd.DataFrame:
        """Windows that share geometry, rate and noise: one steering matrix per frequency for all of them."""
        dt, geometry, raw = rows[0][4:]
        sub = int(beam.sub_length / dt) if beam.sub_length else None
        made = [numeric.spectra(r[3], dt, sub, taper=beam.taper) for r in rows]
        f, m = made[0][2], len(geometry)
        band = (f >= beam.freq[0]) & (f <= beam.freq[1])
        inv = np.frombuffer(raw, complex).reshape(-1, m, m)[band] if raw else None
        x, cov, delays = np.stack([x[:, band] for x, _, _ in made]), np.stack([s[band] for _, s, _ in made]), delays_of(geometry, az, vel)
        weights = None
        if beam.weights == "arrival":
            weights = numeric.arrival_weights(x, cov, f[band], delays, slowness_of(az, vel), beam.method, beam.signals, inv)
        elif beam.weights == "pure":
            weights = np.stack([numeric.pure_state(s) for s in cov])
        power = numeric.beam_power(x, cov, f[band], delays, beam.method, beam.signals, inv, weights)
        out = []
        for (array_id, start, m, *_), p in zip(rows, power, strict=True):
            for k, (z, v, top) in enumerate(numeric.peaks(p, az, vel, beam.signals)):
                out.append((array_id, float(np.floor(start + beam.length / 2)), z, v, top, top / max(1 - top, 1e-12) * (m - 1) if coherent else np.nan, int(m), k))
        return pd.DataFrame(out, columns=names)

    def batches(found: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in found:
            groups: dict[tuple, list[tuple]] = {}
            for array_id, start, m, c, pieces, raw in zip(pdf["array_id"], pdf["start"], pdf["m"], pdf["channels"], pdf["pieces"], pdf["inverse"], strict=True):
                x, dt, geometry = aligned(list(c), list(pieces), start, beam.length)
                raw = bytes(raw) if isinstance(raw, (bytes, bytearray)) else None
                key = (geometry.tobytes(), dt, raw)
                groups.setdefault(key, []).append((array_id, start, m, x, dt, geometry, raw))
                if len(groups[key]) >= AT_ONCE:
                    yield of_windows(groups.pop(key))
            for rows in groups.values():
                yield of_windows(rows)

    return windows.mapInPandas(batches, schema)


def run_fk(segments: DataFrame, beam: Beam | None = None) -> DataFrame:
    """Beam rows of channel segments."""
    beam = beam or Beam()
    inverse = noise_inverse(segments, beam) if beam.noise and numeric.METHODS[beam.method.lower()] == "gls" else None
    return beam_rows(windows_of(segments, beam.length, beam.step, beam.span), beam, inverse)


_PARTS = "array_id string, i long, weight double, beam double, residual array<double>"


def best_beams(segments: DataFrame, directions: DataFrame, step: float, fs: float) -> DataFrame:
    """Best beam and residuals per array and sample: array_id, t, beam, residual (one value a channel).

    ``directions``: beam rows (array_id, t, back_az, trace_vel). Around each of their times lies a window of two steps; the beam along the
    row's direction and what it leaves of each channel are blended with their neighbours' by logistic ramps, as sums per sample.
    Times are multiples of 1 / ``fs``. Channels are aligned, and trends taken out, as for beamforming.
    """
    length = 2 * step
    lines = array_ends_of(segments)
    d = directions.select("array_id", (F.col("t") - step).alias("start"), "back_az", "trace_vel")
    pieces = windows_at(segments, d, length)
    joined = pieces.join(lines, "array_id")

    def batches(found: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in found:
            out = []
            for row in pdf.itertuples(index=False):
                x, dt, geometry = aligned(list(row.channels), list(row.pieces), row.start, length)
                f = np.fft.rfftfreq(x.shape[1], dt)
                beam, rest = numeric.best_beam(np.fft.rfft(x, axis=1), f, delays_of(geometry, np.array([row.back_az]), np.array([row.trace_vel]))[0])
                beam, rest = np.fft.irfft(beam, x.shape[1]), np.fft.irfft(rest, x.shape[1], axis=1)
                t = row.start + np.arange(x.shape[1]) * dt
                up, down = (1 / (1 + np.exp(np.clip(-s * (t - row.start - at) / (step / 20), -60, 60))) for s, at in ((1, step / 2), (-1, 3 * step / 2)))
                w = up * down
                out.append(pd.DataFrame({"array_id": row.array_id, "i": np.rint(t * fs).astype(np.int64), "weight": w, "beam": w * beam, "residual": (w * rest).T.tolist()}))
            if out:
                yield pd.concat(out)

    parts = joined.mapInPandas(batches, _PARTS)
    m = F.max(F.size("residual"))
    sums = parts.groupBy("array_id", "i").agg(F.sum("beam").alias("beam"), F.sum("weight").alias("weight"), m.alias("m"), F.collect_list("residual").alias("r"))
    total = F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda k: F.aggregate("r", F.lit(0.0), lambda a, v: a + F.get(v, k)))
    return sums.select("array_id", (F.col("i") / fs).alias("t"), "beam", total.alias("residual"), "weight")


def array_ends_of(segments: DataFrame) -> DataFrame:
    from sondera.operators.records import array_ends, channel_lines

    return array_ends(channel_lines(segments)).select("array_id", "channels")


def windows_at(segments: DataFrame, spans: DataFrame, length: float) -> DataFrame:
    """``spans`` (array_id, start, any others) with the pieces of the segments they touch.

    Segments are cut at multiples of ``length`` first, so a bucket of the join holds its own samples and no more, and a window takes
    those of the three or four buckets it can touch.
    """
    from sondera.operators.records import calibration, split

    s = split(segments, length).withColumns({"__b": F.floor(F.col("t0") / length + 1e-9), "__last": F.col("t0") + (F.size("samples") - 1) / F.col("fs"), "__c": calibration()})
    others = [c for c in spans.columns if c not in ("array_id", "start")]
    w = spans.withColumn("__b", F.explode(F.sequence(F.floor((F.col("start") - 1) / length), F.floor((F.col("start") + length + 1) / length))))
    j = s.join(w, ["array_id", "__b"]).where((F.col("t0") - 1 / F.col("fs") <= F.col("start") + length) & (F.col("__last") + 1 / F.col("fs") >= F.col("start")))
    i0 = F.greatest(F.lit(0), F.floor((F.col("start") - F.col("t0")) * F.col("fs")) - 1).cast("int")
    i1 = F.least(F.size("samples") - 1, F.ceil((F.col("start") + length - F.col("t0")) * F.col("fs")) + 1).cast("int")
    j = j.withColumns({"__i0": i0, "__i1": i1}).where("__i1 >= __i0")
    piece = F.struct("channel", (F.col("t0") + F.col("__i0") / F.col("fs")).alias("t0"), F.transform(F.slice("samples", F.col("__i0") + 1, F.col("__i1") - F.col("__i0") + 1), lambda v: v * F.col("__c")).alias("x"))
    return j.groupBy("array_id", "start", *others).agg(F.sort_array(F.collect_set(piece)).alias("pieces"))


def detection_spectra(segments: DataFrame, detections: DataFrame, buffer: float = 0.25, noise: str = "pre") -> DataFrame:
    """Spectra of detections (array_id, t, start, end, back_az, trace_vel): array_id, t, f, db of the signal less the noise.

    The signal's window is the detection with ``buffer`` of its length on each side; noise is the window of equal length before
    ("pre") or behind it ("post"), or what the beam leaves of the channels ("beam"). Levels are smoothed by local cubics.
    """
    if noise not in ("pre", "post", "beam"):
        raise ValueError("noise is to be pre, post or beam")
    span = (F.col("end") - F.col("start")) * (1 + 2 * buffer)
    d = detections.withColumns({"length": span, "at": F.col("t") + F.col("start") - (F.col("end") - F.col("start")) * buffer}).where("length > 0")
    shift = {"pre": -F.col("length"), "post": F.col("length"), "beam": F.lit(0.0)}[noise]
    both = d.select("array_id", "t", "back_az", "trace_vel", "length", "at", F.explode(F.array(F.struct(F.lit("signal").alias("role"), F.col("at").alias("start")), F.struct(F.lit("noise").alias("role"), (F.col("at") + shift).alias("start")))).alias("w"))
    longest = d.agg(F.max("length")).first()[0] or 1.0
    made = windows_at(segments, both.select("array_id", "w.start", "w.role", "t", "back_az", "trace_vel", "length"), float(longest))
    joined = made.join(array_ends_of(segments), "array_id")

    def batches(found: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in found:
            out = []
            for row in pdf.itertuples(index=False):
                x, dt, geometry = aligned(list(row.channels), list(row.pieces), row.start, row.length)
                spec, _, f = numeric.spectra(x, dt, taper="tukey")
                level = np.abs(spec).mean(axis=0)
                if noise == "beam":
                    beam, rest = numeric.best_beam(spec, f, delays_of(geometry, np.array([row.back_az]), np.array([row.trace_vel]))[0])
                    level = np.abs(beam) if row.role == "signal" else np.abs(rest).mean(axis=0)
                out.append((row.array_id, row.t, row.role, f.tolist(), level.tolist()))
            yield pd.DataFrame(out, columns=["array_id", "t", "role", "f", "level"])

    levels = joined.mapInPandas(batches, "array_id string, t double, role string, f array<double>, level array<double>")
    sides = levels.groupBy("array_id", "t").agg(F.first("f").alias("f"), F.max(F.when(F.col("role") == "signal", F.col("level"))).alias("s"), F.max(F.when(F.col("role") == "noise", F.col("level"))).alias("n")).where("s is not null and n is not null")

    def smooth(found: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in found:
            out = []
            for row in pdf.itertuples(index=False):
                db = 10 * np.log10(np.maximum(np.abs(np.asarray(row.s) - np.asarray(row.n)), 1e-300))
                out.append(pd.DataFrame({"array_id": row.array_id, "t": row.t, "f": np.asarray(row.f), "db": numeric.smoothed(db)}))
            if out:
                yield pd.concat(out)

    return sides.mapInPandas(smooth, "array_id string, t double, f double, db double")


def with_noise(beam: Beam, span: tuple[float, float]) -> Beam:
    return replace(beam, noise=span)
