"""Single-channel spectral detection: spectrogram, background threshold, density clusters."""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sondera.catalog import durable
from sondera.functions import numeric
from sondera.operators.records import aligned, windows_of
from sondera.operators.relational import components


#: Windows that are cut together from a channel's record.
MANY = 64


def channel_chunks(segments: DataFrame, length: float, step: float) -> tuple[DataFrame, float]:
    """Pieces of every channel's record for ``MANY`` windows of ``length`` at a time, across segment borders, and the pieces' length."""
    calib = F.col("calib") if "calib" in segments.columns else F.lit(1.0)
    s = segments.select(F.col("channel").alias("array_id"), "channel", "t0", "fs", calib.alias("calib"), F.lit(0.0).alias("dx"), F.lit(0.0).alias("dy"), "samples")
    whole = length + (MANY - 1) * step
    return windows_of(s, whole, MANY * step, partial=True), whole


def _spectrograms(found: Iterator[pd.DataFrame], whole: float, seconds: float, overlap: float) -> Iterator[tuple]:
    """(channel, time of the first sample, times, frequencies, power) of each chunk that holds a window."""
    for pdf in found:
        for channel, start, channels, pieces in zip(pdf["array_id"], pdf["start"], pdf["channels"], pdf["pieces"], strict=True):
            x, dt, _ = aligned(list(channels), list(pieces), start, whole, trend=True)
            x, n = x[0, : int(round((channels[0]["last"] - start) / dt)) + 1], int(round(seconds / dt, 6))
            if len(x) >= n > 1:
                yield channel, start, *numeric.spectrogram(x, dt, n, overlap)


def spectrogram_rows(segments: DataFrame, f_min: float, f_max: float, overlap: float = 0.8) -> DataFrame:
    """One row per channel, time and frequency strictly inside the band: channel, t, f, db. The window is four periods of f_min."""
    seconds = 4 / f_min
    chunks, whole = channel_chunks(segments, seconds, seconds * (1 - overlap))

    def batches(found: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for channel, t0, t, f, power in _spectrograms(found, whole, seconds, overlap):
            band = (f > f_min) & (f < f_max)
            with np.errstate(divide="ignore"):
                db = 10 * np.log10(power[:, band])
            db[~np.isfinite(db)] = db[np.isfinite(db)].min() if np.isfinite(db).any() else 0.0
            yield pd.DataFrame({"channel": channel, "t": np.repeat(t0 + t, band.sum()), "f": np.tile(f[band], len(t)), "db": db.ravel()})

    return chunks.mapInPandas(batches, "channel string, t double, f double, db double")


def above_background(rows: DataFrame, window: float, step: float, p: float) -> DataFrame:
    """Points above the normal quantile of their frequency's level in any hop window that holds them, once each.

    The level's centre is the median and its spread the median deviation, so
    bursts do not raise it; both are ordinary aggregates.
    """
    from sondera.operators.windows import hop_windows

    first = rows.groupBy("channel").agg(F.min("t").alias("t0"))
    dealt = hop_windows(rows.join(first, "channel"), "t", "t0", window, step)
    level = dealt.groupBy("channel", "f", "win_start").agg(F.median("db").alias("m"))
    spread = dealt.join(level, ["channel", "f", "win_start"]).groupBy("channel", "f", "win_start").agg(F.first("m").alias("m"), (1.4826 * F.median(F.abs(F.col("db") - F.col("m")))).alias("s"))
    z = NormalDist().inv_cdf(1 - p)
    found = dealt.join(spread, ["channel", "f", "win_start"]).withColumn("threshold", F.col("m") + z * F.col("s"))
    return found.where(F.col("db") > F.col("threshold")).groupBy("channel", "t", "f").agg(F.first("db").alias("db"), F.min("threshold").alias("threshold"))


def above_density(rows: DataFrame, window: float, step: float, p: float) -> DataFrame:
    """Points above their frequency's background in any hop window that holds them, once each.

    A background's threshold is the lower of two quantiles, of a normal and of a fitted skew normal, from the kernel density of the
    window's levels (``numeric.background_threshold``). A group is one channel, frequency and window, so its size follows the window.
    """
    from sondera.operators.windows import hop_windows

    first = rows.groupBy("channel").agg(F.min("t").alias("t0"))
    dealt = hop_windows(rows.join(first, "channel"), "t", "t0", window, step).drop("t0")
    levels = dealt.groupBy("channel", "f", "win_start").agg(F.collect_list("db").alias("x"))

    def batches(found: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in found:
            for k in range(0, len(pdf), 512):
                part = pdf.iloc[k : k + 512]
                threshold, peak = numeric.background_thresholds([np.sort(np.asarray(x, float)) for x in part["x"]], p)
                yield part.drop(columns="x").assign(threshold=threshold, peak=peak)

    levels = levels.mapInPandas(batches, "channel string, f double, win_start double, threshold double, peak double")
    found = dealt.join(levels, ["channel", "f", "win_start"])
    return found.where(F.col("db") > F.col("threshold")).groupBy("channel", "t", "f").agg(F.first("db").alias("db"), F.min("threshold").alias("threshold"))


#: Pairs of points that two boxes make at most; boxes of more are divided.
PAIRS = 4096


def _boxes(points: DataFrame, keys: list[str], root: str, level: int) -> DataFrame:
    """The tight boxes of a root's points in cells of the grid divided ``level`` times by four: place, count and bounds."""
    at = lambda c: (F.col(f"c{c}") * 4**level + F.floor(F.col(f"r{c}") * 4**level)).cast("long").alias(f"{root}{c}")
    bounds = [f(c).alias(f"{root}{c}{n}") for c in "xy" for n, f in (("0", F.min), ("1", F.max))]
    return points.groupBy(*keys, root, at("x"), at("y")).agg(F.count(F.lit(1)).alias(f"{root}n"), *bounds)


def reached(a: DataFrame, b: DataFrame, keys: list[str], eps: float, among: bool = False, pairs: int = PAIRS) -> DataFrame:
    """(a, b, n): roots with points no more than ``eps`` apart; n counts b's points if a is one point.

    Both sides: keys, the root's number a or b, x, y, the grid cell cx, cy that holds the whole root, and the place rx, ry in the cell
    (0 to 1). Roots meet as boxes: boxes that lie within ``eps`` as a whole count whole, boxes further apart not at all, and where only
    some points can be near, boxes of few points make pairs and larger ones are divided, level by level. So a cell of very many points
    makes no pairs but along the circle of radius ``eps``. ``among``: a and b are the same roots; each pair is told once, a < b.
    """
    level, out, rest = 0, None, None
    while True:
        x, y = _boxes(a, keys, "a", level), _boxes(b, keys, "b", level)
        if rest is None:
            around = F.explode(F.array(*[F.struct((F.col("ax") + i).alias("bx"), (F.col("ay") + j).alias("by")) for i in range(-2, 3) for j in range(-2, 3)]))
            rest = x.withColumn("at", around).select("*", "at.*").drop("at").join(y, [*keys, "bx", "by"])
            rest = rest.where("a < b") if among else rest
        else:
            up = lambda df, r: df.withColumns({f"{r}{c}u": F.shiftright(f"{r}{c}", 2) for c in "xy"})
            rest = rest.select(*keys, "a", "b", *[F.col(f"{r}{c}").alias(f"{r}{c}u") for r in "ab" for c in "xy"])
            rest = rest.join(up(x, "a"), [*keys, "a", "axu", "ayu"]).join(up(y, "b"), [*keys, "b", "bxu", "byu"])
        far = sum(((F.greatest(F.col(f"b{c}1") - F.col(f"a{c}0"), F.col(f"a{c}1") - F.col(f"b{c}0"))) ** 2 for c in "xy"), F.lit(0.0))
        near = sum(((F.greatest(F.col(f"b{c}0") - F.col(f"a{c}1"), F.col(f"a{c}0") - F.col(f"b{c}1"), F.lit(0.0))) ** 2 for c in "xy"), F.lit(0.0))
        kind = F.when(far <= eps * eps, 0).when(F.col("an") * F.col("bn") <= pairs, 1).otherwise(2)
        rest = durable(rest.where(near <= eps * eps).withColumn("kind", kind).select(*keys, "a", "ax", "ay", "b", "bx", "by", "bn", "kind"))
        here = lambda df, r: df.select(*keys, r, F.col("x").alias(f"{r}px"), F.col("y").alias(f"{r}py"), *[(F.col(f"c{c}") * 4**level + F.floor(F.col(f"r{c}") * 4**level)).cast("long").alias(f"{r}{c}") for c in "xy"])  # noqa: B023, E731
        few = rest.where("kind = 1").join(here(a, "a"), [*keys, "a", "ax", "ay"]).join(here(b, "b"), [*keys, "b", "bx", "by"])
        few = few.where((F.col("bpx") - F.col("apx")) ** 2 + (F.col("bpy") - F.col("apy")) ** 2 <= eps * eps).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
        found = rest.where("kind = 0").select("a", "b", F.col("bn").alias("n")).unionByName(few)
        out = found if out is None else out.unionByName(found)
        rest = rest.where("kind = 2")
        if rest.isEmpty():
            return out.groupBy("a", "b").agg(F.sum("n").alias("n"))
        if among:  # one pair of near points is enough
            out = durable(out)
            rest = rest.join(out.select("a", "b").distinct(), ["a", "b"], "left_anti").select(rest.columns)
        level += 1


def dbscan(points: DataFrame, keys: list[str], x: str, y: str, eps: float, min_points: int, pairs: int = PAIRS) -> DataFrame:
    """Density clusters: adds cluster (smallest core point's number in it), null for noise. Points need a unique ``pid``.

    The plane is cut into cells so small that two points of a cell are always near. A cell of ``min_points`` or more points is core as a
    whole, only points of other cells are counted for; what is linked are cells, not points, by ``reached``; border points join a
    neighbouring core cell's cluster. Points whose key or place is null are noise.
    """
    side = 0.7 * eps
    cell = {f"c{c}": F.floor(F.col(c) / side).cast("long") for c in "xy"}
    p = points.select(*keys, "pid", F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where(F.col("x").isNotNull() & F.col("y").isNotNull())
    p = p.withColumns(cell).withColumns({f"r{c}": F.col(c) / side - F.col(f"c{c}") for c in "xy"})
    place = [*keys, "cx", "cy"]
    cells = p.groupBy(*place).agg(F.count(F.lit(1)).alias("n"), F.min("pid").alias("b"))
    p = durable(p.join(cells, place))
    sparse = p.where(F.col("n") < min_points)
    counted = reached(sparse.withColumnRenamed("pid", "a").drop("b"), p, keys, eps, pairs=pairs).groupBy("a").agg(F.sum("n").alias("near")).where(F.col("near") >= min_points)
    marked = durable(p.drop("b").join(counted.select(F.col("a").alias("pid"), F.lit(True).alias("found")), "pid", "left").withColumn("core", (F.col("n") >= min_points) | F.coalesce("found", F.lit(False))))
    core = marked.where("core")
    own = core.groupBy(*place).agg(F.min("pid").alias("b"))
    core = durable(core.join(own, place).select(*place, "b", "pid", "x", "y", "rx", "ry"))
    labels = components(reached(core.withColumnRenamed("b", "a"), core, keys, eps, among=True, pairs=pairs), "a", "b")
    labels = durable(core.select("b").distinct().join(labels.withColumnRenamed("node", "b"), "b", "left").select("b", F.coalesce("label", "b").alias("cluster")))
    border = reached(marked.where("NOT core").withColumnRenamed("pid", "a"), core, keys, eps, pairs=pairs).join(labels, "b").groupBy(F.col("a").alias("pid")).agg(F.min("cluster").alias("cluster"))
    named = core.select("pid", "b").join(labels, "b").select("pid", "cluster").unionByName(border)
    return points.join(named, "pid", "left").select(*points.columns, "cluster")


def spectral_detections(clustered: DataFrame) -> DataFrame:
    """One row per cluster: mean time, offsets of its ends, band, mean and greatest level."""
    g = clustered.where("cluster is not null").groupBy("channel", "cluster")
    out = g.agg(F.avg("t").alias("t"), F.min("t").alias("lo"), F.max("t").alias("hi"), F.bround(F.min("f"), 2).alias("f_lo"), F.bround(F.max("f"), 2).alias("f_hi"), F.avg("db").alias("mean_db"), F.max("db").alias("max_db"), F.count(F.lit(1)).alias("n_points"))
    return out.withColumns({"start": F.col("lo") - F.col("t"), "end": F.col("hi") - F.col("t")}).drop("lo", "hi")


def run_sd(segments: DataFrame, f_min: float = 1.0, f_max: float = 20.0, window: float = 900.0, step: float = 450.0, p: float = 0.01, scale: float = 35.0, eps: float = 10.0, min_points: int = 40, background: str = "density") -> DataFrame:
    """Spectral detections of channel segments; clusters live in (time, scale * log10 frequency). ``background``: density or median."""
    above = {"density": above_density, "median": above_background}[background]
    found = above(spectrogram_rows(segments, f_min, f_max), window, step, p)
    number = F.row_number().over(Window.partitionBy("channel").orderBy("t", "f")).cast("long")
    found = found.withColumns({"y": scale * F.log10("f"), "pid": F.xxhash64("channel", number)})
    return spectral_detections(dbscan(found, ["channel"], "t", "y", eps, min_points))


def cluster_spectra(rows: DataFrame, detections: DataFrame) -> DataFrame:
    """Mean and greatest level of each frequency while a detection (channel, cluster, t, start, end) lasts, both ends outside."""
    from sondera.operators.relational import band_join

    spans = detections.select("channel", "cluster", (F.col("t") + F.col("start")).alias("lo"), (F.col("t") + F.col("end")).alias("hi"))
    inside = band_join(rows, spans, ["channel"], "t", "lo", "hi", 60.0).where((F.col("t") > F.col("lo")) & (F.col("t") < F.col("hi")))
    return inside.groupBy("channel", "cluster", "f").agg(F.avg("db").alias("mean_db"), F.max("db").alias("max_db"))


def transform_rows(segments: DataFrame, kind: str, f_min: float, f_max: float, seconds: float = 4.0, scales: int = 24) -> DataFrame:
    """Short-time Fourier ("stft") or Morlet wavelet ("cwt") magnitudes of segments: channel, t, f, amplitude."""

    def batches(found: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in found:
            for channel, t0, fs, samples in zip(pdf["channel"], pdf["t0"], pdf["fs"], pdf["samples"], strict=True):
                x = np.asarray(samples, float)
                if kind == "stft":
                    t, f, z = numeric.stft(x, 1 / fs, max(2, int(seconds * fs)))
                    z = np.abs(z)
                else:
                    f, t = np.geomspace(f_min, f_max, scales), np.arange(len(x)) / fs
                    z = np.sqrt(numeric.wavelet_power(x, 1 / fs, f)).T
                band = (f >= f_min) & (f <= f_max)
                yield pd.DataFrame({"channel": channel, "t": np.repeat(t0 + t, band.sum()), "f": np.tile(f[band], len(t)), "amplitude": z[:, band].ravel()})

    return segments.select("channel", "t0", "fs", "samples").mapInPandas(batches, "channel string, t double, f double, amplitude double")


def welch_psd(segments: DataFrame, seconds: float) -> DataFrame:
    """Power density in dB with half-overlapping windows over every channel's record: channel, f, db."""
    chunks, whole = channel_chunks(segments, seconds, seconds / 2)

    def batches(found: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for channel, _, _, f, power in _spectrograms(found, whole, seconds, 0.5):
            yield pd.DataFrame({"channel": channel, "f": f, "p": power.sum(axis=0), "w": len(power)})

    rows = chunks.mapInPandas(batches, "channel string, f double, p double, w long")
    return rows.groupBy("channel", "f").agg((10 * F.log10(F.sum("p") / F.sum("w"))).alias("db"))
