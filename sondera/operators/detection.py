"""Detections from beam rows: adaptive F threshold, runs, circular gate, merging."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondera.functions import numeric
from sondera.operators import windows

BINS = 512

def adaptive_threshold(beams: DataFrame, keys: list[str], at: str, value: str, window: float, p: float, time_bandwidth: float, channels: int, ceiling: float | None = None) -> DataFrame:
    """``beams`` with threshold: the F quantile scaled to the mode of the F values in each row's window.

    A window is centred on its row and moved as little as needed to lie within
    the key's first and last time, both ends inside. Rows go to blocks of one
    window length, with copies to the blocks on either side, so a group is three
    windows long whatever the length of the record.
    """
    schema = beams.withColumn("threshold", F.lit(0.0)).schema
    block = F.floor(F.col(at) / window)
    ends = beams.groupBy(*keys).agg(F.min(at).cast("double").alias("__first"), F.max(at).cast("double").alias("__last"))
    dealt = beams.join(ends, keys).withColumn("__b", F.explode(F.array(block - 1, block, block + 1))).withColumn("__own", F.col("__b") == block)

    def of_block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(at, kind="stable")
        t, v = pdf[at].to_numpy(float), pdf[value].to_numpy(float)
        own, first, last = pdf["__own"].to_numpy(), pdf["__first"].iloc[0], pdf["__last"].iloc[0]
        start = np.maximum(np.minimum(np.maximum(t - window / 2, first), last - window), first)
        lo, hi = np.searchsorted(t, start, "left"), np.searchsorted(t, np.minimum(start + window, last), "right")
        out = pdf[own].drop(columns=["__b", "__own", "__first", "__last"]).copy()
        found = [numeric.detection_threshold(v[a:b], p, time_bandwidth, channels) for a, b in zip(lo[own], hi[own], strict=True)]
        out["threshold"] = found if ceiling is None else np.minimum(found, ceiling)
        return out

    return dealt.groupBy(*keys, "__b").applyInPandas(of_block, schema)


def run_fd(beams: DataFrame, *, window: float = 3600.0, p: float = 0.01, time_bandwidth: float, channels: int, min_rows: int, az_width: float = 15.0, fixed: float | None = None, ceiling: float | None = None, merge: bool = False) -> DataFrame:
    """Detections of beam rows (array_id, t, back_az, trace_vel, f_stat).

    Fixed thresholds are passed if F is above them, adaptive ones if it reaches
    them. The last row of an array never belongs to a detection.
    """
    if fixed is not None:
        marked = beams.withColumn("threshold", F.lit(fixed)).withColumn("hit", F.col("f_stat") > fixed)
    else:
        marked = adaptive_threshold(beams, ["array_id"], "t", "f_stat", window, p, time_bandwidth, channels, ceiling)
        marked = marked.withColumn("hit", F.col("f_stat") >= F.col("threshold"))
    found = windows.detections(windows.runs(marked, ["array_id"], "t", "hit", min_rows), ["array_id"], "t", "f_stat", "back_az", az_width, ["trace_vel"])
    return windows.merge_detections(found, ["array_id"], "t", "f_stat", "back_az", az_width) if merge else found


def run_fd_histogram(beams: DataFrame, *, window: float, p: float, d1: float, d2: float, min_corr: float, min_rows: int, az_width: float = 15.0) -> DataFrame:
    """Detections by the older detector: its mask's runs, with the same gate on their azimuths as ``run_fd``."""
    marked = histogram_detector(beams, ["array_id"], "t", "f_stat", window, p, d1, d2, min_corr)
    return windows.detections(windows.runs(marked, ["array_id"], "t", "hit", min_rows), ["array_id"], "t", "f_stat", "back_az", az_width, ["trace_vel"])


def noise_threshold(beams: DataFrame, keys: list[str], at: str, value: str, span: tuple[float, float], p: float, time_bandwidth: float, channels: int) -> DataFrame:
    """One fixed threshold per key, from the rows of a noise span: a histogram of ``BINS`` cells per key stands for the rows in the kernel density."""
    inside = beams.where(F.col(at).between(*span))
    limits = inside.groupBy(*keys).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"), F.stddev_samp(value).alias("__sd"), F.count(F.lit(1)).alias("__n"))
    width = F.greatest((F.col("__hi") - F.col("__lo")) / BINS, F.lit(1e-300))
    cells = inside.join(limits, keys).groupBy(*keys, "__lo", "__hi", "__sd", "__n", F.least(F.floor((F.col(value) - F.col("__lo")) / width), F.lit(BINS - 1)).alias("b")).agg(F.count(F.lit(1)).alias("w"))
    packed = cells.groupBy(*keys, "__lo", "__hi", "__sd", "__n").agg(F.sort_array(F.collect_list(F.struct("b", "w"))).alias("c"))
    d1, d2 = time_bandwidth, time_bandwidth * (channels - 1)
    scale = numeric.f_ppf(1 - p, d1, d2) / numeric.f_mode(d1, d2)
    names = [*keys, "threshold"]

    def modes(found):
        for pdf in found:
            out = []
            for row in pdf.to_dict("records"):
                step = (row["__hi"] - row["__lo"]) / BINS
                at_ = row["__lo"] + (np.array([c["b"] for c in row["c"]]) + 0.5) * step
                w, band = np.array([c["w"] for c in row["c"]], float), max((row["__sd"] or 0.0) * row["__n"] ** -0.2, 1e-12)
                line = np.linspace(row["__lo"], row["__hi"], 400)
                y = (w * np.exp(-0.5 * ((line[:, None] - at_) / band) ** 2)).sum(axis=1)
                out.append([*(row[k] for k in keys), float(line[np.argmax(y)]) * scale])
            yield pd.DataFrame(out, columns=names)

    return packed.mapInPandas(modes, inside.select(*keys).withColumn("threshold", F.lit(0.0)).schema)


def histogram_detector(beams: DataFrame, keys: list[str], at: str, value: str, window: float, p: float, d1: float, d2: float, min_corr: float, bins: int = 50, hi: float = 25.0) -> DataFrame:
    """The older detector's mask: the F values of an open centred window are scaled by their histogram's mode, and a row passes
    if its scaled value is beyond the quantile and the histogram follows the F density (correlation ``min_corr`` or more)."""
    from sondera.operators.relational import band_join

    width = hi / bins
    spans = beams.select(*keys, F.col(at).alias("__at"), (F.col(at) - window + 1e-6).alias("__lo"), (F.col(at) + window - 1e-6).alias("__hi"))
    inside = band_join(beams.select(*keys, at, value), spans, keys, at, "__lo", "__hi", window)
    b = F.least(F.floor(F.col(value) / width), F.lit(bins - 1))
    counts = inside.groupBy(*keys, "__at", b.alias("b")).agg(F.count(F.lit(1)).alias("n"))
    peak = counts.groupBy(*keys, "__at").agg(((F.max_by("b", F.struct("n", -F.col("b"))) + 0.5) * width).alias("c"))
    mode, quantile = numeric.f_mode(d1, d2), numeric.f_ppf(1 - p, d1, d2)
    x = (F.col("b") + 0.5) * width / F.col("c") * mode
    density = F.exp((d1 / 2 - 1) * F.log(x) - (d1 + d2) / 2 * F.log1p(x * d1 / d2))
    fit = counts.join(peak, [*keys, "__at"]).groupBy(*keys, "__at").agg(F.corr("n", density).alias("corr"), F.first("c").alias("c"))
    fit = fit.withColumnRenamed("__at", at)
    return beams.join(fit, [*keys, at]).withColumn("hit", (F.col(value) / F.col("c") * mode >= quantile) & (F.col("corr") >= min_corr))
