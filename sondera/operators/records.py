"""Channel segments as whole records: ends, trends, windows across segment borders, gaps, splits, filters of whole records, statistics.

A segment row is array_id, channel, t0 (epoch s), fs, calib, dx, dy, samples. The
segments of a channel are one record: where they leave a gap it holds zeros, and
its trend is that of the record, not of a window. No record is ever gathered:
ends and trends are aggregates, windows are cut from the segments they touch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondera.catalog import durable

_SUM = lambda a, x: a + x
#: Windows that are cut from a segment at once.
MANY = 64


def calibration(calib: str = "calib") -> Column:
    """A calibration of 0 or null counts as 1."""
    return F.coalesce(F.nullif(F.col(calib), F.lit(0.0)), F.lit(1.0))


def last_time() -> Column:
    return F.col("t0") + (F.size("samples") - 1) / F.col("fs")


def channel_lines(segments: DataFrame) -> DataFrame:
    """One row per channel: its ends, rate and the least-squares line (mean, slope about the middle) of its record, gaps as zeros.

    Segments of a channel are not to overlap.
    """
    ends = segments.groupBy("array_id", "channel").agg(F.min("t0").alias("first"), F.max(last_time()).alias("last"))

    def sums(found: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in found:
            x = [np.asarray(v, float) for v in pdf["samples"]]
            yield pdf.drop(columns="samples").assign(s=[v.sum() for v in x], m=[(v * np.arange(len(v))).sum() for v in x])

    rows = segments.select("array_id", "channel", F.col("dx").cast("double").alias("dx"), F.col("dy").cast("double").alias("dy"), F.col("fs").cast("double").alias("fs"), F.col("t0").cast("double").alias("t0"), calibration().cast("double").alias("c"), "samples").where(F.size("samples") > 0)
    parts = rows.mapInPandas(sums, "array_id string, channel string, dx double, dy double, fs double, t0 double, c double, s double, m double")
    joined = parts.join(ends, ["array_id", "channel"])
    sums = joined.groupBy("array_id", "channel", "first", "last").agg(
        F.max("fs").alias("fs"), F.first("dx").alias("dx"), F.first("dy").alias("dy"), F.sum(F.col("c") * F.col("s")).alias("s"), F.sum(F.col("c") * ((F.col("t0") - F.col("first")) * F.col("s") + F.col("m") / F.col("fs"))).alias("st")
    )
    n = F.round((F.col("last") - F.col("first")) * F.col("fs")) + 1
    mid, spread = (F.col("last") - F.col("first")) / 2, n * (n * n - 1) / 12 / F.pow("fs", F.lit(2))
    slope = F.when(spread > 0, (F.col("st") - mid * F.col("s")) / spread).otherwise(0.0)
    return sums.select("array_id", "channel", "dx", "dy", "fs", "first", "last", (F.col("s") / n).alias("mean"), slope.alias("slope"))


def array_ends(lines: DataFrame) -> DataFrame:
    """One row per array: its channels, and begin and stop of what all of them cover."""
    channel = F.struct("channel", "dx", "dy", "fs", "first", "last", "mean", "slope")
    return lines.groupBy("array_id").agg(F.max("first").alias("begin"), F.min("last").alias("stop"), F.sort_array(F.collect_list(channel)).alias("channels"))


def windows_of(segments: DataFrame, length: float, step: float, span: tuple[float, float] | None = None, partial: bool = False) -> DataFrame:
    """One row per array and whole hop window: array_id, start, m, channels, pieces (the samples of the segments it touches).

    Windows start at the record's begin, and every ``step`` from there. ``span`` trims the record, where it lies inside. With ``partial``
    the windows that reach beyond the record's end are made too.
    """
    ends = array_ends(channel_lines(segments))
    if span:
        lo, hi = (F.lit(float(x)) for x in span)
        begin, stop = F.col("begin"), F.col("stop")
        ends = ends.withColumns({"begin": F.when((lo > begin) & (lo < stop), lo).otherwise(begin), "stop": F.when((hi > begin) & (hi < stop), hi).otherwise(stop)})
    s = segments.join(ends.select("array_id", "begin", "stop"), "array_id").withColumn("__last", last_time())
    k0 = F.greatest(F.lit(0), F.ceil((F.col("t0") - 1 / F.col("fs") - length - F.col("begin")) / step))
    k1 = F.least(F.floor((F.col("__last") + 1 / F.col("fs") - F.col("begin")) / step), F.floor((F.col("stop") - F.col("begin") - (0.0 if partial else length)) / step + 1e-9))
    s = s.where(k1 >= k0).select("array_id", "channel", F.col("t0").cast("double").alias("t0"), F.col("fs").cast("double").alias("fs"), calibration().cast("double").alias("c"), F.col("begin"), k0.cast("long").alias("k0"), k1.cast("long").alias("k1"), "samples")

    def cut(found: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in found:
            for r in pdf.itertuples(index=False):
                x = np.asarray(r.samples, float) * r.c
                for first in range(r.k0, r.k1 + 1, MANY):
                    k = np.arange(first, min(first + MANY, r.k1 + 1))
                    start = r.begin + k * step
                    i0 = np.maximum(0, np.floor((start - r.t0) * r.fs).astype(np.int64) - 1)
                    i1 = np.minimum(len(x) - 1, np.ceil((start + length - r.t0) * r.fs).astype(np.int64) + 1)
                    k, i0, i1 = (v[i1 >= i0] for v in (k, i0, i1))
                    yield pd.DataFrame({"array_id": r.array_id, "k": k, "channel": r.channel, "t0": r.t0 + i0 / r.fs, "x": [x[a : b + 1] for a, b in zip(i0, i1, strict=True)]})

    s = s.mapInPandas(cut, "array_id string, k long, channel string, t0 double, x array<double>").select("array_id", "k", F.struct("channel", "t0", "x").alias("p"))
    w = s.groupBy("array_id", "k").agg(F.sort_array(F.collect_list("p")).alias("pieces"))
    w = w.join(ends, "array_id")
    return w.select("array_id", (F.col("begin") + F.col("k") * step).alias("start"), F.size("channels").alias("m"), "channels", "pieces")


def aligned(channels: list, pieces: list, start: float, length: float, trend: bool = False) -> tuple[np.ndarray, float, np.ndarray]:
    """Channels of one window on the time base of the lowest rate, by linear interpolation, without the record's trend unless it is to stay."""
    fs = min(c["fs"] for c in channels)
    t = start + np.arange(int(round(length * fs, 6))) / fs
    rows = []
    for c in channels:
        lo = int(np.floor((start - c["first"]) * c["fs"])) - 1
        grid = np.zeros(int(np.ceil(length * c["fs"])) + 4)
        at = c["first"] + (lo + np.arange(len(grid))) / c["fs"]
        for p in pieces:
            if p["channel"] == c["channel"]:
                i = int(round((p["t0"] - c["first"]) * c["fs"])) - lo
                x = np.asarray(p["x"], float)
                a, b = max(0, -i), min(len(x), len(grid) - i)
                grid[i + a : i + b] = x[a:b]
        if not trend:
            grid -= c["mean"] + c["slope"] * (at - (c["first"] + c["last"]) / 2)
        rows.append(np.interp(t, at, grid))
    geometry = np.array([[c["dx"], c["dy"]] for c in channels], float)
    return np.stack(rows), 1 / fs, geometry - geometry[0]


def split(segments: DataFrame, seconds: float = 7200.0) -> DataFrame:
    """Segments cut at multiples of ``seconds`` since 1970: no row is longer than that, and no sample is lost."""
    names = segments.columns

    def parts(found: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in found:
            of, begins, samples = [], [], []
            for i, (t0, fs, x) in enumerate(zip(pdf["t0"].tolist(), pdf["fs"].tolist(), pdf["samples"], strict=True)):
                n = len(x)
                k = np.arange(np.floor(t0 / seconds), np.floor((t0 + (n - 1) / fs) / seconds) + 2)
                at = np.clip(np.ceil((k * seconds - t0) * fs - 1e-6), 0, n).astype(int)
                at[-1] = n
                for q in np.flatnonzero(np.diff(at) > 0).tolist():
                    of.append(i)
                    begins.append(t0 + at[q] / fs)
                    samples.append(x[at[q] : at[q + 1]])
            yield pdf.iloc[of].reset_index(drop=True).assign(samples=samples, t0=begins)[names]

    kept = segments.where(F.size("samples") > 0)
    return kept.withColumn("t0", F.col("t0").cast("double")).mapInPandas(parts, kept.withColumn("t0", F.col("t0").cast("double")).schema)


def statistics(segments: DataFrame) -> DataFrame:
    """One row per channel: first and last time, samples, least, greatest and mean value."""
    parts = segments.select("array_id", "channel", "t0", last_time().alias("t1"), F.size("samples").alias("n"), F.array_min("samples").alias("lo"), F.array_max("samples").alias("hi"), F.aggregate(F.transform("samples", lambda v: v.cast("double")), F.lit(0.0), _SUM).alias("s"))
    return parts.groupBy("array_id", "channel").agg(F.min("t0").alias("first"), F.max("t1").alias("last"), F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), (F.sum("s") / F.sum("n")).alias("mean"))


def label(stations: DataFrame, keys: list[str], network: str, station: str, first: str, last: str) -> DataFrame:
    """One label per group: common prefixes of its networks and stations, and its time span.

    The longest common prefix of a set is that of its least and its greatest member, so two plain aggregates find it.
    """
    g = stations.groupBy(*keys).agg(*[f(c).alias(f"__{n}_{c}") for c in (network, station) for n, f in (("lo", F.min), ("hi", F.max))], F.min(first).alias("__t0"), F.max(last).alias("__t1"))

    def prefix(c: str) -> Column:
        a, b = F.col(f"__lo_{c}"), F.col(f"__hi_{c}")
        n = F.least(F.length(a), F.length(b))
        return F.substring(a, F.lit(1), F.size(F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (i <= n) & (F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i)))))

    at = lambda c, form: F.date_format(F.timestamp_micros(F.round(F.col(c) * 1e6).cast("long")), form)
    text = F.concat(prefix(network), F.lit("."), prefix(station), F.lit("_"), at("__t0", "yyyy.MM.dd_HH.mm.ss"), F.lit("-"), at("__t1", "HH.mm.ss"))
    return g.select(*keys, text.alias("label"))


_STRETCH = "array_id string, channel string, i0 long, n long, there array<double>, back array<double>, fs double"
_STATE = "array_id string, channel string, i0 long, before array<double>, after array<double>"


def _placed(segments: DataFrame) -> DataFrame:
    """Segments with __i0 (the place of their first sample in their record) and __mean, __slope, __mid: the least-squares line of the record's samples.

    Samples are read once for the lines: a segment's sums about its own first sample are moved to where it lies in its record.
    """

    def sums(found: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in found:
            x = [v.astype(float) * c for v, c in zip(pdf["samples"], pdf["c"], strict=True)]
            yield pdf.drop(columns=["samples", "c"]).assign(n=[len(v) for v in x], x=[v.sum() for v in x], kx=[(np.arange(len(v)) * v).sum() for v in x])

    rows = segments.select("array_id", "channel", F.col("t0").cast("double").alias("t0"), last_time().cast("double").alias("t1"), F.col("fs").cast("double").alias("fs"), calibration().cast("double").alias("c"), "samples")
    own = rows.mapInPandas(sums, "array_id string, channel string, t0 double, t1 double, fs double, n long, x double, kx double")
    own = durable(own)
    own = own.join(own.groupBy("array_id", "channel").agg(F.min("t0").alias("__first"), F.max("t1").alias("__last")), ["array_id", "channel"])
    place = lambda: F.round((F.col("t0") - F.col("__first")) * F.col("fs"))
    d, n = place() - F.round((F.col("__last") - F.col("__first")) * F.col("fs")) / 2, F.col("n").cast("double")
    moved = {"t": d * n + n * (n - 1) / 2, "tx": d * F.col("x") + F.col("kx"), "tt": n * d * d + d * n * (n - 1) + n * (n - 1) * (2 * n - 1) / 6}
    line = own.groupBy("array_id", "channel", "__first", "__last").agg(F.sum("n").alias("n"), F.sum("x").alias("x"), *[F.sum(v).alias(k) for k, v in moved.items()])
    rows = F.nullif(F.col("n"), F.lit(0))
    spread = F.col("tt") - F.col("t") * F.col("t") / rows
    slope = F.when(spread > 0, (F.col("tx") - F.col("t") * F.col("x") / rows) / spread).otherwise(0.0)
    line = line.select("array_id", "channel", "__first", "__last", slope.alias("__slope"), ((F.col("x") - slope * F.col("t")) / rows).alias("__mean"))
    s = segments.join(line, ["array_id", "channel"]).withColumns({"__i0": place().cast("long"), "__c": calibration()})
    return s.withColumn("__mid", F.round((F.col("__last") - F.col("__first")) * F.col("fs")) / 2).drop("__first", "__last")


def _of_groups(df: DataFrame, keys: list[str], of_group, schema: str) -> DataFrame:
    """``of_group`` (a group's rows by i0 -> rows) over groups of ``keys``: groups are runs of sorted rows, so a small one costs no table of its own."""
    names = [c.split()[0] for c in schema.split(", ")]

    def runs(found: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held, out = None, [], []
        for pdf in found:
            for own, r in zip(zip(*[pdf[k].tolist() for k in keys], strict=True), pdf.itertuples(index=False), strict=True):
                if own != key and held:
                    out += of_group(held)
                    held = []
                key = own
                held.append(r)
            if len(out) >= 4096:
                yield pd.DataFrame(out, columns=names)
                out = []
        if held:
            out += of_group(held)
        yield pd.DataFrame(out, columns=names)

    return df.repartition(*keys).sortWithinPartitions(*keys, "i0").mapInPandas(runs, schema)


def filtered(segments: DataFrame, low: float | None, high: float | None, order: int = 4, decimate: int = 1, zero_phase: bool = True, block: float = 345_600.0) -> DataFrame:
    """Segments through a Butterworth filter of their whole record, every ``decimate``-th sample of the record kept.

    A record is calibrated (calib is 1 then) and loses the least-squares line of its samples; gaps then hold zeros. The filter starts from
    rest at the record's first sample and, with ``zero_phase``, runs back from rest at its last, so the result does not depend on how the
    record is cut into segments. No record is gathered: a segment says what it does to a filter's state, which is a few numbers; those are
    put together over blocks of ``block`` seconds, then over a record's blocks, and every segment is filtered from the states at its ends.
    A segment that keeps no sample is left out. Segments of a channel are not to overlap and have one rate.
    """
    from sondera.functions import filters

    names = segments.columns
    key = ["array_id", "channel"]
    placed = _placed(segments)

    def level(r) -> np.ndarray:
        return r.samples.astype(float) * r.c - r.mean - r.slope * (r.i0 - r.mid + np.arange(len(r.samples)))

    def stretches(found: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in found:
            out = []
            for r in pdf.itertuples(index=False):
                n, there, back = filters.butterworth(r.fs, low, high, order).stretch(level(r))
                out.append((r.array_id, r.channel, r.i0, n, there, back, r.fs))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _STRETCH.split(", ")])

    plain = {"i0": "__i0", "mean": "__mean", "slope": "__slope", "mid": "__mid", "c": "__c"}
    rows = placed.where(F.size("samples") > 0).select(*key, "fs", "samples", *[F.col(v).alias(k) for k, v in plain.items()])
    parts = durable(rows.mapInPandas(stretches, _STRETCH)).withColumn("block", F.floor(F.col("i0") / (F.col("fs") * block)))

    def of(rows: list) -> tuple:
        return filters.butterworth(float(rows[0].fs), low, high, order), [(r.n, r.there, r.back) for r in rows]

    def one(rows: list) -> list[tuple]:
        """A block's stretches as one."""
        system, own = of(rows)
        whole = own[0]
        for r, nxt in zip(rows[1:], own[1:], strict=True):
            whole = system.joined(whole, r.i0 - rows[0].i0 - whole[0], nxt)
        return [(*rows[0][:3], *whole, rows[0].fs, rows[0].block)]

    def ends_of_blocks(rows: list) -> list[tuple]:
        """The states at a record's blocks."""
        system, own = of(rows)
        rest = np.zeros(system.size)
        states = system.states(np.array([r.i0 for r in rows]), own, rest, rest)
        return [(r.array_id, r.channel, r.block, *at) for r, *at in zip(rows, *states, strict=True)]

    def ends_of_segments(rows: list) -> list[tuple]:
        """The states at a block's segments, from those at its ends."""
        system, own = of(rows)
        states = system.states(np.array([r.i0 for r in rows]), own, rows[0].before, rows[0].after)
        return [(r.array_id, r.channel, r.i0, *at) for r, *at in zip(rows, *states, strict=True)]

    whole = _of_groups(parts, [*key, "block"], one, f"{_STRETCH}, block long")
    blocks = _of_groups(whole, key, ends_of_blocks, "array_id string, channel string, block long, before array<double>, after array<double>")
    states = _of_groups(parts.join(blocks, [*key, "block"]), [*key, "block"], ends_of_segments, _STATE)

    def passes(found: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in found:
            made = []
            for r in pdf.rename(columns={v: k for k, v in plain.items()}).itertuples(index=False):
                system = filters.butterworth(r.fs, low, high, order)
                y = system.there_and_back(level(r), r.before, r.after) if zero_phase else system.run(level(r), r.before)[0]
                made.append(y[-r.i0 % decimate :: decimate])
            first = pdf["t0"] + (-pdf["__i0"] % decimate) / pdf["fs"]
            out = pdf.assign(samples=made, t0=first, fs=pdf["fs"] / decimate, **({"calib": 1.0} if "calib" in names else {}))[names]
            yield out[[len(y) > 0 for y in made]]

    schema = segments.select(*[F.col(c).cast("array<double>").alias(c) if c == "samples" else F.col(c) for c in names]).schema
    joined = placed.join(states.withColumnRenamed("i0", "__i0").select(*key, "__i0", "before", "after"), [*key, "__i0"])
    return joined.select(*names, "before", "after", *plain.values()).mapInPandas(passes, schema)
