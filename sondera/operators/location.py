"""Bayesian location: region, gridded posterior, summaries.

An event is one row with its detections as an array. Its posterior is either a
square grid, exploded from the row and summed with Simpson weights, all columns,
or a polar grid refined where the density is, worked out in batches of events
(``functions.posterior``), which is what ``run_loc`` takes.
"""

from __future__ import annotations

from math import radians

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondera.catalog import spread
from sondera.functions import circular, geodesy, physics
from sondera.functions import posterior as posterior_cells
from sondera.operators import integrate, likelihood


def event_rows(members: DataFrame) -> DataFrame:
    """event_id, dets: the earliest detection of each position in an event; events seen from one position only are left out."""
    det = F.struct("t", "lat", "lon", "az", "f_stat", "channels")
    one = members.groupBy("event_id", "lat", "lon").agg(F.min(det).alias("d"))
    return one.groupBy("event_id").agg(F.sort_array(F.collect_list("d")).alias("dets")).where(F.size("dets") > 1)


def event_region(events: DataFrame, width: float = 10.0, rad_min: float = 100.0, rad_max: float = 1000.0) -> DataFrame:
    """Adds lat0, lon0, radius: the mean of all crossings of the beams' centre lines, and the mean distance to the edge
    lines' crossings, within rad_min..rad_max and not over a station. Events whose beams never cross are left out."""
    beam = lambda d: F.struct(d["lat"].alias("lat"), geodesy.beam_vectors(d["lat"], d["lon"], d["az"], 90.0, (0.0, width, -width)).alias("v"))
    e = events.select("event_id", F.transform("dets", beam).alias("beams"))
    e = e.select("event_id", F.posexplode("beams").alias("i", "a"), "beams").select("event_id", "i", "a", F.posexplode("beams").alias("j", "b")).where("i < j")
    lines = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (1, 2, 3) for j in (1, 2, 3)])
    crossing = lambda k: geodesy.arc_crossing(F.col("a.v")[0], F.col("a.v")[k["i"]], F.col("b.v")[0], F.col("b.v")[k["j"]])
    x = F.transform(lines, lambda k: F.struct(((k["i"] == 1) & (k["j"] == 1)).alias("main"), crossing(k).alias("p")))
    points = e.select("event_id", F.explode(x).alias("x")).where("x.p is not null").select("event_id", "x.main", "x.p.lat", "x.p.lon")
    lat, lon = (F.when(F.col("main"), c) for c in (F.col("lat"), F.col("lon")))
    from sondera.functions.circular import geographic_mean

    mean = points.groupBy("event_id").agg(*[c.alias(n) for c, n in zip(geographic_mean(lat, lon), ("lat0", "lon0"), strict=True)]).where("lat0 is not null")
    km = lambda p, q: F.radians(geodesy.haversine(p[0], p[1], q[0], q[1])) * geodesy.SPHERE_KM
    size = points.where(~F.col("main")).join(mean, "event_id").groupBy("event_id").agg(F.avg(km(("lat0", "lon0"), ("lat", "lon"))).alias("__r"))
    out = events.join(mean, "event_id").join(size, "event_id", "left")
    near = F.array_min(F.transform("dets", lambda d: km((F.col("lat0"), F.col("lon0")), (d["lat"], d["lon"]))))
    radius = F.least(F.greatest(F.coalesce("__r", F.lit(rad_min)), F.lit(rad_min)), F.lit(rad_max), F.greatest(near, F.lit(rad_min)))
    return out.withColumn("radius", radius).drop("__r")


def posterior(regions: DataFrame, nodes: int = 41, times: int = 41) -> DataFrame:
    """event_id, i, j, k, lat, lon, t, t0, p, w: density at each grid node and its Simpson weight (radians squared times seconds); t0 is the first time. Node counts must be odd."""
    if nodes % 2 == 0 or times % 2 == 0:
        raise ValueError("odd numbers of nodes only")
    deg = F.degrees(F.col("radius") / geodesy.SPHERE_KM)
    d_lat, d_lon = 2 * deg / (nodes - 1), 2 * deg / F.cos(F.radians("lat0")) / (nodes - 1)
    km = F.transform("dets", lambda d: likelihood.range_km(d, F.col("lat0"), F.col("lon0")))
    spans = F.zip_with("dets", km, lambda d, r: F.struct((d["t"] - (r + F.col("radius")) / 0.22).alias("lo"), (d["t"] - F.greatest(r - F.col("radius"), F.lit(0.0)) / 0.34).alias("hi")))
    g = regions.withColumns({"dlat": d_lat, "dlon": d_lon, "s": spans}).withColumns({"t_lo": F.array_max("s.lo"), "t_hi": F.array_min("s.hi")}).where("t_hi > t_lo")
    g = g.select("event_id", "dets", "lat0", "lon0", "dlat", "dlon", "t_lo", ((F.col("t_hi") - F.col("t_lo")) / (times - 1)).alias("dt"), F.explode(F.sequence(F.lit(0), F.lit(nodes - 1))).alias("i"))
    g = g.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(nodes - 1))))
    half = (nodes - 1) / 2
    g = g.withColumns({"lat": F.col("lat0") + (F.col("i") - half) * F.col("dlat"), "lon": F.col("lon0") + (F.col("j") - half) * F.col("dlon")})
    fold = lambda f: F.aggregate("c", F.lit(1.0), lambda s, d: s * f(d))
    at_cell = lambda d: F.struct(d["t"].alias("t"), F.greatest(likelihood.range_km(d, F.col("lat"), F.col("lon")), F.lit(1e-3)).alias("km"), likelihood.azimuth_pdf(d, F.col("lat"), F.col("lon")).alias("z"))
    g = g.withColumn("c", F.transform("dets", at_cell)).drop("dets")  # ranges and azimuths once per cell, not per time
    g = g.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))).withColumn("t", F.col("t_lo") + F.col("k") * F.col("dt"))
    p = fold(lambda d: d["z"] * F.coalesce(physics.rcel_pdf((d["t"] - F.col("t")) / d["km"]) / d["km"], F.lit(1.0)))
    n, m = F.lit(nodes), F.lit(times)
    w = integrate.simpson_weight(F.col("i"), n) * integrate.simpson_weight(F.col("j"), n) * integrate.simpson_weight(F.col("k"), m) / 27
    w = w * F.radians("dlat") * F.radians("dlon") * F.cos(F.radians("lat")) * F.col("dt")
    return g.select("event_id", "i", "j", "k", "lat", "lon", "t", F.col("t_lo").alias("t0"), p.alias("p"), w.alias("w"))


def summary(cells: DataFrame) -> DataFrame:
    """One row per event: means and deviations (km) of the position, covariance, most likely cell and time, mean and deviation of the origin time."""
    pw = F.col("p") * F.col("w")
    base = F.col("t") - F.col("t0")
    flat = cells.groupBy("event_id", "i", "j").agg(F.first("lat").alias("lat"), F.first("lon").alias("lon"), F.sum(pw).alias("m"), F.sum(pw * F.col("t")).alias("mt"), F.sum(pw * base * base).alias("mb2"), F.sum(pw * base).alias("mb"), F.sum("p").alias("q"), F.max_by("t", "p").alias("t"))
    total = lambda c: F.sum(F.col("m") * c) / F.sum("m")
    lat, lon = F.col("lat"), F.col("lon")
    best = F.max_by(F.struct("lat", "lon", "t"), F.struct("q", -F.col("i"), -F.col("j")))
    one = flat.groupBy("event_id").agg(
        F.sum("m").alias("mass"), total(lat).alias("lat_mean"), total(lon).alias("lon_mean"), (F.sum("mt") / F.sum("m")).alias("t_mean"),
        total(lat * lat).alias("yy"), total(lon * lon).alias("xx"), total(lat * lon).alias("xy"), (F.sum("mb") / F.sum("m")).alias("b1"), (F.sum("mb2") / F.sum("m")).alias("b2"), best.alias("b"),
    )
    deg = radians(1.0) * geodesy.SPHERE_KM
    east = deg * F.cos(F.radians("lat_mean"))
    root = lambda v: F.sqrt(F.greatest(v, F.lit(0.0)))
    return one.select(
        "event_id", "mass", "lat_mean", "lon_mean", "t_mean",
        (east * root(F.col("xx") - F.col("lon_mean") ** 2)).alias("sd_x"), (deg * root(F.col("yy") - F.col("lat_mean") ** 2)).alias("sd_y"),
        (east * deg * (F.col("xy") - F.col("lat_mean") * F.col("lon_mean"))).alias("cov"), root(F.col("b2") - F.col("b1") ** 2).alias("sd_t"),
        F.col("b.lat").alias("lat_map"), F.col("b.lon").alias("lon_map"), F.col("b.t").alias("t_map"),
    )


def time_bounds(cells: DataFrame, level: float = 0.9) -> DataFrame:
    """Highest-density bounds of the origin time."""
    p = cells.groupBy("event_id", "k").agg(F.first("t").alias("t"), F.sum(F.col("p") * F.col("w")).alias("q"))
    return integrate.highest_density(p, ["event_id"], "t", "q", level)


def ellipse(row: DataFrame, level: float = 0.95, points: int = 73) -> DataFrame:
    """Points of the confidence ellipse about the mean position: event_id, k, lat, lon."""
    from sondera.functions.physics import conf_ellipse_axes

    major, minor, angle = conf_ellipse_axes("sd_x", "sd_y", "cov", level)
    e = row.select("event_id", "lat_mean", "lon_mean", major.alias("a"), minor.alias("b"), F.radians(angle).alias("u"), F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("k"))
    s = F.radians(F.col("k") * (360.0 / (points - 1)))
    x = F.col("a") * F.cos(s) * F.cos("u") - F.col("b") * F.sin(s) * F.sin("u")
    y = F.col("a") * F.cos(s) * F.sin("u") + F.col("b") * F.sin(s) * F.cos("u")
    lat = F.col("lat_mean") + F.degrees(y / geodesy.SPHERE_KM)
    return e.select("event_id", "k", lat.alias("lat"), (F.col("lon_mean") + F.degrees(x / geodesy.SPHERE_KM) / F.cos(F.radians("lat_mean"))).alias("lon"))


def summary_text(row: DataFrame, level: float = 0.95) -> DataFrame:
    """A line of text per event; the ellipse's area is pi times its axes."""
    from math import log, pi

    area = pi * F.col("sd_x") * F.col("sd_y") * (-2 * log(1 - level))
    text = F.format_string("latitude %.3f +- %.1f km, longitude %.3f +- %.1f km, origin time %s +- %.1f s, area %.0f square km", F.col("lat_mean"), F.col("sd_y"), F.col("lon_mean"), F.col("sd_x"), F.from_unixtime("t_mean"), F.col("sd_t"), area)
    return row.select("event_id", text.alias("text"))


_SUMMARY = "mass double, lat_mean double, lon_mean double, t_mean double, sd_x double, sd_y double, cov double, sd_t double, lat_map double, lon_map double, t_map double, t_lo double, t_hi double, cells long"


def refined_summary(regions: DataFrame, levels: int = 3, coarse: tuple[int, int, int] = posterior_cells.COARSE, level: float = 0.9) -> DataFrame:
    """One row per event, as ``summary`` and ``time_bounds`` have it (t_lo, t_hi), from a polar grid that is refined ``levels`` times
    where the density is; cells is their number. Events are rows of their detections, and a batch of them is a task's work. An event
    without any arrival time has a place only: its times are null. Events whose arrivals no origin can explain are left out."""
    key = regions.schema["event_id"].dataType.simpleString()
    kappa = lambda d: circular.von_mises_kappa(d["f_stat"], d["channels"])
    flat = F.transform("dets", lambda d: F.struct(*[F.coalesce(d[c].cast("double"), F.lit(float("nan"))).alias(c) for c in ("lat", "lon", "t", "az")], F.coalesce(kappa(d), F.lit(1.0)).alias("kappa")))
    names = [c.split()[0] for c in _SUMMARY.split(", ")]
    mixture = (physics.RCEL_WEIGHTS, physics.RCEL_MEANS, physics.RCEL_SDS)

    def batches(found):
        for pdf in found:
            out = []
            for r in pdf.itertuples(index=False):
                dets = {c: np.array([d[c] for d in r.dets], float) for c in ("lat", "lon", "t", "az", "kappa")}
                cells = posterior_cells.refined(dets, (r.lat0, r.lon0), r.radius, mixture, geodesy.SPHERE_KM, coarse, levels)
                if cells and (cells["p"] * cells["w"]).sum() > 0:
                    row = posterior_cells.summary(cells, level, geodesy.SPHERE_KM)
                    timed = np.isfinite(dets["t"]).any()
                    out.append((r.event_id, *(x if timed or n not in ("t_mean", "sd_t", "t_map", "t_lo", "t_hi") else None for n, x in zip(names, row, strict=True))))
            yield pd.DataFrame(out, columns=["event_id", *names])

    rows = spread(regions.select("event_id", "lat0", "lon0", "radius", flat.alias("dets")))
    return rows.mapInPandas(batches, f"event_id {key}, {_SUMMARY}")


def run_loc(members: DataFrame, width: float = 10.0, nodes: int | None = None, times: int = 41, levels: int = 3) -> DataFrame:
    """Summary rows of events from their detections (event_id, t, lat, lon, az, f_stat, channels): on the refined polar grid, or on a
    square grid of ``nodes`` by ``nodes`` by ``times``."""
    regions = event_region(event_rows(members), width)
    return refined_summary(regions, levels) if nodes is None else summary(posterior(regions, nodes, times))


def az_only(members: DataFrame) -> Column:
    """Condition for detections that have a direction but no time; their range term is 1 in every likelihood here."""
    return members["t"].isNull() & members["az"].isNotNull()
