"""Explosive yield: near-source spectra, transmission loss and a gridded posterior; and network detection probability."""

from __future__ import annotations

from math import log10

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sondera.functions import geodesy, physics
from sondera.operators import integrate
from sondera.operators.relational import small


def loss_pdf(loss_db: Column, km: Column) -> Column:
    """Canonical transmission-loss density: skew normal about 20 log10(r ** -0.835) + 1.5 dB, widening with range. Fixed values of the canonical model."""
    r = F.greatest(km, F.lit(0.01))
    width = 7.5 + (0.33 - 7.5) * F.exp(-r / 25.0)
    return physics.skew_normal_pdf(loss_db, 20 * F.log10(F.pow(r, F.lit(-0.835))) + 1.5, width, F.lit(-6.6))


def yield_grid(lo_tons: float, hi_tons: float, n: int) -> Column:
    """n log-spaced yields in kg, as an array."""
    step = (hi_tons / lo_tons) ** (1 / (n - 1))
    return F.array(*[F.lit(1000 * lo_tons * step**k) for k in range(n)])


def yield_posterior(spectra: DataFrame, lo_tons: float = 1.0, hi_tons: float = 1000.0, n: int = 81, ref_km: float = 1.0, ground: bool = True, source: Column | None = None) -> DataFrame:
    """event_id, kg, p (normalised over the grid) from spectral levels (event_id, station, f, db, km).

    Each level gives a density of the loss between source and station; stations
    multiply, frequencies integrate over ln f. A burst on the ground acts like
    twice its yield in free air. Yields are in kilograms; results divide by 1000 for tons.
    """
    x = spectra.withColumn("kg", F.explode(yield_grid(lo_tons, hi_tons, n)))
    w = F.col("kg") * (2.0 if ground else 1.0)
    level = physics.decibel(physics.blast_spectrum(F.col("f"), w, F.lit(ref_km))) * 2 if source is None else source
    x = x.withColumn("like", F.greatest(loss_pdf(F.col("db") - level, F.col("km") / ref_km), F.lit(1e-300)))
    by_f = x.groupBy("event_id", "kg", "f").agg(integrate.product(F.col("like")).alias("y")).withColumn("x", F.log("f"))
    total = integrate.simpson(by_f, ["event_id", "kg"], "x", "y", "p")
    return total.withColumn("p", F.col("p") / F.sum("p").over(Window.partitionBy("event_id")))


def yield_summary(grid: DataFrame) -> DataFrame:
    """Most likely yield and the 68 and 95 % bounds, in tons."""
    best = grid.groupBy("event_id").agg((F.max_by("kg", F.struct("p", -F.col("kg"))) / 1000).alias("tons"))
    for level, name in ((0.68, "68"), (0.95, "95")):
        b = integrate.highest_density(grid, ["event_id"], "kg", "p", level)
        best = best.join(b.select("event_id", (F.col("lo") / 1000).alias(f"lo{name}"), (F.col("hi") / 1000).alias(f"hi{name}")), "event_id")
    return best


#: Arrays of a network at most: a catalog's rows, read as one array column for each source.
MOST_ARRAYS = 5000


def _network(arrays: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the arrays, in order, as ``stations``; an error if they are more than a network has."""
    if arrays.limit(MOST_ARRAYS + 1).count() > MOST_ARRAYS:
        raise ValueError(f"a network has at most {MOST_ARRAYS} arrays")
    return arrays.agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("stations"))


def detection_probability(sources: DataFrame, arrays: DataFrame, probability: Column, at_least: int) -> DataFrame:
    """source_id, p: probability that ``at_least`` of the arrays detect. ``probability`` is a column over a source and an array row
    (s_lat, s_lon, a_lat, a_lon)."""
    stations = _network(arrays, ["a_lat", "a_lon"])
    x = sources.crossJoin(F.broadcast(stations)).select("source_id", "s_lat", "s_lon", F.posexplode("stations").alias("n", "a")).select("*", "a.a_lat", "a.a_lon")
    p = x.withColumn("q", probability).groupBy("source_id").agg(F.sort_array(F.collect_list(F.struct("n", "q"))).getField("q").alias("qs"))
    return p.select("source_id", integrate.at_least_k(F.col("qs"), at_least).alias("p"))


#: Sound pressure of 0 dB, 20 micropascal, as a level of amplitude.
REFERENCE_DB = 10 * log10(20e-6)


def source_level(f: Column, kg: Column) -> Column:
    """Level (dB) of a blast's spectrum at f, brought back to 1 km from near the source."""
    near = 0.035 * F.pow(kg, F.lit(1 / 3))
    return 10 * F.log10(physics.blast_spectrum(f, kg, near) * near) - REFERENCE_DB


def noise_curve(low: DataFrame, high: DataFrame, kind: str = "medium") -> DataFrame:
    """f, level (dB) of background noise from two tables (f, log_psd: decadic logarithm of Pa squared per Hz): low, high, or half-way."""
    level = lambda t, c: t.select("f", (10 * F.col("log_psd") - 2 * REFERENCE_DB).alias(c))
    if kind not in ("low", "medium", "high"):
        raise ValueError("noise is low, medium or high")
    if kind != "medium":
        return level(low if kind == "low" else high, "level")
    return level(low, "a").join(level(high, "b"), "f").select("f", ((F.col("a") + F.col("b")) / 2).alias("level"))


def loss_tails(losses: DataFrame, db: float = 1.0) -> tuple[DataFrame, float, int]:
    """A loss model (az_bin, rng, loss in equal steps of ``db``, p) as integrals: az_bin, rng, k, c (up to step k), p, dp (to the next
    step), with the first loss and the number of steps. Losses that a sector's range does not have count as 0."""
    ends = losses.agg(F.min("loss").alias("a"), F.max("loss").alias("b")).first()
    n = round((ends["b"] - ends["a"]) / db) + 1
    grid = losses.select("az_bin", F.col("rng").cast("double").alias("rng")).distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    own = losses.select("az_bin", F.col("rng").cast("double").alias("rng"), F.round((F.col("loss") - ends["a"]) / db).cast("int").alias("k"), "p")
    grid = grid.join(own, ["az_bin", "rng", "k"], "left").fillna(0.0, ["p"])
    line = Window.partitionBy("az_bin", "rng").orderBy("k")
    grid = grid.withColumn("__step", F.coalesce((F.col("p") + F.lag("p").over(line)) / 2 * db, F.lit(0.0)))
    c = F.sum("__step").over(line.rowsBetween(Window.unboundedPreceding, 0))
    return grid.select("az_bin", "rng", "k", c.alias("c"), "p", (F.coalesce(F.lead("p").over(line), F.lit(0.0)) - F.col("p")).alias("dp")), ends["a"], n


def array_probability(pairs: DataFrame, losses: DataFrame, step: float = 10.0, db: float = 1.0) -> DataFrame:
    """source_id, array_id, f, p: probability that a source is above the noise at an array.

    ``pairs``: source_id, array_id, f, rng (km), az (from the source), src and noise (dB). It is the loss density's integral over losses
    that leave the source above the noise in the window of its arrivals, between spreading in three dimensions and in half of one;
    densities are linear between losses and, ``step`` apart, between ranges. The model's first and last ranges hold beyond them.
    """
    tails, first, n = loss_tails(losses, db)
    tails = small(tails, 1 << 18)
    span = losses.agg(F.min("rng").cast("double").alias("a"), F.max("rng").cast("double").alias("b")).first()
    rng = F.greatest(F.col("rng").cast("double"), F.lit(10.0))
    least = F.col("noise") / 2 + 5 * F.log10(physics.signal_duration(rng)) - F.col("src")
    x = pairs.select("source_id", "array_id", "f", geodesy.azimuth_bin("az").alias("az_bin"), F.greatest(least, -20 * F.log10(rng)).alias("lo"), (-5 * F.log10(rng)).alias("hi"), F.least(F.greatest(rng, F.lit(span["a"])), F.lit(span["b"])).alias("r"))
    x = x.withColumn("r0", F.floor(F.col("r") / step) * step).withColumn("u", (F.col("r") - F.col("r0")) / step)
    nodes = F.array(F.struct(F.col("r0").cast("double").alias("rng"), (1 - F.col("u")).alias("w")), F.struct(F.least(F.col("r0") + step, F.lit(span["b"])).cast("double").alias("rng"), F.col("u").alias("w")))
    limits = F.array(F.struct(F.col("hi").alias("at"), F.lit(1).alias("sign")), F.struct(F.col("lo").alias("at"), F.lit(-1).alias("sign")))
    x = x.withColumn("node", F.explode(nodes)).withColumn("end", F.explode(limits))
    place = (F.col("end.at") - first) / db
    x = x.select("source_id", "array_id", "f", "az_bin", "hi", "lo", F.col("node.rng").alias("rng"), (F.col("node.w") * F.col("end.sign")).alias("w"), F.least(F.greatest(place, F.lit(0.0)), F.lit(float(n - 1))).alias("u"))
    x = x.withColumn("k", F.least(F.floor("u"), F.lit(max(n - 2, 0))).cast("int"))
    d = F.col("u") - F.col("k")
    value = F.col("w") * (F.col("c") + db * (F.col("p") * d + F.col("dp") * d * d / 2))
    joined = x.join(tails, ["az_bin", "rng", "k"], "left")
    total = F.sum(F.coalesce(value, F.lit(0.0)))
    return joined.groupBy("source_id", "array_id", "f").agg(F.when(F.first("hi") > F.first("lo"), F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0))).otherwise(0.0).alias("p"))


def network_performance(sources: DataFrame, arrays: DataFrame, losses: DataFrame, levels: list[tuple[float, float, float]], at_least: int, step: float = 10.0, db: float = 1.0) -> DataFrame:
    """source_id, f, p: probability that ``at_least`` of the arrays see a source at each frequency.

    ``sources``: source_id, s_lat, s_lon; ``arrays``: array_id, a_lat, a_lon; ``levels``: (f, source level, noise level) in dB.
    """
    stations = _network(arrays, ["array_id", "a_lat", "a_lon"])
    x = sources.crossJoin(F.broadcast(stations)).select("source_id", "s_lat", "s_lon", F.explode("stations").alias("a")).select("source_id", "s_lat", "s_lon", "a.*")
    arc, az, _ = geodesy.spherical_inv("s_lat", "s_lon", "a_lat", "a_lon")
    x = x.withColumns({"rng": F.radians(arc) * geodesy.SPHERE_KM, "az": az})
    each = F.array(*[F.struct(F.lit(float(f)).alias("f"), F.lit(float(src)).alias("src"), F.lit(float(noise)).alias("noise")) for f, src, noise in levels])
    pairs = x.withColumn("l", F.explode(each)).select("source_id", "array_id", "rng", "az", "l.*")
    p = array_probability(pairs, losses, step, db)
    qs = p.groupBy("source_id", "f").agg(F.sort_array(F.collect_list(F.struct("array_id", "p"))).getField("p").alias("qs"))
    return qs.select("source_id", "f", integrate.at_least_k(F.col("qs"), at_least).alias("p"))


def noise_level(curve: list[tuple[float, float]], f: Column) -> Column:
    """Linear interpolation of a noise curve (frequency, level), ends held."""
    out = F.when(f <= curve[0][0], F.lit(curve[0][1]))
    for (f0, y0), (f1, y1) in zip(curve, curve[1:], strict=False):
        out = out.when(f <= f1, y0 + (f - f0) * ((y1 - y0) / (f1 - f0)))
    return out.otherwise(F.lit(curve[-1][1]))


def source_spectrum(observed: DataFrame, losses: DataFrame, levels: tuple[float, float, int], step: float = 10.0) -> DataFrame:
    """Density of source levels from observed spectra: event_id, f, level, p, the product over stations of the loss model's density at (observed - source) level.

    ``observed``: event_id, station, f, db, km, az_bin; ``losses``: az_bin, rng, loss (equal steps), p. Densities are linear
    between losses, at the station's range bin; ``levels``: from, to, count. A station outside the model counts as density 1e-9.
    """
    lo, hi, n = levels
    bins = losses.agg(F.min("loss").alias("l0"), ((F.max("loss") - F.min("loss")) / (F.count_distinct("loss") - 1)).alias("dl")).first()
    x = observed.withColumn("level", F.explode(F.array(*[F.lit(lo + (hi - lo) * k / (n - 1)) for k in range(n)])))
    at = (F.col("db") - F.col("level") - bins["l0"]) / bins["dl"]
    x = x.withColumns({"rng": F.round(F.col("km") / step) * step, "u": at, "i": F.floor(at)})
    two = x.withColumn("k", F.explode(F.array(F.col("i"), F.col("i") + 1))).withColumn("w", 1 - F.abs(F.col("u") - F.col("k")))
    grid = losses.select("az_bin", F.col("rng").cast("double").alias("rng"), F.round((F.col("loss") - bins["l0"]) / bins["dl"]).cast("long").alias("k"), "p")
    own = two.join(grid, ["az_bin", "rng", "k"], "left").groupBy("event_id", "station", "f", "level").agg(F.sum(F.col("w") * F.coalesce("p", F.lit(0.0))).alias("p"))
    return own.groupBy("event_id", "f", "level").agg(F.exp(F.sum(F.log(F.greatest("p", F.lit(1e-9))))).alias("p"))
