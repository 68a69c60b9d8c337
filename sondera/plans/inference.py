"""Kernel-valued and Bayesian operators over the tables: stations and detections are made from keys, samples from events."""

from __future__ import annotations

from pyspark.sql import functions as F

from sondera.catalog import table
from sondera.functions import geodesy, physics
from sondera.operators import association, beamforming, detection, likelihood, location, propagation, spectral, yields
from sondera.plans.geo import _ARC, _PLACES, _RCEL, places
from sondera.plans.registry import query
from sondera.plans.signals import HOUR, events, fk


def segments(spark, d, channels: int = 4, arrays: int = 8):
    """Channel segments from hourly event means: one sample an hour counts as one second of a record, and a day of samples is a segment.

    A record begins with its array's first hour and ends with its last; hours without events are zero.
    """
    e = events(spark, d).withColumn("a", (F.col("user_id") % arrays).cast("string"))
    e = e.withColumn("ch", ((F.col("user_id") / arrays).cast("int") % channels))
    g = e.groupBy("a", "ch", F.floor(F.col("t") / HOUR).alias("h")).agg(F.round(F.avg("value"), 6).alias("v"))
    span = e.groupBy("a").agg(F.floor(F.min("t") / HOUR).alias("h0"), F.floor(F.max("t") / HOUR).alias("h1"))
    grid = span.join(e.select("a", "ch").distinct(), "a").withColumn("h", F.explode(F.sequence("h0", "h1"))).join(g, ["a", "ch", "h"], "left")
    part = grid.groupBy("a", "ch", F.floor(F.col("h") / 24)).agg(F.min("h").alias("h0"), F.transform(F.sort_array(F.collect_list(F.struct("h", F.coalesce("v", F.lit(0.0)).alias("v")))), lambda x: x["v"]).alias("samples"))
    angle = F.col("ch") * 1.7
    return part.select(F.col("a").alias("array_id"), F.concat(F.lit("c"), F.col("ch").cast("string")).alias("channel"), (F.col("h0") % 1_000_000).cast("double").alias("t0"), F.lit(1.0).alias("fs"), F.lit(1.0).alias("calib"), (F.cos(angle) * 400 * F.col("ch")).alias("dx"), (F.sin(angle) * 400 * F.col("ch")).alias("dy"), "samples")


def _beam(method: str):
    """The default azimuths and velocities; frequencies suit one sample a second. GLS takes the whole record for noise."""
    sub = 16.0 if method in ("capon", "music", "bartlett_covar") else None
    return beamforming.Beam(freq=(0.05, 0.4), az=(-180.0, 180.0, 3.0), vel=(300.0, 600.0, 12.5), method=method, length=64.0, step=32.0, sub_length=sub, noise=(0.0, 2.0e6) if method == "gls" else None)


def _fk_query(method: str):
    def run(spark, d):
        out = beamforming.run_fk(segments(spark, d), _beam(method))
        return out.select("array_id", "t", *[F.round(c, 6).alias(c) for c in ("back_az", "trace_vel", "power", "f_stat")], "channels")

    run.__name__ = f"fk_{method}"
    run.__doc__ = f"Beam rows of all arrays by {method}."
    return run


for _method in ("bartlett", "bartlett_covar", "gls", "capon", "music"):
    query(f"fk_{_method}")(_fk_query(_method))


@query("kde_threshold")
def kde_threshold(spark, d):
    """Adaptive F thresholds of window sums."""
    rows = fk(spark, d, 16, 1).withColumn("f", F.col("f") / 1000)
    out = detection.adaptive_threshold(rows.select("sta", "t", "f"), ["sta"], "t", "f", 86400.0 * 4, 0.01, 20.0, 4)
    return out.select("sta", "t", "f", F.round("threshold", 6).alias("threshold"))


@query("fd_adaptive")
def fd_adaptive(spark, d):
    """Adaptive detector over beam rows, merged."""
    rows = fk(spark, d, 16, 1).select(F.col("sta").cast("string").alias("array_id"), F.col("t").cast("double").alias("t"), F.col("az").alias("back_az"), F.lit(340.0).alias("trace_vel"), (F.col("f") / 1000).alias("f_stat"))
    out = detection.run_fd(rows, window=86400.0 * 4, p=0.3, time_bandwidth=20.0, channels=4, min_rows=2, az_width=180.0, merge=True)
    return out.select("array_id", "run", "t", F.round("f_stat", 6).alias("f_stat"), "back_az", "start", "end", "n_rows")


@query("histogram_detector")
def histogram_detector(spark, d):
    rows = fk(spark, d, 16, 1).withColumn("f", F.col("f") / 1000).select("sta", F.col("t").cast("double").alias("t"), "f")
    out = detection.histogram_detector(rows, ["sta"], "t", "f", 86400.0 * 2, 0.05, 20.0, 60.0, 0.1)
    return out.select("sta", "t", "f", F.round("corr", 6).alias("corr"), "hit")


#: The same records in SQL, sample by sample, and the spectra of their windows (``n`` samples every ``step``) as sums of sines and cosines.
_RECORDS = """e AS (SELECT user_id % 8 AS a, CAST(floor(user_id / 8) AS BIGINT) % 4 AS ch, CAST(floor(epoch_us(ts) / 1e6 / 3600) AS BIGINT) AS h, value FROM events),
g AS (SELECT a, ch, h, round(avg(value), 6) AS v FROM e GROUP BY ALL), sp AS (SELECT a, min(h) AS h0, max(h) AS h1 FROM e GROUP BY a),
rec AS (SELECT s.a, s.ch, h0, u.h - h0 AS i, coalesce(g.v, 0) AS v FROM (SELECT DISTINCT a, ch FROM e) s JOIN (SELECT a, h0, unnest(range(h0, h1 + 1)) AS h FROM sp) u USING (a) LEFT JOIN g ON g.a = s.a AND g.ch = s.ch AND g.h = u.h)"""


def _spectra_sql(n: int, step: int, lo: int, hi: int) -> str:
    return f"""{_RECORDS},
x AS (SELECT a, ch, h0, i // {step} - o AS win, i - {step} * (i // {step} - o) AS j, v FROM rec, range({n // step}) z(o) WHERE i // {step} - o >= 0),
t AS (SELECT j, 0.5 * (1 - cos(pi() * least(least(j / {n - 1}.0::DOUBLE, 1 - j / {n - 1}.0::DOUBLE) / 0.125, 1))) AS w FROM range({n}) r(j)),
c AS (SELECT a, ch, h0, win, j, (v - avg(v) OVER q) * w AS y FROM x JOIN t USING (j) WINDOW q AS (PARTITION BY a, ch, win) QUALIFY count(*) OVER q = {n}),
s AS (SELECT a, ch, h0, win, k, sum(y * cos(2 * pi() * k * j / {n})) AS re, sum(y * sin(2 * pi() * k * j / {n})) AS im FROM c, range({lo}, {hi}) f(k) GROUP BY ALL),
p AS (SELECT a || '.c' || ch AS channel, h0, win, k, (re * re + im * im) / (SELECT sum(w * w) FROM t) * CASE WHEN k > 0 AND 2 * k < {n} THEN 2 ELSE 1 END AS p FROM s)"""


def _named(spark, d):
    return segments(spark, d).withColumn("channel", F.concat_ws(".", "array_id", "channel"))


@query("spectrogram", f"""
WITH {_spectra_sql(80, 16, 5, 36)}
SELECT channel, CAST(h0 % 1000000 + win * 16 + 40 AS DOUBLE) AS t, round(avg(10 * log10(p)), 6) AS mean_db, round(max(10 * log10(p)), 6) AS max_db FROM p WHERE k / 80.0 > 0.05 AND k / 80.0 < 0.45 GROUP BY channel, h0, win""")
def spectrogram(spark, d):
    out = spectral.spectrogram_rows(_named(spark, d), 0.05, 0.45)
    return out.groupBy("channel", "t").agg(F.round(F.avg("db"), 6).alias("mean_db"), F.round(F.max("db"), 6).alias("max_db"))


@query("sd_detections")
def sd_detections(spark, d):
    """Spectral detections of every channel of every array, above the density of each frequency's background."""
    return spectral.run_sd(_named(spark, d), 0.05, 0.45, 200.0, 100.0, 0.05, 35.0, 12.0, 8)


@query("welch_psd", f"""
WITH {_spectra_sql(64, 32, 0, 33)}
SELECT channel, k / 64.0::DOUBLE AS f, round(10 * log10(avg(p)), 6) AS db FROM p GROUP BY channel, k""")
def welch_psd(spark, d):
    return spectral.welch_psd(_named(spark, d), 64.0).select("channel", "f", F.round("db", 6).alias("db"))


@query("dbscan", """
WITH RECURSIVE c AS (SELECT c_nationkey AS k, c_custkey AS pid, c_acctbal / 100 AS x, c_custkey % 1000 / 10 AS y FROM customer),
n AS (SELECT a.pid AS a, b.pid AS b FROM c a JOIN c b ON a.k = b.k AND (b.x - a.x) ** 2 + (b.y - a.y) ** 2 <= 36),
core AS (SELECT a FROM n GROUP BY a HAVING count(*) >= 4), l AS (SELECT n.a, n.b FROM n JOIN core p ON n.a = p.a JOIN core q ON n.b = q.a),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a), lab AS (SELECT a, min(b) AS label FROM r GROUP BY a),
bord AS (SELECT n.a, min(label) AS border FROM n JOIN lab ON n.b = lab.a GROUP BY n.a)
SELECT pid, coalesce(label, border, -1) AS cluster FROM c LEFT JOIN lab ON pid = lab.a LEFT JOIN bord ON pid = bord.a""")
def dbscan(spark, d):
    """Density clusters of customers by balance and key, within nations; -1 for noise."""
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("pid"), (F.col("c_acctbal") / 100).alias("x"), (F.col("c_custkey") % 1000 / 10).alias("y"))
    return spectral.dbscan(c, ["k"], "x", "y", 6.0, 4).select("pid", F.coalesce("cluster", F.lit(-1).cast("long")).alias("cluster"))


@query("von_mises_azimuth", f"""
WITH {_PLACES}, q AS (SELECT k, radians(a) AS a, radians(o) AS o, radians(a2) AS b, radians(o2 - o) AS l, (k * 7) % 360 AS az FROM p),
z AS (SELECT k, az, degrees(atan2(sin(l) * cos(b), cos(a) * sin(b) - sin(a) * cos(b) * cos(l))) AS t FROM q),
i AS (SELECT *, 20.0::DOUBLE AS kp, 3.75 / 20.0::DOUBLE AS y FROM z)
SELECT k, round(exp(kp * cos(radians(t - az)) - ln(2 * pi()) - (kp - 0.5 * ln(kp) + ln(0.39894228 + y * (0.01328592 + y * (0.00225319 + y * (-0.00157565 + y * (0.00916281
  + y * (-0.02057706 + y * (0.02635537 + y * (-0.01647633 + y * 0.00392377)))))))))), 9) AS pdf FROM i""")
def von_mises_azimuth(spark, d):
    from sondera.functions.circular import von_mises_pdf

    _, az, _ = geodesy.spherical_inv("a", "o", "a2", "o2")
    return places(spark, d).select("k", F.round(von_mises_pdf(az - (F.col("k") * 7) % 360, F.lit(20.0)), 9).alias("pdf"))


@query("rcel_mixture", f"""
WITH {_PLACES}, r AS (SELECT k, radians({_ARC}) * 6370.997 AS km FROM p), x AS (SELECT k, km, 3.4 + (k % 50) / 50.0::DOUBLE AS x FROM r)
SELECT k, round(({_RCEL}) / greatest(km, 0.001), 9) AS pdf FROM x""")
def rcel_mixture(spark, d):
    """Range-celerity density of travel times at known ranges."""
    p = places(spark, d)
    det = F.struct(F.col("a").alias("lat"), F.col("o").alias("lon"), F.col("t").alias("t"))
    km = F.radians(geodesy.haversine("a", "o", "a2", "o2")) * geodesy.SPHERE_KM
    p = p.withColumn("t", km * (3.4 + (F.col("k") % 50) / 50.0))
    return p.select("k", F.round(likelihood.range_celerity_pdf(det, F.col("a2"), F.col("o2"), F.lit(0.0)), 9).alias("pdf"))


_C = list(zip(physics.RCEL_WEIGHTS, physics.RCEL_MEANS, physics.RCEL_SDS, strict=True))
_NINE = " + ".join(
    f"{wi * wj} * exp(-0.5 * ((t1 - k1 * {mi}) - (t2 - k2 * {mj})) ** 2 / (k1 * k1 * {si * si} + k2 * k2 * {sj * sj})) / sqrt(2 * pi() * (k1 * k1 * {si * si} + k2 * k2 * {sj * sj}))"
    for wi, mi, si in _C
    for wj, mj, sj in _C
)


@query("pair_time_marginal_n2", f"""
WITH x AS (SELECT o_orderkey AS k, 200.0 + o_orderkey % 700 AS k1, 150.0 + o_custkey % 900 AS k2 FROM orders),
y AS (SELECT k, k1::DOUBLE AS k1, k2::DOUBLE AS k2, (k1 * 3.8)::DOUBLE AS t1, (k2 * 3.7)::DOUBLE AS t2 FROM x)
SELECT k, round({_NINE}, 9) AS pdf FROM y""")
def pair_time_marginal_n2(spark, d):
    x = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), (200.0 + F.col("o_orderkey") % 700).alias("k1"), (150.0 + F.col("o_custkey") % 900).alias("k2"))
    return x.select("k", F.round(likelihood.pair_time_marginal(F.col("k1") * 3.8, F.col("k2") * 3.7, F.col("k1"), F.col("k2")), 9).alias("pdf"))


def detections_of(spark, d, every: int = 1):
    """Detections: each group of four customers is seen from four fixed places; sources move with the group."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    c = c.withColumns({"ev": F.floor(F.col("id") / 4), "st": F.pmod(F.col("id"), F.lit(4))}).where(F.col("ev") % every == 0)
    lat, lon = (F.element_at(F.array(*[F.lit(x) for x in v]), (F.col("st") + 1).cast("int")) for v in ((40.0, 35.0, 36.0, 42.0), (-112.0, -110.0, -120.0, -118.0)))
    c = c.select("id", "ev", lat.alias("lat"), lon.alias("lon"), (38.0 + F.col("ev") % 7 * 0.15).alias("sla"), (-115.0 + F.col("ev") % 11 * 0.12).alias("slo"), (F.col("ev") * 40_000.0).alias("t0"))
    km = F.radians(geodesy.haversine("lat", "lon", "sla", "slo")) * geodesy.SPHERE_KM
    _, az, _ = geodesy.spherical_inv("lat", "lon", "sla", "slo")
    return c.select("id", "ev", "lat", "lon", (F.col("t0") + km / 0.28).alias("t"), (az + F.col("id") % 3 - 1).alias("az"), F.lit(12.0).alias("f_stat"), F.lit(4).alias("channels"), "sla", "slo", "t0")


@query("hjl_clusters")
def hjl_clusters(spark, d):
    """Events found among all detections, with the number of members."""
    dets = detections_of(spark, d).drop("ev", "sla", "slo", "t0")
    found = association.run_assoc(dets, rng_max=1200.0)
    return found.groupBy("event_id").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.round(F.max("quality"), 9).alias("quality")).drop("event_id")


@query("bisl_grid_posterior")
def bisl_grid_posterior(spark, d):
    """Location summaries of all events, and how far (km) the mean is from where the source was put."""
    dets = detections_of(spark, d)
    members = dets.withColumnRenamed("ev", "event_id")
    row = location.run_loc(members.drop("sla", "slo", "t0", "id"))
    truth = members.select("event_id", "sla", "slo", "t0").distinct()
    km = F.radians(geodesy.haversine("lat_mean", "lon_mean", "sla", "slo")) * geodesy.SPHERE_KM
    return row.join(truth, "event_id").select("event_id", *[F.round(c, 6).alias(c) for c in ("lat_mean", "lon_mean", "sd_x", "sd_y", "sd_t")], F.round(F.col("t_mean") - F.col("t0"), 3).alias("dt"), F.round(km, 3).alias("km"))


@query("spye_posterior")
def spye_posterior(spark, d):
    """Yields of events, one per customer, seen from two stations at five frequencies."""
    o = table(spark, d, "customer").select(F.col("c_custkey").alias("event_id"), (5.0 + F.col("c_custkey") % 200).alias("tons"))
    x = o.withColumn("s", F.explode(F.array(*[F.struct(F.lit(n).alias("station"), F.lit(km).alias("km")) for n, km in (("a", 200.0), ("b", 400.0))])))
    x = x.withColumn("f", F.explode(F.array(*[F.lit(v) for v in (0.25, 0.35, 0.5, 0.7, 1.0)]))).select("event_id", "tons", "s.station", "s.km", "f")
    level = physics.decibel(physics.blast_spectrum("f", F.col("tons") * 2000, F.lit(1.0))) * 2
    x = x.withColumn("db", level + 20 * F.log10(F.pow("km", F.lit(-0.835))) - 3.0)
    out = yields.yield_summary(yields.yield_posterior(x, n=41))
    return out.select("event_id", *[F.round(c, 6).alias(c) for c in ("tons", "lo68", "hi68", "lo95", "hi95")])


@query("path_geometry_model")
def path_geometry_model(spark, d):
    """A path geometry model of rays made from order lines."""
    x = table(spark, d, "lineitem")
    rays = x.select((F.col("l_extendedprice") / 300).alias("rng"), (-20 - F.col("l_quantity") / 2).alias("loss"), (F.col("l_partkey") % 360 - 180.0).alias("az"), (3.0 + (F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 1000 / 800.0).alias("rcel"), ((F.col("l_suppkey") % 13 - 6) * 0.5).alias("az_dev"))
    model = propagation.path_geometry(propagation.sectors(propagation.bounces(rays, 3, 600.0, -3.0)), rng_max=600.0, least=30)
    return model.select("az_bin", "rng", "comp", "n", *[F.round(c, 6).alias(c) for c in ("wt", "mn", "sd", "az_mn", "az_sd")])


_TURN = "((az + 360) % 360 - ((b * 45 + 180) % 360))"


@query("loss_model", f"""
WITH r AS (SELECT CAST(floor(l_extendedprice / 300 / 10) * 10 AS DOUBLE) AS rng, floor(-20 - l_quantity / 2) AS loss, l_partkey % 360 - 180 AS az FROM lineitem),
s AS (SELECT CAST(b AS INT) AS az_bin, rng, loss FROM r, range(0, 8) x(b) WHERE abs(CASE WHEN {_TURN} < -180 THEN {_TURN} + 360 WHEN {_TURN} > 180 THEN {_TURN} - 360 ELSE {_TURN} END) <= 30),
w AS (SELECT az_bin, rng, loss + o AS c, sum(v) AS w FROM s, (VALUES (-1, 0.25::DOUBLE), (0, 0.5::DOUBLE), (1, 0.25::DOUBLE)) k(o, v) GROUP BY ALL)
SELECT az_bin, rng, c + 0.5 AS loss, round(w / sum(w) OVER (PARTITION BY az_bin, rng), 9) AS p FROM w""")
def loss_model(spark, d):
    x = table(spark, d, "lineitem")
    rays = x.select((F.col("l_extendedprice") / 300).alias("rng"), (-20 - F.col("l_quantity") / 2).alias("loss"), (F.col("l_partkey") % 360 - 180.0).alias("az"))
    return propagation.loss_histogram(propagation.sectors(rays)).select("az_bin", "rng", "loss", F.round("p", 9).alias("p"))


_LEVELS = [(0.5, 60.0, 24.0), (2.0, 48.0, 14.0)]


@query("network_detection", f"""
WITH {_PLACES}, s AS (SELECT k, radians(a) AS a0, radians(o) AS o0 FROM p),
n AS (SELECT n_nationkey AS arr, radians((n_nationkey * 53) % 178 - 88.75) AS a1, radians((n_nationkey * 29) % 358 - 178.75) AS o1 FROM nation),
g AS (SELECT k, arr, greatest(acos(least(greatest(sin(a0) * sin(a1) + cos(a0) * cos(a1) * cos(o1 - o0), -1), 1)) * 6370.997, 10) AS rng,
  degrees(atan2(sin(o1 - o0) * cos(a1), cos(a0) * sin(a1) - sin(a0) * cos(a1) * cos(o1 - o0))) AS az FROM s, n),
r AS (SELECT CAST(floor(l_extendedprice / 5 / 500) * 500 AS DOUBLE) AS rng, floor(-20 - l_quantity / 2) AS loss, l_partkey % 360 - 180 AS az FROM lineitem),
t AS (SELECT CAST(b AS INT) AS az_bin, rng, loss FROM r, range(0, 8) x(b) WHERE abs(CASE WHEN {_TURN} < -180 THEN {_TURN} + 360 WHEN {_TURN} > 180 THEN {_TURN} - 360 ELSE {_TURN} END) <= 30),
w AS (SELECT az_bin, rng, loss + o AS c, sum(v) AS w FROM t, (VALUES (-1, 0.25::DOUBLE), (0, 0.5::DOUBLE), (1, 0.25::DOUBLE)) k(o, v) GROUP BY ALL),
m AS (SELECT az_bin, rng, c + 0.5 AS loss, w / sum(w) OVER (PARTITION BY az_bin, rng) AS p FROM w),
e AS (SELECT min(loss) AS l0, CAST(max(loss) - min(loss) AS INT) + 1 AS nl, min(rng) AS r_lo, max(rng) AS r_hi FROM m),
f AS (SELECT z.az_bin, z.rng, CAST(i.k AS INT) AS k, l0 + i.k AS loss FROM (SELECT DISTINCT az_bin, rng FROM m) z, e, range(0, 1000) i(k) WHERE i.k < nl),
q AS (SELECT f.az_bin, f.rng, f.k, coalesce(m.p, 0) AS p FROM f LEFT JOIN m ON f.az_bin = m.az_bin AND f.rng = m.rng AND f.loss = m.loss),
c1 AS (SELECT *, coalesce((p + lag(p) OVER l) / 2, 0) AS st, coalesce(lead(p) OVER l, 0) - p AS dp FROM q WINDOW l AS (PARTITION BY az_bin, rng ORDER BY k)),
c2 AS (SELECT *, sum(st) OVER (PARTITION BY az_bin, rng ORDER BY k ROWS UNBOUNDED PRECEDING) AS c FROM c1),
v AS (SELECT * FROM (VALUES (0.5::DOUBLE, 60.0::DOUBLE, 24.0::DOUBLE), (2.0, 48.0, 14.0)) v(f, src, noise)),
b AS (SELECT k, arr, f, CAST(CASE WHEN h / 2.0 >= 8 THEN 0 ELSE floor(h / 2.0) END AS INT) AS az_bin, greatest(noise / 2 + 5 * log10(greatest(5, rng * 0.06 / 0.0952)) - src, -20 * log10(rng)) AS lo, -5 * log10(rng) AS hi,
  least(greatest(rng, r_lo), r_hi) AS r FROM (SELECT *, least(floor((az + 180) * 8 / 180) + 1, 16) AS h FROM g), v, e),
x AS (SELECT *, floor(r / 500) * 500 AS r0, (r - floor(r / 500) * 500) / 500 AS u FROM b),
y AS (SELECT k, arr, f, az_bin, lo, hi, CASE side WHEN 0 THEN r0 ELSE least(r0 + 500, r_hi) END AS rng, sign * CASE side WHEN 0 THEN 1 - u ELSE u END AS w,
  least(greatest(CASE sign WHEN 1 THEN hi ELSE lo END - l0, 0), nl - 1) AS pos, nl FROM x, e, (VALUES (0), (1)) o(side), (VALUES (1), (-1)) z(sign)),
y2 AS (SELECT *, CAST(least(floor(pos), nl - 2) AS INT) AS kk FROM y),
a AS (SELECT y2.k, arr, f, CASE WHEN any_value(hi) > any_value(lo) THEN least(greatest(sum(coalesce(w * (c + p * (pos - kk) + dp * (pos - kk) ** 2 / 2), 0)), 0), 1) ELSE 0 END AS p
  FROM y2 LEFT JOIN c2 ON y2.az_bin = c2.az_bin AND y2.rng = c2.rng AND y2.kk = c2.k GROUP BY y2.k, arr, f)
SELECT k AS source_id, f, round(greatest(1 - exp(sum(ln(greatest(1 - p, 1e-12)))) * (1 + sum(p / greatest(1 - p, 1e-12))), 0), 4) AS p FROM a GROUP BY k, f""")
def network_detection(spark, d):
    """Probability that two or more of the nations' arrays see an event at each customer's place, under the loss model of order lines."""
    s = places(spark, d).select(F.col("k").alias("source_id"), F.col("a").alias("s_lat"), F.col("o").alias("s_lon"))
    a = table(spark, d, "nation").select(F.col("n_nationkey").alias("array_id"), ((F.col("n_nationkey") * 53) % 178 - 88.75).cast("double").alias("a_lat"), ((F.col("n_nationkey") * 29) % 358 - 178.75).cast("double").alias("a_lon"))
    rays = table(spark, d, "lineitem").select((F.col("l_extendedprice") / 5).alias("rng"), (-20 - F.col("l_quantity") / 2).alias("loss"), (F.col("l_partkey") % 360 - 180.0).alias("az"))
    losses = propagation.loss_histogram(propagation.sectors(rays), step=500.0)
    out = yields.network_performance(s, a, losses, _LEVELS, 2, step=500.0)
    return out.select("source_id", "f", F.round(F.greatest("p", F.lit(0.0)), 4).alias("p"))


@query("overlap_add", """
WITH e AS (SELECT event_id, user_id % 8 AS sta, epoch_us(ts) / 1e6 AS t, value FROM events), m AS (SELECT *, min(t) OVER (PARTITION BY sta) AS t0 FROM e),
w AS (SELECT event_id, t, value, t0 + 3600.0 * unnest(range(CAST(greatest(ceil((t - 7200 - t0) / 3600), 0) AS BIGINT), CAST(floor((t - t0) / 3600) AS BIGINT) + 1)) AS s FROM m),
g AS (SELECT *, 1 / (1 + exp(-(t - s - 1800) / 180)) / (1 + exp((t - s - 5400) / 180)) AS g FROM w)
SELECT event_id, round(sum(g * value), 6) AS beam, round(sum(g), 6) AS weight FROM g GROUP BY event_id""")
def overlap_add(spark, d):
    """Blend of neighbouring windows' beams: weighted sums of overlapping windows on one time base."""
    from sondera.operators.windows import blend_weights, hop_windows

    e = events(spark, d).withColumn("sta", F.col("user_id") % 8)
    e = e.join(e.groupBy("sta").agg(F.min("t").alias("t0")), "sta")
    w = hop_windows(e, "t", "t0", 7200.0, 3600.0)
    g = blend_weights(F.col("win_start"), F.col("t"), 7200.0, 3600.0)
    return w.groupBy("event_id").agg(F.round(F.sum(g * F.col("value")), 6).alias("beam"), F.round(F.sum(g), 6).alias("weight"))


@query("incremental_resume", """
WITH e AS (SELECT event_id, user_id, CAST(floor(epoch_us(ts) / 1e6 / 86400) AS BIGINT) AS day FROM events),
d AS (SELECT user_id, max(day) AS last FROM e WHERE user_id % 2 = 0 AND day < 19730 GROUP BY user_id)
SELECT event_id, user_id, day FROM e LEFT JOIN d USING (user_id) WHERE last IS NULL OR day > last""")
def incremental_resume(spark, d):
    """What is still to do: rows after each station's last finished day."""
    e = events(spark, d).withColumn("day", F.floor(F.col("t") / 86400))
    done = e.where("user_id % 2 = 0 and day < 19730").groupBy("user_id").agg(F.max("day").alias("last"))
    return e.join(done, "user_id", "left").where(F.col("last").isNull() | (F.col("day") > F.col("last"))).select("event_id", "user_id", "day")
