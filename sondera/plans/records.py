"""Records, curves and densities over the tables; see ``signals`` for what stands for what."""

from __future__ import annotations

from pyspark.sql import functions as F

from sondera.catalog import table
from sondera.functions import dates, physics
from sondera.operators import beamforming, classic, detection, likelihood, propagation, records, relational, spectral
from sondera.plans.inference import segments
from sondera.plans.registry import query
from sondera.plans.signals import events, fk
from sondera.sources import tables

_SAMPLES = """v AS (SELECT vec_id, embedding::DOUBLE[] AS s FROM embeddings)"""


def vectors(spark, d):
    """Embeddings as segments: an array of eight channels to every vec_id // 8, ten samples a second, one segment each."""
    e = table(spark, d, "embeddings")
    k = F.col("vec_id")
    return e.select(F.floor(k / 8).cast("string").alias("array_id"), F.format_string("c%d", k % 8).alias("channel"), (F.floor(k / 8) % 100 * 50).cast("double").alias("t0"), F.lit(10.0).alias("fs"), F.lit(1.0).alias("calib"), ((k % 8) * 90.0).alias("dx"), ((k * k % 11) * 40.0).alias("dy"), F.transform("embedding", lambda x: x.cast("double")).alias("samples"))


@query("segment_split", f"""
WITH {_SAMPLES}, u AS (SELECT vec_id, CAST(vec_id // 8 % 100 * 50 AS DOUBLE) AS t0, unnest(range(0, len(s))) AS i, unnest(s) AS x FROM v),
k AS (SELECT vec_id, CAST(floor((t0 + i / 10.0::DOUBLE) / 2.5 + 1e-9) AS BIGINT) AS block, x FROM u)
SELECT vec_id, block, count(*) AS n, round(sum(x), 5) AS total FROM k GROUP BY vec_id, block""")
def segment_split(spark, d):
    """Segments cut at whole multiples of 2.5 s."""
    s = records.split(vectors(spark, d), 2.5)
    vec = F.col("array_id").cast("long") * 8 + F.substring("channel", 2, 9).cast("long")
    return s.select(vec.alias("vec_id"), F.floor(F.col("t0") / 2.5 + 1e-9).alias("block"), F.size("samples").cast("long").alias("n"), F.round(F.aggregate("samples", F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


@query("channel_trend", f"""
WITH {_SAMPLES}, u AS (SELECT vec_id, unnest(range(0, len(s))) / 10.0::DOUBLE AS t, unnest(s) AS x FROM v)
SELECT vec_id, round(regr_slope(x, t), 7) AS slope, round(avg(x), 7) AS mean FROM u GROUP BY vec_id""")
def channel_trend(spark, d):
    """Least-squares line of every record."""
    line = records.channel_lines(vectors(spark, d))
    vec = F.col("array_id").cast("long") * 8 + F.substring("channel", 2, 9).cast("long")
    return line.select(vec.alias("vec_id"), F.round("slope", 7).alias("slope"), F.round("mean", 7).alias("mean"))


@query("channel_statistics", f"""
WITH {_SAMPLES}, u AS (SELECT vec_id, unnest(s) AS x FROM v)
SELECT vec_id, count(*) AS n, round(min(x), 6) AS lo, round(max(x), 6) AS hi, round(avg(x), 6) AS mean FROM u GROUP BY vec_id""")
def channel_statistics(spark, d):
    s = records.statistics(vectors(spark, d))
    vec = F.col("array_id").cast("long") * 8 + F.substring("channel", 2, 9).cast("long")
    return s.select(vec.alias("vec_id"), F.col("n").cast("long").alias("n"), *[F.round(c, 6).alias(c) for c in ("lo", "hi", "mean")])


@query("stream_label", """
WITH g AS (SELECT s_nationkey, min(s_name) AS a, max(s_name) AS b, min(right(s_name, 5)) AS p, max(right(s_name, 5)) AS q, min(s_suppkey) AS t0, max(s_suppkey) AS t1 FROM supplier GROUP BY 1),
l AS (SELECT *, (SELECT count(*) FROM range(1, 60) r(i) WHERE i <= least(len(a), len(b)) AND left(a, i) = left(b, i)) AS na,
  (SELECT count(*) FROM range(1, 60) r(i) WHERE i <= least(len(p), len(q)) AND left(p, i) = left(q, i)) AS np FROM g)
SELECT s_nationkey, left(p, np) || '.' || left(a, na) || '_' || strftime(make_timestamp(t0 * 1000000), '%Y.%m.%d_%H.%M.%S') || '-' || strftime(make_timestamp(t1 * 1000000), '%H.%M.%S') AS label FROM l""")
def stream_label(spark, d):
    """Common prefixes of parts of the names of each nation's suppliers, and a time span made of their keys."""
    s = table(spark, d, "supplier").withColumn("net", F.right("s_name", F.lit(5)))
    return records.label(s, ["s_nationkey"], "net", "s_name", "s_suppkey", "s_suppkey")


@query("glob_match", "SELECT p_partkey FROM part WHERE regexp_full_match(p_brand, 'Brand#[1-3].') AND NOT regexp_full_match(p_brand, '.*[45]')")
def glob_match(spark, d):
    p = table(spark, d, "part")
    return p.where(relational.matches("p_brand", "Brand#[123]?") & relational.matches("p_brand", "*[!45]")).select("p_partkey")


@query("value_range", """SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_extendedprice >= 20000 AND l_partkey % 360 - 180 BETWEEN -60 AND 45""")
def value_range(spark, d):
    """F at least, azimuth within, without wrapping."""
    x = table(spark, d, "lineitem").withColumn("az", F.col("l_partkey") % 360 - 180)
    return x.where((F.col("l_extendedprice") >= 20000) & F.col("az").between(-60, 45)).select("l_orderkey", "l_linenumber")


@query("parameter_set", "SELECT p_partkey, p_size FROM part WHERE p_partkey = 77 AND p_size = (SELECT p_size FROM part WHERE p_partkey = 77)")
def parameter_set(spark, d):
    """The one parameter set with given values: none and one are answers, several an error."""
    p = table(spark, d, "part")
    size = p.where("p_partkey = 77").first()["p_size"]
    return relational.parameter_set(p, p_partkey=77, p_size=size).select("p_partkey", "p_size")


@query("nearest_grid_index", """
SELECT l_orderkey, l_linenumber, CAST(least(greatest(floor((l_discount * 10 - 0.05) / 0.05 + 0.5), 0), 15) AS INT) AS ix,
  CAST(least(greatest(floor((l_tax * 10 - 0.1) / 0.1 + 0.5), 0), 7) AS INT) AS iy FROM lineitem""")
def nearest_grid_index(spark, d):
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_discount") * 10).cast("double").alias("x"), (F.col("l_tax") * 10).cast("double").alias("y"))
    return relational.nearest_on_grid(x, "x", "y", (0.05, 0.05, 16), (0.1, 0.1, 8)).select("l_orderkey", "l_linenumber", "ix", "iy")


@query("grid_to_direction", """
WITH x AS (SELECT o_orderkey AS k, o_custkey % 145 * 0.05 - 3.6 AS sx, o_orderkey % 145 * 0.05 - 3.6 AS sy FROM orders), z AS (SELECT *, degrees(atan2(sx, sy)) AS a FROM x)
SELECT k, round(CASE WHEN a < 0 THEN a + 360 ELSE a END, 6) AS back_az, round(sqrt(sx * sx + sy * sy), 9) AS slowness FROM z""")
def grid_to_direction(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 145 * 0.05 - 3.6).alias("sx"), (F.col("o_orderkey") % 145 * 0.05 - 3.6).alias("sy"))
    az, s = classic.direction("sx", "sy")
    return o.select("k", F.round(az, 6).alias("back_az"), F.round(s, 9).alias("slowness"))


@query("site_coordinates", """
WITH s AS (SELECT c_custkey AS k, c_nationkey AS g, 35 + c_custkey % 100 * 0.01::DOUBLE AS la, -110 + c_custkey % 70 * 0.01::DOUBLE AS lo FROM customer),
m AS (SELECT *, avg(la) OVER (PARTITION BY g) AS a, avg(lo) OVER (PARTITION BY g) AS o FROM s),
r AS (SELECT k, radians(a) AS a0, radians(o) AS o0, radians(la) AS a1, radians(lo) AS o1 FROM m),
x AS (SELECT k, acos(least(greatest(sin(a0) * sin(a1) + cos(a0) * cos(a1) * cos(o1 - o0), -1), 1)) * 6370.997 AS km, atan2(sin(o1 - o0) * cos(a1), cos(a0) * sin(a1) - sin(a0) * cos(a1) * cos(o1 - o0)) AS z FROM r)
SELECT k, round(km * sin(z), 4) AS x, round(km * cos(z), 4) AS y FROM x""")
def site_coordinates(spark, d):
    """Kilometres from the mean position of a group."""
    s = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("g"), (35 + F.col("c_custkey") % 100 * 0.01).alias("lat"), (-110 + F.col("c_custkey") % 70 * 0.01).alias("lon"))
    return classic.site_xy(s, ["g"]).select("k", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


_CURVE = [(0.0, 0.0, 0.0), (5.0, 75.0, 132.0), (10.0, 145.0, 258.0), (20.0, 273.0, 492.0), (40.0, 455.0, 820.0), (90.0, 780.0, 1428.0)]


@query("travel_time_linear", f"""
WITH c(deg, p, s) AS (VALUES {', '.join(str(r) for r in _CURVE)}), x AS (SELECT *, lead(deg) OVER (ORDER BY deg) AS d1, lead(p) OVER (ORDER BY deg) AS p1 FROM c),
o AS (SELECT o_orderkey AS k, CAST(o_totalprice AS DOUBLE) / 5000.0 AS a FROM orders)
SELECT k, round(CASE WHEN a <= 90 THEN p + (a - deg) * (p1 - p) / (d1 - deg) END, 6) AS seconds FROM o LEFT JOIN x ON a >= deg AND a < d1""")
def travel_time_linear(spark, d):
    """A travel-time table's value at each distance, null beyond it; six coarse points stand for a table that is read from a file."""
    t = spark.createDataFrame(_CURVE, "deg double, p double, s double")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_totalprice").cast("double") / 5000.0).alias("a"))
    return tables.along(o, "a", tables.curve(t, "deg", "p"), "seconds").select("k", F.round("seconds", 6).alias("seconds"))


_PHASE = "exp(-0.5 * ((a * 13.0 + o % 11 - 5 - a * 13.2) / {sd}) ** 2) / ({sd} * sqrt(2 * pi()))"


@query("seismic_likelihood", f"""
WITH x AS (SELECT o_orderkey AS k, CAST(o_totalprice AS DOUBLE) / 5000.0 AS a, o_custkey AS o FROM orders)
SELECT k, round({_PHASE.format(sd='3.0')}, 9) AS p, round({_PHASE.format(sd='6.0')}, 9) AS s FROM x""")
def seismic_likelihood(spark, d):
    a = F.col("o_totalprice").cast("double") / 5000.0
    seen = a * 13.0 + F.col("o_custkey") % 11 - 5
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.round(likelihood.seismic_pdf(seen, a * 13.2), 9).alias("p"), F.round(likelihood.seismic_pdf(seen, a * 13.2, "s"), 9).alias("s"))


_C = list(zip(physics.RCEL_WEIGHTS, physics.RCEL_MEANS, physics.RCEL_SDS, strict=True))


@query("time_marginal_n3", f"""
WITH c(w, m, s) AS (VALUES {', '.join(f'({w}::DOUBLE, {m}::DOUBLE, {s}::DOUBLE)' for w, m, s in _C)}),
y AS (SELECT c_custkey AS k, 200.0::DOUBLE + c_custkey % 70 AS k1, 150.0::DOUBLE + c_custkey % 90 AS k2, 300.0::DOUBLE + c_custkey % 50 AS k3 FROM customer),
g AS (SELECT k, a.w * b.w * e.w / (k1 * a.s * k2 * b.s * k3 * e.s) AS n, 1 / (k1 * a.s) ** 2 AS i1, 1 / (k2 * b.s) ** 2 AS i2, 1 / (k3 * e.s) ** 2 AS i3,
  k1 * 3.8 - k1 * a.m AS d1, k2 * 3.7 - k2 * b.m AS d2, k3 * 3.75 - k3 * e.m AS d3 FROM y, c a, c b, c e)
SELECT k, round(1e9 * sum(n / sqrt(i1 + i2 + i3) * exp(-0.5 * (d1 * d1 * i1 + d2 * d2 * i2 + d3 * d3 * i3 - (d1 * i1 + d2 * i2 + d3 * i3) ** 2 / (i1 + i2 + i3)))) / (2 * pi()), 3) AS pdf FROM g GROUP BY k""")
def time_marginal_n3(spark, d):
    """Three arrivals' joint density with the origin time integrated out: 27 Gaussian terms."""
    k = F.col("c_custkey")
    c = table(spark, d, "customer").select(k.alias("k"), F.array(*[F.lit(b) + k % m for b, m in ((200.0, 70), (150.0, 90), (300.0, 50))]).alias("km"))
    c = c.withColumn("t", F.transform("km", lambda x, i: x * F.get(F.array(F.lit(3.8), F.lit(3.7), F.lit(3.75)), i)))
    return likelihood.time_marginals(c).select("k", F.round(F.col("pdf") * 1e9, 3).alias("pdf"))


@query("julian_dates", "SELECT o_orderkey, CAST(strftime(o_orderdate, '%Y%j') AS INT) AS jdate, strftime(o_orderdate, '%y-%m-%d %H:%M:%S') AS short, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS back FROM orders")
def julian_dates(spark, d):
    o = table(spark, d, "orders")
    j = dates.julian_date("o_orderdate")
    return o.select("o_orderkey", j.alias("jdate"), dates.short_time("o_orderdate").alias("short"), dates.from_julian(j).cast("string").alias("back"))


@query("noise_threshold")
def noise_threshold(spark, d):
    """One F threshold per station from the rows of the first half of the table's time."""
    rows = fk(spark, d, 16, 1).select("sta", F.col("t").cast("double").alias("t"), (F.col("f") / 1000).alias("f"))
    lo, hi = rows.agg(F.min("t"), F.avg("t")).first()
    out = detection.noise_threshold(rows, ["sta"], "t", "f", (lo, hi), 0.01, 20.0, 4)
    return out.select("sta", F.round("threshold", 6).alias("threshold"))


@query("density_threshold")
def density_threshold(spark, d):
    """Points above the kernel density's background in hop windows."""
    s = segments(spark, d).withColumn("channel", F.concat_ws(".", "array_id", "channel"))
    out = spectral.above_density(spectral.spectrogram_rows(s, 0.05, 0.45), 200.0, 100.0, 0.05)
    return out.select("channel", "t", F.round("f", 6).alias("f"), F.round("db", 5).alias("db"), F.round("threshold", 4).alias("threshold"))


@query("beam_noise_inverse")
def beam_noise_inverse(spark, d):
    """Size of every array's inverse noise covariance, from the first 200 s of its record."""
    inv = beamforming.noise_inverse(segments(spark, d), beamforming.Beam(length=32.0, noise=(0.0, 2.0e6)))
    return inv.select("array_id", F.octet_length("inverse").alias("bytes"))


@query("fk_classic")
def fk_classic(spark, d):
    """The older analysis of every array of eight channels."""
    v = vectors(spark, d).withColumns({"dx": F.col("dx") / 1000, "dy": F.col("dy") / 1000})
    out = classic.run_classic(v, classic.Classic(freq=(0.5, 4.0), length=3.0, overlap=1.0, slowness=(-3.6, 3.6, 0.3)))
    return out.select("array_id", "t", *[F.round(c, 5).alias(c) for c in ("back_az", "slowness", "f_stat", "corr_max", "rms")])


@query("best_beam")
def best_beam(spark, d):
    """Beams along one direction per window, blended into one series per array."""
    v = vectors(spark, d)
    at = v.groupBy("array_id").agg(F.max("t0").alias("t0")).select("array_id", F.explode(F.transform(F.sequence(F.lit(1), F.lit(5)), lambda k: F.col("t0") + k)).alias("t"))
    fk_rows = at.select("array_id", F.col("t").cast("double").alias("t"), (F.col("array_id").cast("long") % 360 - 180.0).alias("back_az"), F.lit(340.0).alias("trace_vel"))
    out = beamforming.best_beams(v, fk_rows, 1.0, 10.0)
    return out.select("array_id", F.round("t", 3).alias("t"), F.round("beam", 6).alias("beam"), F.round("weight", 6).alias("weight"))


@query("detection_spectra")
def detection_spectra(spark, d):
    """Signal less noise of a detection in the middle of every array's record."""
    v = vectors(spark, d)
    det = v.groupBy("array_id").agg((F.max("t0") + 3.2).alias("t")).withColumns({"start": F.lit(-0.6), "end": F.lit(0.8), "back_az": F.lit(20.0), "trace_vel": F.lit(340.0)})
    return beamforming.detection_spectra(v, det).select("array_id", F.round("f", 6).alias("f"), F.round("db", 5).alias("db"))


@query("filtered_power", f"""
WITH {_SAMPLES}, u AS (SELECT vec_id, unnest(s) AS x FROM v) SELECT vec_id, count(*) AS n FROM u GROUP BY vec_id""")
def filtered_power(spark, d):
    """Samples left by a zero-phase band filter: as many as before."""
    f = records.filtered(vectors(spark, d), 0.5, 3.0)
    vec = F.col("array_id").cast("long") * 8 + F.substring("channel", 2, 9).cast("long")
    return f.select(vec.alias("vec_id"), F.size("samples").cast("long").alias("n"))


@query("record_filter", f"""
WITH {_SAMPLES}, u AS (SELECT vec_id, unnest(range(0, len(s))) AS i, unnest(s) AS x FROM v),
l AS (SELECT vec_id, regr_slope(x, i) AS slope, regr_intercept(x, i) AS base FROM u GROUP BY vec_id),
x AS (SELECT vec_id, i, x - base - slope * i AS x FROM u JOIN l USING (vec_id)),
c AS (SELECT tan(pi() * 1.5 / 10) AS w), h AS (SELECT k, w / (1 + w) * CASE WHEN k = 0 THEN 1 ELSE (1 - a) * pow(-a, k - 1) END AS h FROM (SELECT w, (w - 1) / (w + 1) AS a FROM c), range(0, 4000) r(k)),
y AS (SELECT x.vec_id, x.i + h.k AS i, sum(x.x * h.h) AS y FROM x JOIN (SELECT vec_id, max(i) AS n FROM x GROUP BY vec_id) USING (vec_id) JOIN h ON x.i + h.k <= n GROUP BY 1, 2),
z AS (SELECT y.vec_id, y.i - h.k AS i, sum(y.y * h.h) AS z FROM y JOIN h ON y.i >= h.k GROUP BY 1, 2)
SELECT vec_id, i, round(z, 6) + 0.0 AS y FROM z WHERE i % 3 = 0""")
def record_filter(spark, d):
    """Records cut into segments of 2.5 s, through a zero-phase low-pass across their borders; every third sample of the record is kept."""
    f = records.filtered(records.split(vectors(spark, d), 2.5), None, 1.5, order=1, decimate=3, block=5.0)
    vec = F.col("array_id").cast("long") * 8 + F.substring("channel", 2, 9).cast("long")
    first = F.floor(F.col("array_id").cast("long") % 100) * 50
    f = f.select(vec.alias("vec_id"), F.round((F.col("t0") - first) * 10).cast("long").alias("i0"), F.posexplode("samples").alias("k", "y"))
    return f.select("vec_id", (F.col("i0") + 3 * F.col("k")).alias("i"), (F.round("y", 6) + 0.0).alias("y"))


@query("loss_density")
def loss_density(spark, d):
    """Kernel densities of losses per sector and range bin, by cell counts."""
    x = table(spark, d, "lineitem")
    rays = x.select((F.col("l_extendedprice") / 300).cast("double").alias("rng"), (-20 - F.col("l_quantity") / 2).cast("double").alias("loss"), (F.col("l_partkey") % 360 - 180.0).alias("az"))
    out = propagation.loss_density(propagation.sectors(rays), points=31)
    return out.select("az_bin", "rng", F.round("loss", 3).alias("loss"), F.round("p", 7).alias("p"))


@query("celerity_fit")
def celerity_fit(spark, d):
    """A mixture fitted to the reciprocal celerities of rays made from order lines."""
    x = table(spark, d, "lineitem").select((0.2 + (F.col("l_partkey") % 97) / 97.0 * 0.06 + (F.col("l_suppkey") % 89) / 89.0 * 0.06).alias("cel"))
    return propagation.fit_celerity(x).select("weights", "means", "deviations")


@query("evaluate_density", """
WITH x AS (SELECT c_custkey AS k, CAST(c_acctbal AS DOUBLE) / 1000.0 AS x FROM customer)
SELECT k, round(0.4 * 2 / 1.5 * exp(-0.5 * ((x - 1) / 1.5) ** 2) / sqrt(2 * pi()) / 2 + 0.6 * 2 / 2.0 * exp(-0.5 * ((x - 4) / 2.0) ** 2) / sqrt(2 * pi()) / 2, 9) AS p FROM x""")
def evaluate_density(spark, d):
    """A mixture of two skew normals; without skew it is one of normals, which SQL can say."""
    c = table(spark, d, "customer").withColumn("x", F.col("c_acctbal").cast("double") / 1000.0)
    return c.select(F.col("c_custkey").alias("k"), F.round(propagation.skew_normal_mixture(F.col("x"), [(0.4, 0.0, 1.0, 1.5), (0.6, 0.0, 4.0, 2.0)]), 9).alias("p"))


@query("arrival_rates", """
WITH e AS (SELECT user_id % 8 AS sta, epoch_us(ts) / 1e6 AS t FROM events) SELECT sta, CAST(floor(t / 7200) AS BIGINT) AS block, count(*) AS n FROM e GROUP BY 1, 2""")
def arrival_rates(spark, d):
    e = events(spark, d)
    return e.groupBy((F.col("user_id") % 8).alias("sta"), F.floor(F.col("t") / 7200).alias("block")).agg(F.count(F.lit(1)).alias("n"))

