"""Geodesy, propagation and source physics over positions made from keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from sondera.catalog import table
from sondera.functions import circular, geodesy, physics
from sondera.plans.registry import query

#: Positions from a key, away from poles and the antimeridian; (lat, lon) of the key and of a second point.
_LAT, _LON = "(k * 37) % 180 - 89.5", "(k * 73) % 360 - 179.5"
_LAT2, _LON2 = "(k * 53) % 178 - 88.75", "(k * 29) % 358 - 178.75"
_PLACES = f"p AS (SELECT c_custkey AS k0, c_custkey AS k, CAST({_LAT.replace('k', 'c_custkey')} AS DOUBLE) AS a, CAST({_LON.replace('k', 'c_custkey')} AS DOUBLE) AS o, CAST({_LAT2.replace('k', 'c_custkey')} AS DOUBLE) AS a2, CAST({_LON2.replace('k', 'c_custkey')} AS DOUBLE) AS o2 FROM customer)"


def places(spark, d):
    k = table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    return k.select("k", *[F.expr(f"CAST({x} AS DOUBLE)").alias(n) for x, n in ((_LAT, "a"), (_LON, "o"), (_LAT2, "a2"), (_LON2, "o2"))])


def _r(c, n=6):
    return F.round(c, n)





def _mod(x: str, m: float) -> str:
    return f"((({x}) % {m} + {m}) % {m})"


@query("azdiff", f"""
WITH {_PLACES}, d AS (SELECT k, {_mod('a2 * 4', 360.0)} - {_mod('o * 3', 360.0)} AS d FROM p)
SELECT k, round(CASE WHEN d < -180 THEN d + 360 WHEN d > 180 THEN d - 360 ELSE d END, 6) AS d FROM d""")
def azdiff(spark, d):
    return places(spark, d).select("k", _r(geodesy.azdiff(F.col("o") * 3, F.col("a2") * 4)).alias("d"))


@query("inlonrng", f"""
WITH {_PLACES}, l AS (SELECT k, o, 3 * o2 - sign(3 * o2) * ceil((abs(3 * o2) - 180) / 360) * 360 AS x FROM p)
SELECT k, (x BETWEEN o AND o + 120) OR (x + 360 BETWEEN o AND o + 120) OR (x - 360 BETWEEN o AND o + 120) AS inside FROM l""")
def inlonrng(spark, d):
    p = places(spark, d)
    return p.select("k", geodesy.inlonrng("o", F.col("o") + 120, F.col("o2") * 3).alias("inside"))


@query("lonmod_latmod", f"""
WITH {_PLACES}, x AS (SELECT k, 5 * a AS lat, 4 * o AS lon FROM p),
y AS (SELECT *, round_even(lat / 180, 0) AS n, ceil((abs(lat) - 90) / 180) AS px FROM x),
z AS (SELECT *, lon + {_mod('px', 2)} * 180 AS l2 FROM y)
SELECT k, round((1 - 2 * {_mod('n', 2)}) * (lat - 180 * n), 6) AS lat, round(l2 - sign(l2) * ceil((abs(l2) - 180) / 360) * 360, 6) AS lon FROM z""")
def lonmod_latmod(spark, d):
    lat, lon = geodesy.fixlatlon(F.col("a") * 5, F.col("o") * 4)
    return places(spark, d).select("k", _r(lat).alias("lat"), _r(lon).alias("lon"))


_HAV = "sin(radians(a2 - a) / 2) ** 2 + cos(radians(a)) * cos(radians(a2)) * sin(radians(o2 - o) / 2) ** 2"
_ARC = f"degrees(2 * atan2(sqrt({_HAV}), sqrt(1 - ({_HAV}))))"


@query("haversine", f"WITH {_PLACES} SELECT k, round({_ARC}, 6) AS arc FROM p")
def haversine(spark, d):
    return places(spark, d).select("k", _r(geodesy.haversine("a", "o", "a2", "o2")).alias("arc"))


@query("spherical_inv", f"""
WITH {_PLACES}, q AS (SELECT k, radians(a) AS a, radians(o) AS o, radians(a2) AS b, radians(o2 - o) AS l FROM p)
SELECT k, round(degrees(acos(sin(a) * sin(b) + cos(a) * cos(b) * cos(l))), 6) AS arc,
  round({_mod('degrees(atan2(sin(l) * cos(b), cos(a) * sin(b) - sin(a) * cos(b) * cos(l)))', 360.0)}, 6) AS az,
  round({_mod('degrees(atan2(-sin(l) * cos(a), cos(b) * sin(a) - sin(b) * cos(a) * cos(l)))', 360.0)}, 6) AS baz FROM q""")
def spherical_inv(spark, d):
    arc, az, baz = geodesy.spherical_inv("a", "o", "a2", "o2")
    return places(spark, d).select("k", _r(arc).alias("arc"), _r(az).alias("az"), _r(baz).alias("baz"))


@query("spherical_fwd", f"""
WITH {_PLACES}, q AS (SELECT k, radians(a) AS a, radians(o) AS o, radians(30.25) AS g, radians(o2) AS z FROM p),
r AS (SELECT *, asin(sin(a) * cos(g) + cos(a) * sin(g) * cos(z)) AS b FROM q),
s AS (SELECT *, o + atan2(sin(z) * sin(g) * cos(a), cos(g) - sin(a) * sin(b)) AS l FROM r)
SELECT k, round(degrees(b), 6) AS lat, round(degrees(l) - sign(degrees(l)) * ceil((abs(degrees(l)) - 180) / 360) * 360, 6) AS lon,
  round({_mod('degrees(atan2(sin(o - l) * cos(a), cos(b) * sin(a) - sin(b) * cos(a) * cos(o - l)))', 360.0)}, 6) AS baz FROM s""")
def spherical_fwd(spark, d):
    lat, lon, baz = geodesy.spherical_fwd("a", "o", 30.25, "o2")
    return places(spark, d).select("k", _r(lat).alias("lat"), _r(lon).alias("lon"), _r(baz).alias("baz"))


def _xyz(a: str, o: str, n: str) -> str:
    return f"cos(radians({o})) * cos(radians({a})) AS {n}x, sin(radians({o})) * cos(radians({a})) AS {n}y, sin(radians({a})) AS {n}z"


def _cross(a: str, b: str, n: str) -> str:
    return f"{a}y * {b}z - {a}z * {b}y AS {n}x, {a}z * {b}x - {a}x * {b}z AS {n}y, {a}x * {b}y - {a}y * {b}x AS {n}z"


_ARCS = f"""q AS (SELECT k, {_xyz('a', 'o', 'p')}, {_xyz('a2', 'o2', 'r')}, {_xyz('a', 'o2', 's')}, {_xyz('a2', 'o', 't')} FROM p),
m AS (SELECT *, {_cross('p', 'r', 'm')}, {_cross('s', 't', 'n')} FROM q), e AS (SELECT *, {_cross('m', 'n', 'e')} FROM m)"""


def _size(v: str) -> str:
    return f"sqrt({v}x * {v}x + {v}y * {v}y + {v}z * {v}z)"


def _dot(u: str, a: str, b: str, factor: str = "1") -> str:
    return f"{factor} * ({u}x * ({a}x + {b}x) + {u}y * ({a}y + {b}y) + {u}z * ({a}z + {b}z))"


_APART = f"{_size('m')} > 2.5e-7 AND {_size('n')} > 2.5e-7 AND {_size('e')} > 1e-3 * {_size('m')} * {_size('n')}"


@query("gc_intersect", f"""
WITH {_PLACES}, {_ARCS} SELECT k, round(degrees(asin(ez / {_size('e')})), 5) AS lat, round(degrees(atan2(ey, ex)), 5) AS lon FROM e WHERE {_APART}""")
def gc_intersect(spark, d):
    """Where great circles through two pairs of points meet; nearly equal circles are left out."""
    x = geodesy.gc_intersect(("a", "o"), ("a2", "o2"), ("a", "o2"), ("a2", "o"), 1e-3)
    return places(spark, d).select("k", x.alias("x")).where("x is not null").select("k", _r("x.lat", 5).alias("lat"), _r("x.lon", 5).alias("lon"))


@query("gcarc_intersect", f"""
WITH {_PLACES}, {_ARCS},
c AS (SELECT *, CASE WHEN {_dot('e', 'p', 'r')} < 0 THEN -1 ELSE 1 END / {_size('e')} AS sg FROM e WHERE {_APART})
SELECT k, round(degrees(asin(sg * ez)), 5) AS lat, round(degrees(atan2(sg * ey, sg * ex)), 5) AS lon
FROM c WHERE {_dot('e', 'p', 'r', 'sg')} - {_dot('p', 'p', 'r')} > 6.25e-14 AND {_dot('e', 's', 't', 'sg')} - {_dot('s', 's', 't')} > 6.25e-14""")
def gcarc_intersect(spark, d):
    x = geodesy.gcarc_intersect(("a", "o"), ("a2", "o2"), ("a", "o2"), ("a2", "o"), 1e-3)
    return places(spark, d).select("k", x.alias("x")).where("x is not null").select("k", _r("x.lat", 5).alias("lat"), _r("x.lon", 5).alias("lon"))


@query("geocentric_geographic", f"""
WITH {_PLACES} SELECT k, round(degrees(atan2(sin(radians(a)), (1 - 8.181919084262149e-02 ** 2) * cos(radians(a)))), 6) AS geographic,
  round(degrees(atan2((1 - 8.181919084262149e-02 ** 2) * sin(radians(a)), cos(radians(a)))), 6) AS geocentric FROM p""")
def geocentric_geographic(spark, d):
    return places(spark, d).select("k", _r(geodesy.geocentric_to_geographic("a")).alias("geographic"), _r(geodesy.geographic_to_geocentric("a")).alias("geocentric"))


@query("xyz_round_trip", f"""
WITH {_PLACES} SELECT k, round(cos(radians(o)) * cos(radians(a)), 9) AS x, round(sin(radians(o)) * cos(radians(a)), 9) AS y, round(sin(radians(a)), 9) AS z, round(a, 6) AS lat, round(o, 6) AS lon FROM p""")
def xyz_round_trip(spark, d):
    x, y, z = geodesy.to_xyz("a", "o")
    lat, lon, _ = geodesy.from_xyz(x, y, z)
    return places(spark, d).select("k", _r(x, 9).alias("x"), _r(y, 9).alias("y"), _r(z, 9).alias("z"), _r(lat).alias("lat"), _r(lon).alias("lon"))


@query("earth_radius", f"""
WITH {_PLACES}, c AS (SELECT k, 6378.137::DOUBLE ** 2 AS a2, (6378.137::DOUBLE * (1 - 1 / 298.257223563::DOUBLE)) ** 2 AS b2, cos(radians(a)) ** 2 AS c, sin(radians(a)) ** 2 AS s FROM p)
SELECT k, round(sqrt((a2 * a2 * c + b2 * b2 * s) / (a2 * c + b2 * s)), 6) AS km FROM c""")
def earth_radius(spark, d):
    return places(spark, d).select("k", _r(geodesy.earth_radius("a")).alias("km"))


@query("latlon_box", f"""
WITH {_PLACES} SELECT k FROM p WHERE a BETWEEN -30 AND 60 AND ((o BETWEEN 160 AND 250) OR (o + 360 BETWEEN 160 AND 250) OR (o - 360 BETWEEN 160 AND 250))""")
def latlon_box(spark, d):
    return places(spark, d).where(geodesy.inlatlonbox(-30, 60, 160, 250, "a", "o")).select("k")


@query("radius_filter", f"WITH {_PLACES} SELECT k FROM p WHERE {_ARC.replace('a2', '37.25').replace('o2', '-115.75')} BETWEEN 10 AND 60")
def radius_filter(spark, d):
    """Events in a ring about a place."""
    return places(spark, d).where(geodesy.haversine("a", "o", 37.25, -115.75).between(10, 60)).select("k")


@query("geographic_mean", f"""
WITH {_PLACES}, m AS (SELECT k % 50 AS g, avg(cos(radians(o)) * cos(radians(a))) AS x, avg(sin(radians(o)) * cos(radians(a))) AS y, avg(sin(radians(a))) AS z FROM p WHERE k <= 1000000 GROUP BY 1)
SELECT g, round(degrees(asin(z / sqrt(x * x + y * y + z * z))), 5) AS lat, round(degrees(atan2(y, x)), 5) AS lon FROM m""".replace(" WHERE k <= 1000000", ""))
def geographic_mean(spark, d):
    lat, lon = circular.geographic_mean("a", "o")
    return places(spark, d).groupBy((F.col("k") % 50).alias("g")).agg(_r(lat, 5).alias("lat"), _r(lon, 5).alias("lon"))


@query("azimuth_bin", f"""
WITH {_PLACES}, r AS (SELECT k, degrees(atan2(sin(radians(o * 2 + 0.25)), cos(radians(o * 2 + 0.25)))) AS z FROM p), h AS (SELECT k, least(floor((z + 180) / 22.5) + 1, 16) AS h FROM r)
SELECT k, CAST(CASE WHEN h / 2 >= 8 THEN 0 ELSE floor(h / 2) END AS INT) AS bin FROM h""")
def azimuth_bin(spark, d):
    return places(spark, d).select("k", geodesy.azimuth_bin(F.col("o") * 2 + 0.25).alias("bin"))


_SRC = "s AS (SELECT p_partkey AS k, CAST(p_size AS DOUBLE) * 100 + 1.5 AS w, p_retailprice / 100 AS r FROM part), z AS (SELECT *, 1.0 / w ** (1 / 3.0::DOUBLE) * r * 1000 AS z FROM s)"
_CHEM_P = "101325.0 * 808 * (1 + (z / 4.5) ** 2) / (sqrt(1 + (z / 0.048) ** 2) * sqrt(1 + (z / 0.32) ** 2) * sqrt(1 + (z / 1.35) ** 2))"
_CHEM_T = "980 * (1 + (z / 0.54) ** 10) / ((1 + (z / 0.02) ** 3) * (1 + (z / 0.74) ** 6) * sqrt(1 + (z / 6.9) ** 2)) * w ** (1 / 3.0::DOUBLE) / 1000"


def sources(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), (F.col("p_size").cast("double") * 100 + 1.5).alias("w"), (F.col("p_retailprice") / 100).alias("r"))


@query("kg_overpressure", f"""
WITH {_SRC} SELECT k, round({_CHEM_P}, 6) AS chemical, round(101325.0 * 3.2e6 / z ** 3 * (1 + z / 800) * sqrt(1 + (z / 87) ** 2), 6) AS nuclear FROM z""")
def kg_overpressure(spark, d):
    return sources(spark, d).select("k", _r(physics.overpressure("w", "r")).alias("chemical"), _r(physics.overpressure("w", "r", kind="nuclear")).alias("nuclear"))


@query("kg_duration", f"""
WITH {_SRC} SELECT k, round({_CHEM_T}, 6) AS chemical, round(180 * sqrt(1 + (z / 100) ** 3) / (sqrt(1 + z / 40) * (1 + (z / 285) ** 5) ** (1 / 6.0::DOUBLE) * (1 + z / 50000) ** (1 / 6.0::DOUBLE)) * w ** (1 / 3.0::DOUBLE) / 1000, 6) AS nuclear FROM z""")
def kg_duration(spark, d):
    return sources(spark, d).select("k", _r(physics.duration("w", "r")).alias("chemical"), _r(physics.duration("w", "r", kind="nuclear")).alias("nuclear"))


@query("blast_spectrum", f"""
WITH {_SRC}, t AS (SELECT k, {_CHEM_P} AS p0, {_CHEM_T} AS t0 FROM z)
SELECT k, round(p0 * t0 * (2 * pi() * 0.5 * t0) / (1 + (2 * pi() * 0.5 * t0) ** 2), 6) AS amp, round(p0 * (1 - (0.1 / t0 + 1)) * exp(-(0.1 / t0 + 1)), 6) AS p_at FROM t""")
def blast_spectrum(spark, d):
    """Friedlander spectrum at 0.5 Hz and overpressure 0.1 s after the start."""
    return sources(spark, d).select("k", _r(physics.blast_spectrum(0.5, "w", "r")).alias("amp"), _r(physics.blastwave(0.1, "w", "r")).alias("p_at"))


@query("signal_duration", f"WITH {_SRC} SELECT k, round(greatest(5, r * 40 * 0.06 / (0.28 * 0.34)), 6) AS s FROM s")
def signal_duration(spark, d):
    return sources(spark, d).select("k", _r(physics.signal_duration(F.col("r") * 40, 0.28, 0.34)).alias("s"))


_RCEL = " + ".join(f"{w} * exp(-0.5 * ((x - 1 / {c}::DOUBLE) / {s}) ** 2) / ({s} * sqrt(2 * pi()))" for w, c, s in ((0.0539, 0.327, 0.066), (0.0899, 0.293, 0.08), (0.8562, 0.26, 0.33)))


@query("canonical_rcel", f"WITH x AS (SELECT p_partkey AS k, 2.5 + (p_partkey % 400) / 200.0::DOUBLE AS x FROM part) SELECT k, round({_RCEL}, 9) AS pdf FROM x")
def canonical_rcel(spark, d):
    x = 2.5 + (F.col("p_partkey") % 400) / 200.0
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), _r(physics.rcel_pdf(x), 9).alias("pdf"))


@query("arrival_window", f"WITH {_PLACES}, r AS (SELECT k, radians({_ARC}) * 6370.997 AS km FROM p) SELECT k, round(km / 0.35, 4) AS first, round(km / 0.24, 4) AS last FROM r")
def arrival_window(spark, d):
    km = F.radians(geodesy.haversine("a", "o", "a2", "o2")) * geodesy.SPHERE_KM
    first, last = physics.arrival_window(0.0, km)
    return places(spark, d).select("k", _r(first, 4).alias("first"), _r(last, 4).alias("last"))


@query("celerity", f"WITH {_PLACES}, r AS (SELECT k, radians({_ARC}) * 6370.997 AS km FROM p) SELECT k, round(km / nullif(3600.0 * (k % 7), 0), 6) AS celerity FROM r")
def celerity(spark, d):
    km = F.radians(geodesy.haversine("a", "o", "a2", "o2")) * geodesy.SPHERE_KM
    return places(spark, d).select("k", _r(physics.celerity(km, 3600.0 * (F.col("k") % 7))).alias("celerity"))


@query("octave_bands", "SELECT p_partkey AS k, CAST(n AS INT) AS n, round((1 + p_size) * 2 ** (n / 3.0::DOUBLE), 6) AS f FROM part, (SELECT unnest([-3, -2, -1, 1, 2, 3]) AS n)")
def octave_bands(spark, d):
    x = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.posexplode(physics.octave_bands((1 + F.col("p_size")).cast("double"), 3, 3)).alias("i", "f"))
    return x.select("k", F.when(F.col("i") < 3, F.col("i") - 3).otherwise(F.col("i") - 2).alias("n"), _r(F.col("f")).alias("f"))


@query("conf_ellipse", """
WITH g AS (SELECT o_custkey, stddev_pop(o_totalprice) AS x, stddev_pop(o_orderkey) AS y, covar_pop(o_totalprice, o_orderkey) AS c FROM orders GROUP BY 1 HAVING count(*) > 2),
e AS (SELECT *, (x * x + y * y) / 2 AS m, sqrt(((x * x - y * y) / 2) ** 2 + c * c) AS d FROM g)
SELECT o_custkey, round(sqrt(-2 * ln(1 - 0.95)) * sqrt(m + d), 2) AS major, round(degrees(atan2(2 * c, x * x - y * y) / 2), 4) AS angle FROM e""")
def conf_ellipse(spark, d):
    g = table(spark, d, "orders").groupBy("o_custkey").agg(F.stddev_pop("o_totalprice").alias("x"), F.stddev_pop("o_orderkey").alias("y"), F.covar_pop("o_totalprice", "o_orderkey").alias("c"), F.count(F.lit(1)).alias("n"))
    major, _, angle = physics.conf_ellipse_axes("x", "y", "c", 0.95)
    return g.where("n > 2").select("o_custkey", _r(major, 2).alias("major"), _r(angle, 4).alias("angle"))


@query("slowness_grid", """
WITH g AS (SELECT s_suppkey AS k, unnest(range(0, 24)) AS i FROM supplier), v AS (SELECT k, i, unnest([300.0, 340.0, 380.0]::DOUBLE[]) AS v FROM g)
SELECT k, i, v, round(sin(radians(i * 15 - 180)) / v, 9) AS sx, round(cos(radians(i * 15 - 180)) / v, 9) AS sy, round((k % 10 * sin(radians(i * 15 - 180)) + k % 7 * cos(radians(i * 15 - 180))) * 100 / v, 6) AS delay FROM v""")
def slowness_grid(spark, d):
    """Polar slowness grid and the plane-wave delays of each element."""
    from sondera.operators.beams import plane_delay, slowness

    az = F.explode(F.sequence(F.lit(0), F.lit(23))).alias("i")
    x = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), az)
    x = x.select("k", "i", F.explode(F.array(*[F.lit(v) for v in (300.0, 340.0, 380.0)])).alias("v"))
    sx, sy = slowness(F.col("i") * 15 - 180, F.col("v"))
    delay = plane_delay(F.col("k") % 10 * 100.0, F.col("k") % 7 * 100.0, F.col("i") * 15 - 180, F.col("v"))
    return x.select("k", F.col("i").cast("long").alias("i"), "v", _r(sx, 9).alias("sx"), _r(sy, 9).alias("sy"), _r(delay).alias("delay"))


@query("bartlett_power_single_f", """
WITH e AS (SELECT vec_id, unnest(embedding[1:8])::DOUBLE AS x, unnest(range(1, 9)) AS m FROM embeddings), g AS (SELECT vec_id, x, m, unnest(range(0, 12)) AS a FROM e),
s AS (SELECT vec_id, a, sum(x * cos(2 * pi() * m * a / 12)) AS re, sum(x * sin(2 * pi() * m * a / 12)) AS im, sum(x * x) AS xx FROM g GROUP BY 1, 2)
SELECT vec_id, a, round((re * re + im * im) / (8 * xx), 6) AS power FROM s""")
def bartlett_power_single_f(spark, d):
    """Normalised Bartlett power of an eight-channel spectrum column over twelve directions, as array folds."""
    from sondera.operators.beams import bartlett_power

    e = table(spark, d, "embeddings").select("vec_id", F.slice("embedding", 1, 8).cast("array<double>").alias("x"), F.explode(F.sequence(F.lit(0), F.lit(11))).alias("a"))
    phase = F.transform(F.sequence(F.lit(1), F.lit(8)), lambda m: m * F.col("a") * (2 * 3.141592653589793 / 12))
    return e.select("vec_id", F.col("a").cast("long").alias("a"), _r(bartlett_power(F.col("x"), phase)).alias("power"))


@query("project_max_mean", """
SELECT l_suppkey AS az, round(max(l_extendedprice), 6) AS most, round(avg(l_extendedprice), 6) AS mean FROM lineitem GROUP BY 1""")
def project_max_mean(spark, d):
    from sondera.operators.beams import project

    return project(table(spark, d, "lineitem"), ["l_suppkey"], "l_extendedprice").select(F.col("l_suppkey").alias("az"), _r(F.col("most")).alias("most"), _r(F.col("mean")).alias("mean"))


@query("decibel_clip", "SELECT event_id, round(10 * log10(greatest(value, 1e-6)), 6) AS db FROM events")
def decibel_clip(spark, d):
    return table(spark, d, "events").select("event_id", _r(physics.decibel(F.greatest(F.col("value"), F.lit(1e-6)))).alias("db"))
