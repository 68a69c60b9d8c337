"""Windows, detection runs and profile statistics over the events table.

Events stand in for channel samples: ``user_id % n`` is the station, ``value`` the amplitude, ``event_id`` gives an azimuth.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sondera.catalog import epoch, table
from sondera.functions.circular import circular_mean, circular_std
from sondera.operators import integrate, relational, windows
from sondera.plans.registry import query

DAY, HOUR = 86400, 3600


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("t", epoch("ts"))


def fk(spark: SparkSession, d: str, stations: int = 4, hours: int = 6) -> DataFrame:
    """One row per station and tumbling window: t, f (sum of amplitudes), az, n."""
    win = hours * HOUR
    e = events(spark, d)
    g = e.groupBy((F.col("user_id") % stations).alias("sta"), (F.floor(F.col("t") / win) * win).alias("t"))
    g = g.agg(F.round(F.sum("value"), 6).alias("f"), F.max("event_id").alias("eid"), F.count(F.lit(1)).alias("n"))
    return g.withColumn("az", ((F.col("eid") * 37) % 360 - 180).cast("double"))


def _fk_sql(stations: int = 4, hours: int = 6) -> str:
    win = hours * HOUR
    return f"""fk AS (SELECT user_id % {stations} AS sta, CAST(floor(epoch_us(ts) / 1e6 / {win}) * {win} AS BIGINT) AS t, round(sum(value), 6) AS f,
      max(event_id) AS eid, count(*) AS n, CAST((max(event_id) * 37) % 360 - 180 AS DOUBLE) AS az FROM events GROUP BY 1, 2)"""


_CSTD = "degrees(sqrt(-2 * ln(least(sqrt(avg(sin(radians(az))) ** 2 + avg(cos(radians(az))) ** 2), 1.0))))"


@query("hop_windows", """
WITH e AS (SELECT user_id % 8 AS sta, epoch_us(ts) / 1e6 AS t, value FROM events),
s AS (SELECT *, min(t) OVER (PARTITION BY sta) AS t0 FROM e),
w AS (SELECT sta, unnest(range(CAST(greatest(ceil((t - 21600 - t0) / 10800), 0) AS BIGINT), CAST(floor((t - t0) / 10800) AS BIGINT) + 1)) AS k, value FROM s)
SELECT sta, k, count(*) AS n, round(max(value), 6) AS peak FROM w GROUP BY sta, k""")
def hop_windows(spark, d):
    e = events(spark, d).withColumn("sta", F.col("user_id") % 8)
    e = e.join(e.groupBy("sta").agg(F.min("t").alias("t0")), "sta")
    w = windows.hop_windows(e, "t", "t0", 21600.0, 10800.0)
    k = F.round((F.col("win_start") - F.col("t0")) / 10800).cast("long")
    return w.groupBy("sta", k.alias("k")).agg(F.count(F.lit(1)).alias("n"), F.round(F.max("value"), 6).alias("peak"))


@query("daily_tumbling", """
SELECT user_id % 16 AS sta, CAST(strftime(date_trunc('day', ts), '%Y%j') AS INT) AS jday, count(*) AS n, round(min(value), 6) AS lo, round(max(value), 6) AS hi
FROM events GROUP BY 1, 2""")
def daily_tumbling(spark, d):
    jday = (F.year("day") * 1000 + F.dayofyear("day")).cast("int")
    e = table(spark, d, "events").withColumn("day", F.date_trunc("day", "ts"))
    return e.groupBy((F.col("user_id") % 16).alias("sta"), jday.alias("jday")).agg(F.count(F.lit(1)).alias("n"), F.round(F.min("value"), 6).alias("lo"), F.round(F.max("value"), 6).alias("hi"))


@query("detection_runs_fixed", f"""
WITH {_fk_sql()},
m AS (SELECT sta, median(f) AS thr FROM fk GROUP BY sta),
x AS (SELECT fk.*, f > thr AND lead(t) OVER w IS NOT NULL AS hit FROM fk JOIN m USING (sta) WINDOW w AS (PARTITION BY sta ORDER BY t)),
y AS (SELECT *, CASE WHEN hit AND NOT coalesce(lag(hit) OVER (PARTITION BY sta ORDER BY t), false) THEN 1 ELSE 0 END AS turn FROM x),
z AS (SELECT *, sum(turn) OVER (PARTITION BY sta ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM y),
g AS (SELECT sta, run, count(*) AS n_rows, min(t) AS first, max(t) AS last, 2 * {_CSTD} AS spread,
  arg_max(t, f) AS peak_t, max(f) AS peak_f, arg_max(az, f) AS az FROM z WHERE hit GROUP BY sta, run)
SELECT sta, CAST(run AS BIGINT) AS run, peak_t AS t, round(peak_f, 4) AS f_stat, round(az, 2) AS back_az, first - peak_t AS "start", last - peak_t AS "end", n_rows, round(spread, 6) AS spread
FROM g WHERE n_rows >= 3 AND spread < 200""")
def detection_runs_fixed(spark, d):
    """Windows, threshold mask, runs, circular gate, peak row: the fixed-threshold detector."""
    rows = fk(spark, d)
    rows = rows.join(rows.groupBy("sta").agg(F.median("f").alias("thr")), "sta").withColumn("hit", F.col("f") > F.col("thr"))
    found = windows.detections(windows.runs(rows, ["sta"], "t", "hit", 3), ["sta"], "t", "f", "az", 200.0, [])
    return found.select("sta", "run", "t", F.round("f", 4).alias("f_stat"), F.round("az", 2).alias("back_az"), "start", "end", "n_rows", F.round("spread", 6).alias("spread"))


@query("centred_range_clamped", f"""
WITH {_fk_sql()},
b AS (SELECT *, min(t) OVER (PARTITION BY sta) AS a, max(t) OVER (PARTITION BY sta) AS z FROM fk),
c AS (SELECT *, greatest(CASE WHEN t - 86400 < a THEN a WHEN t + 86400 > z THEN z - 172800 ELSE t - 86400 END, a) AS lo FROM b)
SELECT c.sta, c.t, round(avg(k.f), 6) AS mean_f, count(*) AS n FROM c JOIN fk k ON k.sta = c.sta AND k.t BETWEEN c.lo AND least(c.lo + 172800, c.z) GROUP BY c.sta, c.t""")
def centred_range_clamped(spark, d):
    return windows.clamped_stat(fk(spark, d), ["sta"], "t", 172800, {"mean_f": F.round(F.avg("f"), 6), "n": F.count(F.lit(1))})


@query("centred_range_strict", f"""
WITH {_fk_sql()}
SELECT sta, t, CASE WHEN count(*) OVER w >= 5 THEN round(avg(f) OVER w, 6) END AS mean_f, count(*) OVER w AS n FROM fk
WINDOW w AS (PARTITION BY sta ORDER BY t RANGE BETWEEN 86399 PRECEDING AND 86399 FOLLOWING)""")
def centred_range_strict(spark, d):
    """A window open at both ends, with null where it holds too few rows."""
    w = Window.partitionBy("sta").orderBy("t").rangeBetween(-86399, 86399)
    n = F.count(F.lit(1)).over(w)
    return fk(spark, d).select("sta", "t", F.when(n >= 5, F.round(F.avg("f").over(w), 6)).alias("mean_f"), n.alias("n"))


@query("adaptive_threshold_mask", f"""
WITH {_fk_sql()},
b AS (SELECT *, min(t) OVER (PARTITION BY sta) AS a, max(t) OVER (PARTITION BY sta) AS z FROM fk),
c AS (SELECT *, greatest(CASE WHEN t - 216000 < a THEN a WHEN t + 216000 > z THEN z - 432000 ELSE t - 216000 END, a) AS lo FROM b),
m AS (SELECT c.sta, c.t, any_value(c.f) AS f, least(1.1 * median(k.f), 60000.0) AS thr FROM c JOIN fk k ON k.sta = c.sta AND k.t BETWEEN c.lo AND least(c.lo + 432000, c.z) GROUP BY c.sta, c.t)
SELECT sta, t, round(thr, 6) AS threshold, f >= thr AS hit FROM m""")
def adaptive_threshold_mask(spark, d):
    """The mask of the adaptive detector: at or above the window's scaled centre, under a ceiling."""
    rows = fk(spark, d)
    thr = windows.clamped_stat(rows, ["sta"], "t", 432000, {"m": F.median("f")})
    thr = rows.join(thr, ["sta", "t"]).withColumn("thr", F.least(1.1 * F.col("m"), F.lit(60000.0)))
    return thr.select("sta", "t", F.round("thr", 6).alias("threshold"), (F.col("f") >= F.col("thr")).alias("hit"))


@query("topk_peaks", f"""
WITH {_fk_sql(16)} SELECT sta, rk, t, f FROM (SELECT *, row_number() OVER (PARTITION BY sta ORDER BY f DESC, t) AS rk FROM fk) WHERE rk <= 3""")
def topk_peaks(spark, d):
    w = Window.partitionBy("sta").orderBy(F.desc("f"), "t")
    return fk(spark, d, 16).withColumn("rk", F.row_number().over(w)).where("rk <= 3").select("sta", F.col("rk").cast("long").alias("rk"), "t", "f")


@query("cum_energy_cut", """
WITH x AS (SELECT vec_id, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings),
y AS (SELECT vec_id, i, v * v AS p, sum(v * v) OVER (PARTITION BY vec_id ORDER BY v * v DESC, i ROWS UNBOUNDED PRECEDING) / sum(v * v) OVER (PARTITION BY vec_id) AS c FROM x)
SELECT vec_id, count(*) AS n_sources FROM y WHERE round(c, 9) < 0.85 GROUP BY vec_id""")
def cum_energy_cut(spark, d):
    """How many components hold 85 % of the energy, largest first; one array fold per row, no shuffle."""
    e = table(spark, d, "embeddings")
    p = F.array_sort(F.transform("embedding", lambda v: v.cast("double") * v.cast("double")), lambda a, b: F.when(a > b, -1).when(a < b, 1).otherwise(0))
    total = F.aggregate("p", F.lit(0.0), lambda a, x: a + x)
    state = F.struct(F.lit(0.0).alias("s"), F.lit(0).cast("long").alias("n"))
    step = lambda a, x: F.struct((a["s"] + x).alias("s"), (a["n"] + F.when(F.round((a["s"] + x) / F.col("total"), 9) < 0.85, 1).otherwise(0)).alias("n"))
    out = e.select("vec_id", p.alias("p")).withColumn("total", total)
    return out.select("vec_id", F.aggregate("p", state, step)["n"].alias("n_sources")).where("n_sources > 0")


@query("local_max_profile", """
WITH g AS (SELECT event_id % 180 AS az, round(sum(value), 6) AS p FROM events GROUP BY 1),
n AS (SELECT *, lag(p) OVER (ORDER BY az) AS a, lead(p) OVER (ORDER BY az) AS b FROM g)
SELECT az, p FROM n WHERE p >= a AND p >= b""")
def local_max_profile(spark, d):
    g = table(spark, d, "events").groupBy((F.col("event_id") % 180).alias("az")).agg(F.round(F.sum("value"), 6).alias("p"))
    return windows.local_maxima(g.withColumn("k", F.lit(0)), ["k"], "az", "p").select("az", "p")


@query("circular_std", f"SELECT user_id % 32 AS sta, round({_CSTD.replace('az', '(event_id * 37 + user_id * 11) % 90')}, 6) AS sd FROM events GROUP BY 1")
def circular_std_query(spark, d):
    az = (F.col("event_id") * 37 + F.col("user_id") * 11) % 90
    return table(spark, d, "events").groupBy((F.col("user_id") % 32).alias("sta")).agg(F.round(circular_std(az), 6).alias("sd"))


@query("circular_mean", """
SELECT user_id % 32 AS sta, round(degrees(atan2(avg(sin(radians((event_id * 37) % 120 - 60))), avg(cos(radians((event_id * 37) % 120 - 60))))), 6) AS az
FROM events GROUP BY 1""")
def circular_mean_query(spark, d):
    az = (F.col("event_id") * 37) % 120 - 60
    return table(spark, d, "events").groupBy((F.col("user_id") % 32).alias("sta")).agg(F.round(circular_mean(az), 6).alias("az"))


@query("weighted_freq_avg", """
WITH x AS (SELECT l_suppkey, l_linenumber, avg(l_extendedprice) AS p, sum(l_quantity) AS w FROM lineitem GROUP BY 1, 2)
SELECT l_suppkey, round(sum(w * p) / sum(w), 6) AS p FROM x GROUP BY 1""")
def weighted_freq_avg(spark, d):
    """Frequency-weighted mean; line numbers are the frequencies, suppliers the slowness points."""
    x = table(spark, d, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(F.avg("l_extendedprice").alias("p"), F.sum("l_quantity").alias("w"))
    return x.groupBy("l_suppkey").agg(F.round(integrate.weighted_mean(F.col("p"), F.col("w")), 6).alias("p"))


@query("simpson_integral", """
WITH p AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_custkey) AS n, o_totalprice AS y FROM orders),
w AS (SELECT *, CASE WHEN n % 2 = 1 THEN n ELSE n - 1 END AS odd FROM p),
t AS (SELECT o_custkey, y * (CASE WHEN i < odd AND odd > 1 THEN (CASE WHEN i = 0 OR i = odd - 1 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) / 3 ELSE 0 END
  + CASE WHEN n % 2 = 0 AND i >= n - 2 THEN 0.5 ELSE 0 END) AS v FROM w)
SELECT o_custkey, round(sum(v), 4) AS integral FROM t GROUP BY o_custkey""")
def simpson_integral(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    o = table(spark, d, "orders").withColumn("x", F.row_number().over(w).cast("double"))
    return integrate.simpson(o, ["o_custkey"], "x", "o_totalprice").select("o_custkey", F.round("integral", 4).alias("integral"))


@query("product_agg", """
SELECT l_orderkey, round(product(1 - l_discount), 9) AS p FROM lineitem GROUP BY 1""")
def product_agg(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.round(integrate.product(1 - F.col("l_discount")), 9).alias("p"))


@query("hist_fixed_bins", """
SELECT l_suppkey % 16 AS grp, CAST(least(floor((l_quantity - 1) / 2.45), 19) AS INT) AS bin, count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 1 AND 50 GROUP BY 1, 2""")
def hist_fixed_bins(spark, d):
    x = table(spark, d, "lineitem").withColumn("grp", F.col("l_suppkey") % 16)
    return integrate.fixed_histogram(x, ["grp"], "l_quantity", 1.0, 50.0, 20)


@query("hist_corr", """
WITH h AS (SELECT l_suppkey % 16 AS grp, least(floor((l_extendedprice - 900) / 5205), 19) AS bin, count(*) AS n FROM lineitem WHERE l_extendedprice BETWEEN 900 AND 105000 GROUP BY 1, 2)
SELECT grp, round(corr(n, exp(-bin / 8.0)), 6) AS r FROM h GROUP BY grp""")
def hist_corr(spark, d):
    """Correlation of a histogram with a theoretical density on the same bins."""
    x = table(spark, d, "lineitem").withColumn("grp", F.col("l_suppkey") % 16)
    h = integrate.fixed_histogram(x, ["grp"], "l_extendedprice", 900.0, 105000.0, 20)
    return h.groupBy("grp").agg(F.round(F.corr("n", F.exp(-F.col("bin") / 8.0)), 6).alias("r"))


@query("hdi_discrete", """
WITH p AS (SELECT l_suppkey % 16 AS grp, l_linenumber * 10 + CAST(l_quantity AS INT) % 10 AS x, round(sum(l_extendedprice), 2) AS p FROM lineitem GROUP BY 1, 2),
s AS (SELECT *, p / sum(p) OVER (PARTITION BY grp) AS q FROM p),
c AS (SELECT *, sum(q) OVER (PARTITION BY grp ORDER BY p DESC, x ROWS UNBOUNDED PRECEDING) AS cum FROM s)
SELECT grp, min(x) AS lo, max(x) AS hi, count(*) AS cells, round(sum(q), 6) AS mass FROM c WHERE cum - q < 0.68 GROUP BY grp""")
def hdi_discrete(spark, d):
    x = (F.col("l_linenumber") * 10 + F.col("l_quantity").cast("int") % 10).alias("x")
    p = table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 16).alias("grp"), x).agg(F.round(F.sum("l_extendedprice"), 2).alias("p"))
    out = integrate.highest_density(p, ["grp"], "x", "p", 0.68)
    return out.select("grp", "lo", "hi", "cells", F.round("mass", 6).alias("mass"))


@query("poisson_binomial", """
WITH RECURSIVE p AS (SELECT o_custkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, count(*) OVER (PARTITION BY o_custkey) AS n, (o_orderkey % 89) / 97.0::DOUBLE AS q FROM orders),
r AS (SELECT DISTINCT k, 0::BIGINT AS i, 1.0::DOUBLE AS a, 0.0::DOUBLE AS b FROM p
  UNION ALL SELECT p.k, p.i, r.a * (1 - p.q), r.b * (1 - p.q) + r.a * p.q FROM r JOIN p ON p.k = r.k AND p.i = r.i + 1)
SELECT p.k AS o_custkey, round(1 - (r.a + r.b), 6) AS p_detect FROM r JOIN p ON p.k = r.k AND p.i = r.i AND p.i = p.n""")
def poisson_binomial(spark, d):
    """Probability that two or more of a network's arrays detect."""
    p = (F.col("o_orderkey") % 89) / 97.0
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", p.alias("p")))).getField("p").alias("ps")).select("o_custkey", F.round(integrate.at_least_k(F.col("ps"), 2), 6).alias("p_detect"))


@query("blandford_f", """
WITH s AS (SELECT user_id % 4 AS ch, floor(epoch_us(ts) / 1e6 / 3600) AS n, avg(value) AS x FROM events GROUP BY 1, 2),
f AS (SELECT n, x, floor(n / 24) AS day FROM s QUALIFY count(*) OVER (PARTITION BY n) = 4),
b AS (SELECT n, day, sum(x) AS b, sum(x * x) AS xx FROM f GROUP BY n, day)
SELECT CAST(day AS BIGINT) AS day, count(*) AS n, round(3 * sum(b * b) / (4 * sum(xx - b * b / 4)), 4) AS f_stat FROM b GROUP BY day HAVING count(*) > 1""")
def blandford_f(spark, d):
    """Blandford's F of a four-channel beam, as plain aggregates: (M - 1) sum B^2 / (M sum (x - mean)^2)."""
    s = events(spark, d).groupBy((F.col("user_id") % 4).alias("ch"), F.floor(F.col("t") / HOUR).alias("n")).agg(F.avg("value").alias("x"))
    b = s.groupBy("n").agg(F.sum("x").alias("b"), F.sum(F.col("x") * F.col("x")).alias("xx"), F.count(F.lit(1)).alias("m")).where("m = 4")
    g = b.groupBy(F.floor(F.col("n") / 24).alias("day")).agg(F.count(F.lit(1)).alias("n"), (3 * F.sum(F.col("b") * F.col("b")) / (4 * F.sum(F.col("xx") - F.col("b") * F.col("b") / 4))).alias("f"))
    return g.where("n > 1").select("day", "n", F.round("f", 4).alias("f_stat"))


@query("pearson_triplets", """
WITH s AS (SELECT user_id % 5 AS ch, floor(epoch_us(ts) / 1e6 / 3600) AS n, avg(value) AS x FROM events GROUP BY 1, 2),
c AS (SELECT a.ch AS i, b.ch AS j, corr(a.x, b.x) AS r FROM s a JOIN s b ON a.n = b.n AND a.ch < b.ch GROUP BY 1, 2)
SELECT x.i AS a, x.j AS b, y.j AS c, round((x.r + y.r + z.r) / 3, 6) AS mean_r, round(least(x.r, y.r, z.r), 6) AS min_r, round(greatest(x.r, y.r, z.r), 6) AS max_r
FROM c x JOIN c y ON x.j = y.i JOIN c z ON z.i = x.i AND z.j = y.j""")
def pearson_triplets(spark, d):
    """Correlations of channel triplets: pairs first, then a join of three pairs."""
    s = events(spark, d).groupBy((F.col("user_id") % 5).alias("ch"), F.floor(F.col("t") / HOUR).alias("n")).agg(F.avg("value").alias("x"))
    c = relational.pairs_within(s, "n", "ch", ["x"]).groupBy("ch_a", "ch_b").agg(F.corr("x_a", "x_b").alias("r"))
    x = c.toDF("a", "b", "x")
    y, z = c.toDF("b", "c", "y"), c.toDF("a", "c", "z")
    out = x.join(y, "b").join(z, ["a", "c"])
    mean = (F.col("x") + F.col("y") + F.col("z")) / 3
    return out.select("a", "b", "c", F.round(mean, 6).alias("mean_r"), F.round(F.least("x", "y", "z"), 6).alias("min_r"), F.round(F.greatest("x", "y", "z"), 6).alias("max_r"))
