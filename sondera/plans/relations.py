"""Predicates, joins and set operations of the parameter and result tables, over the star tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sondera.catalog import epoch, table
from sondera.operators import relational
from sondera.plans.registry import query
from sondera.plans.signals import _fk_sql, fk


@query("scan_overlap_interval", """
WITH w AS (SELECT l_orderkey, l_linenumber, epoch_us(l_shipdate) / 1e6 AS t0, epoch_us(l_shipdate) / 1e6 + l_quantity * 86400 AS t1 FROM lineitem)
SELECT l_orderkey, l_linenumber FROM w WHERE t0 < 804556800 AND t1 > 801964800""")
def scan_overlap_interval(spark, d):
    """Segments that overlap a span: start before its end, end after its start."""
    t0 = epoch("l_shipdate")
    x = table(spark, d, "lineitem").where((t0 < 804556800) & (t0 + F.col("l_quantity") * 86400 > 801964800))
    return x.select("l_orderkey", "l_linenumber")


@query("filter_like_station", "SELECT p_partkey, p_name FROM part WHERE p_brand LIKE 'Brand#1%' AND p_type LIKE '%E%'")
def filter_like_station(spark, d):
    glob = lambda c, g: F.col(c).like(g.replace("*", "%"))
    return table(spark, d, "part").where(glob("p_brand", "Brand#1*") & glob("p_type", "*E*")).select("p_partkey", "p_name")


@query("filter_temporal_validity", """
WITH s AS (SELECT s_suppkey, 8000 + s_suppkey % 1000 AS ondate, CASE WHEN s_suppkey % 3 = 0 THEN -1 ELSE 8600 + s_suppkey % 700 END AS offdate FROM supplier)
SELECT s_suppkey FROM s WHERE (offdate = -1 OR offdate > 9000) AND ondate < 8900""")
def filter_temporal_validity(spark, d):
    """Sites in use: no end date (-1 read as null) or one after the span, and begun before it."""
    s = table(spark, d, "supplier").select("s_suppkey", (8000 + F.col("s_suppkey") % 1000).alias("ondate"), F.when(F.col("s_suppkey") % 3 != 0, 8600 + F.col("s_suppkey") % 700).alias("offdate"))
    return s.where((F.col("offdate").isNull() | (F.col("offdate") > 9000)) & (F.col("ondate") < 8900)).select("s_suppkey")


@query("sentinel_fallback", """
SELECT event_id, CASE WHEN event_id % 7 = 0 THEN round(value, 6) ELSE round(1 / (value + 1), 6) END AS trvel FROM events""")
def sentinel_fallback(spark, d):
    """1 / slowness where it is known (not -1), else the trace velocity."""
    slow = F.when(F.col("event_id") % 7 == 0, F.lit(-1.0)).otherwise(F.col("value") + 1)
    known = F.nullif(slow, F.lit(-1.0))
    return table(spark, d, "events").select("event_id", F.coalesce(F.round(1 / known, 6), F.round("value", 6)).alias("trvel"))


@query("json_dialect_coalesce", r"""
WITH e AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '{"F Stat.": ' || event_id || ', "Array Dim.": 4}' ELSE '{"F Statistic": ' || event_id || ', "Array Dimension": 6}' END AS j FROM events)
SELECT event_id, coalesce(CAST(json_extract_string(j, '$."F Stat."') AS DOUBLE), CAST(json_extract_string(j, '$."F Statistic"') AS DOUBLE)) AS f_stat,
  coalesce(CAST(json_extract_string(j, '$."Array Dim."') AS INT), CAST(json_extract_string(j, '$."Array Dimension"') AS INT)) AS array_dim FROM e""")
def json_dialect_coalesce(spark, d):
    """Two dialects of detection records read into one schema."""
    from sondera.sources.detections import parse_detection

    j = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"F Stat.": '), F.col("event_id"), F.lit(', "Array Dim.": 4}'))).otherwise(F.concat(F.lit('{"F Statistic": '), F.col("event_id"), F.lit(', "Array Dimension": 6}')))
    out = table(spark, d, "events").select("event_id", parse_detection(j).alias("x"))
    return out.select("event_id", "x.f_stat", "x.array_dim")


@query("json_props", "SELECT event_type, CAST(count(*) AS BIGINT) AS n, count(DISTINCT json_extract_string(props, '$.k')) AS kinds FROM events GROUP BY 1")
def json_props(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.get_json_object("props", "$.k")).alias("kinds"))


@query("point_in_time_join", f"""
WITH {_fk_sql(16)}, det AS (SELECT sta, t FROM fk)
SELECT det.sta, det.t, f, az FROM det JOIN fk USING (sta, t)""")
def point_in_time_join(spark, d):
    """Detections take the beam row of the same station and time."""
    rows = fk(spark, d, 16)
    return rows.select("sta", "t").join(rows, ["sta", "t"]).select("sta", "t", "f", "az")


@query("interval_join_argmax", """
WITH o AS (SELECT o_orderkey, o_custkey % 64 AS sta, epoch_us(o_orderdate) / 1e6 AS t, o_totalprice AS f FROM orders),
s AS (SELECT o_orderkey AS det, sta, t AS lo, t + 30 * 86400 AS hi FROM o),
j AS (SELECT s.sta, s.det, o.t, o.f, row_number() OVER (PARTITION BY s.det ORDER BY o.f DESC, o.t) AS rk FROM s JOIN o ON o.sta = s.sta AND o.t BETWEEN s.lo AND s.hi)
SELECT sta, det, t, f FROM j WHERE rk = 1""")
def interval_join_argmax(spark, d):
    """For each detection span the strongest beam row inside: an equi-join on buckets, of covered buckets with their best rows only."""
    o = table(spark, d, "orders").select((F.col("o_custkey") % 64).alias("sta"), (epoch("o_orderdate")).alias("t"), F.col("o_totalprice").alias("f"), F.col("o_orderkey").alias("key"))
    s = o.select("sta", F.col("key").alias("det"), F.col("t").alias("lo"), (F.col("t") + 30 * 86400).alias("hi"))
    out = relational.interval_argmax(o.drop("key"), s, ["sta"], "t", "lo", "hi", 30 * 86400.0, "det", "f")
    return out.select("sta", "det", "peak.t", "peak.f")


@query("four_way_lookup", """
SELECT l.l_orderkey, l.l_linenumber, o.o_custkey, s.s_name, n.n_name FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey
JOIN supplier s ON s.s_suppkey = l.l_suppkey JOIN nation n ON n.n_nationkey = s.s_nationkey WHERE l.l_quantity > 45""")
def four_way_lookup(spark, d):
    """Association, detection, beam and site rows brought together by key."""
    line = table(spark, d, "lineitem").where("l_quantity > 45").select("l_orderkey", "l_linenumber", "l_suppkey")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name", "s_nationkey")
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return line.join(o, "l_orderkey").join(s, "l_suppkey").join(n, "s_nationkey").select("l_orderkey", "l_linenumber", "o_custkey", "s_name", "n_name")


@query("union_by_table_name", """
WITH u AS (SELECT 'customer' AS table_name, c_custkey AS id, c_acctbal AS bal FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_acctbal FROM supplier),
r AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'customer' ELSE 'supplier' END AS table_name, user_id AS id FROM events)
SELECT event_id, r.table_name, bal FROM r JOIN u USING (table_name, id)""")
def union_by_table_name(spark, d):
    """Rows that name the table they refer to, joined to the union of those tables."""
    u = relational.union_by_table({
        "customer": table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("bal")),
        "supplier": table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("bal")),
    })
    r = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, "customer").otherwise("supplier").alias("table_name"), F.col("user_id").alias("id"))
    return r.join(u, ["table_name", "id"]).select("event_id", "table_name", "bal")


@query("pair_self_join", """
SELECT a.l_orderkey, a.l_linenumber AS ln_a, b.l_linenumber AS ln_b, round(abs(a.l_extendedprice - b.l_extendedprice), 2) AS dist
FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber""")
def pair_self_join(spark, d):
    x = relational.pairs_within(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber", ["l_extendedprice"])
    return x.select("l_orderkey", F.col("l_linenumber_a").alias("ln_a"), F.col("l_linenumber_b").alias("ln_b"), F.round(F.abs(F.col("l_extendedprice_a") - F.col("l_extendedprice_b")), 2).alias("dist"))


@query("triple_combinations", """
SELECT a.l_orderkey, a.l_linenumber AS i, b.l_linenumber AS j, c.l_linenumber AS k FROM lineitem a
JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber JOIN lineitem c ON a.l_orderkey = c.l_orderkey AND b.l_linenumber < c.l_linenumber""")
def triple_combinations(spark, d):
    """All triplets of an order's lines, made inside each row's sorted array: one shuffle instead of two joins."""
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_linenumber")).alias("a"))
    i = g.select("l_orderkey", "a", F.posexplode("a").alias("pi", "i"))
    j = i.select("*", F.posexplode("a").alias("pj", "j")).where("pj > pi")
    return j.select("l_orderkey", "i", "j", F.explode(F.slice("a", F.col("pj") + 2, F.size("a"))).alias("k")).where("k > j and j > i")


@query("mixture_sequences", """
WITH q AS (SELECT o_orderkey, unnest(range(0, 27)) AS k FROM orders)
SELECT o_orderkey, k, k % 3 AS a, (k // 3) % 3 AS b, k // 9 AS c FROM q""")
def mixture_sequences(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.posexplode(relational.mixture_sequences(3)).alias("k", "s"))
    return o.select("o_orderkey", F.col("k").cast("long").alias("k"), *[F.col("s")[i].cast("long").alias(c) for i, c in enumerate("abc")])


@query("asof_nearest", """
WITH a AS (SELECT event_id, user_id % 8 AS sta, epoch_us(ts) / 1e6 AS t FROM events WHERE event_id % 2 = 0),
b AS (SELECT event_id AS rid, user_id % 8 AS sta, epoch_us(ts) / 1e6 AS t FROM events WHERE event_id % 2 = 1 QUALIFY row_number() OVER (PARTITION BY sta, t ORDER BY event_id) = 1),
x AS (SELECT a.event_id, a.sta, a.t, p.t AS pt, p.rid AS pr FROM a ASOF LEFT JOIN b p ON a.sta = p.sta AND a.t >= p.t),
y AS (SELECT x.*, n.t AS nt, n.rid AS nr FROM x ASOF LEFT JOIN b n ON x.sta = n.sta AND x.t <= n.t)
SELECT event_id, CASE WHEN nt IS NULL OR t - pt <= nt - t THEN pr ELSE nr END AS near_rid FROM y""")
def asof_nearest(spark, d):
    """Each even event with the nearest odd one of its station."""
    e = table(spark, d, "events").select("event_id", (F.col("user_id") % 8).alias("sta"), (epoch("ts")).alias("t"))
    odd = e.where("event_id % 2 = 1").groupBy("sta", "t").agg(F.min("event_id").alias("rid"))
    return relational.asof_nearest(e.where("event_id % 2 = 0"), odd, ["sta"], "t", ["rid"]).select("event_id", "near_rid")


@query("anti_join_ingest", """
SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""")
def anti_join_ingest(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderstatus")
    return relational.anti_join_ingest(o.where("o_orderstatus = 'F'"), o, ["o_custkey"]).select("o_custkey")


@query("contains_join", """
SELECT p_partkey, r_name FROM part JOIN region ON contains(upper(p_type || p_name), substr(r_name, 1, 1))""")
def contains_join(spark, d):
    """Station name contained in a trace id; the name list is a fixed catalog of five rows."""
    p = table(spark, d, "part").select("p_partkey", F.upper(F.concat("p_type", "p_name")).alias("id"))
    r = table(spark, d, "region").select("r_name")
    return p.join(F.broadcast(r), F.col("id").contains(F.substring("r_name", 1, 1))).select("p_partkey", "r_name")


@query("hop_window_membership", """
WITH dt AS (SELECT o_orderkey, epoch_us(o_orderdate) / 1e6 AS t, min(epoch_us(o_orderdate) / 1e6) OVER () AS f FROM orders),
w AS (SELECT o_orderkey, unnest(range(CAST(greatest(ceil((t - (f - 2592000) - 3888000) / 1296000), 0) AS BIGINT), CAST(floor((t - (f - 2592000)) / 1296000) AS BIGINT) + 1)) AS win FROM dt)
SELECT win, count(*) AS n FROM w GROUP BY win""")
def hop_window_membership(spark, d):
    """Association windows of 1.5 P at half-P hops from P before the first detection; P is 30 days here."""
    from sondera.operators.windows import hop_windows

    o = table(spark, d, "orders").select("o_orderkey", (epoch("o_orderdate")).alias("t"))
    first = o.agg((F.min("t") - 2592000).alias("t0"))
    w = hop_windows(o.join(F.broadcast(first)), "t", "t0", 3888000.0, 1296000.0)
    return w.groupBy(F.round((F.col("win_start") - F.col("t0")) / 1296000).cast("long").alias("win")).agg(F.count(F.lit(1)).alias("n"))


@query("group_mean_location", """
SELECT n_regionkey AS refsta, count(*) AS n, round(avg((s_suppkey * 37) % 180 - 89.5), 6) AS lat, round(avg((s_suppkey * 73) % 360 - 179.5), 6) AS lon
FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1""")
def group_mean_location(spark, d):
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    lat, lon = (F.col("s_suppkey") * 37) % 180 - 89.5, (F.col("s_suppkey") * 73) % 360 - 179.5
    return s.groupBy(F.col("n_regionkey").alias("refsta")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(lat), 6).alias("lat"), F.round(F.avg(lon), 6).alias("lon"))


@query("argmax_payload", """
SELECT o_custkey, arg_max(o_orderkey, o_totalprice) AS o_orderkey, max(o_totalprice) AS peak FROM orders GROUP BY 1""")
def argmax_payload(spark, d):
    """Rows without a key or a price take no part, as in arg_max; of equal prices the smallest key stays."""
    known = F.col("o_orderkey").isNotNull() & F.col("o_totalprice").isNotNull()
    best = F.max_by("o_orderkey", F.when(known, F.struct("o_totalprice", -F.col("o_orderkey"))))
    return table(spark, d, "orders").groupBy("o_custkey").agg(best.alias("o_orderkey"), F.max("o_totalprice").alias("peak"))


@query("cluster_overlap_ratio", """
WITH m AS (SELECT DISTINCT l_suppkey AS c, l_partkey % 500 AS i FROM lineitem), s AS (SELECT c, count(*) AS n FROM m GROUP BY c),
p AS (SELECT a.c AS cluster_a, b.c AS cluster_b, count(*) AS shared FROM m a JOIN m b ON a.i = b.i AND a.c < b.c GROUP BY 1, 2)
SELECT cluster_a, cluster_b, shared, least(x.n, y.n) AS smaller FROM p JOIN s x ON x.c = cluster_a JOIN s y ON y.c = cluster_b WHERE shared > 0.5 * least(x.n, y.n)""")
def cluster_overlap_ratio(spark, d):
    """Clusters that share over half of the smaller one's members, the pair stage of merging."""
    m = table(spark, d, "lineitem").select("l_suppkey", (F.col("l_partkey") % 500).alias("member"))
    return relational.overlap_merge(m, "l_suppkey", "member")


@query("cluster_summary", """
WITH p AS (SELECT a.o_custkey % 500 AS k, abs(a.o_totalprice - b.o_totalprice) AS dist FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey)
SELECT k, count(*) AS pairs, round(avg(dist), 4) AS spacing, round(max(dist), 4) AS diameter FROM p GROUP BY k""")
def cluster_summary(spark, d):
    p = relational.pairs_within(table(spark, d, "orders"), "o_custkey", "o_orderkey", ["o_totalprice"])
    dist = F.abs(F.col("o_totalprice_a") - F.col("o_totalprice_b"))
    return p.groupBy((F.col("o_custkey") % 500).alias("k")).agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg(dist), 4).alias("spacing"), F.round(F.max(dist), 4).alias("diameter"))


@query("unique_locations", """
SELECT o_custkey % 100 AS ev, greatest(count(DISTINCT o_orderkey % 11), count(DISTINCT o_orderkey % 7)) AS n FROM orders GROUP BY 1""")
def unique_locations(spark, d):
    """Distinct stations of an event: the larger of distinct latitudes and longitudes."""
    n = F.greatest(F.count_distinct(F.col("o_orderkey") % 11), F.count_distinct(F.col("o_orderkey") % 7))
    return table(spark, d, "orders").groupBy((F.col("o_custkey") % 100).alias("ev")).agg(n.alias("n"))


@query("trim_statistic", """
SELECT l_orderkey, round(max(l_extendedprice) / median(l_extendedprice), 6) AS ratio FROM lineitem GROUP BY 1""")
def trim_statistic(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.round(F.max("l_extendedprice") / F.median("l_extendedprice"), 6).alias("ratio"))


@query("resume_point", "SELECT user_id, max(ts) AS last_ts, arg_max(event_id, ts) AS last_event FROM events GROUP BY 1")
def resume_point(spark, d):
    """Where a station's processing goes on: its last result."""
    return table(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("last_ts"), F.max_by("event_id", "ts").alias("last_event"))


@query("update_calibration", """
SELECT p_partkey, CASE WHEN p_brand LIKE '%3%' THEN round(p_retailprice * 0.5, 4) ELSE p_retailprice END AS p_retailprice FROM part""")
def update_calibration(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_retailprice")
    return relational.update_where(p, "p_retailprice", "*3*", "p_brand", F.round(F.col("p_retailprice") * 0.5, 4)).drop("p_brand")


@query("distinct_channels", "SELECT DISTINCT p_brand, p_size FROM part")
def distinct_channels(spark, d):
    return table(spark, d, "part").select("p_brand", "p_size").distinct()


@query("cluster_ordering", """
SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_custkey, o_orderkey) AS place FROM orders""")
def cluster_ordering(spark, d):
    w = Window.partitionBy("o_orderpriority").orderBy("o_custkey", "o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", F.row_number().over(w).cast("long").alias("place"))
