"""Association: pair likelihoods on polar grids, hierarchical clusters per window, events.

Pairs are made once per pair of detections that share a window, not once per
window, and their discs are worked out as columns. Two steps are numpy: the
integral over a disc, in Arrow batches of pairs, and the clustering of a
component of up to ``LARGE`` detections; larger ones merge in rounds. New
detections can be added batch by batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sondera.catalog import durable, spread, stored
from sondera.functions import circular, geodesy, numeric, physics
from sondera.operators import windows

SMALLEST = 2.0**-53


def assign_windows(dets: DataFrame, rng_max: float = 2000.0, origin: float | None = None) -> DataFrame:
    """Detections with win: hop windows 1.5 P long at half-P hops, from P before the first detection (or from ``origin``); P is the
    travel time of rng_max."""
    p = int(rng_max / 0.22)
    first = dets.agg((F.min("t") - p).alias("t0"))
    placed = dets.crossJoin(F.broadcast(first)) if origin is None else dets.withColumn("t0", F.lit(float(origin)))
    dealt = windows.hop_windows(placed, "t", "t0", 1.5 * p, float(int(p * 0.5)))
    return dealt.withColumn("win", F.round((F.col("win_start") - F.col("t0")) / int(p * 0.5)).cast("long")).drop("win_start", "t0")


#: Lines of two beams that are crossed, by their place in the vectors of ``with_beams``: 1 centre, 2 and 3 the edges.
_CROSSINGS = ((1, 1), (1, 2), (1, 3), (2, 1), (3, 1), (2, 2), (3, 3), (2, 3), (3, 2))


def with_beams(dets: DataFrame, width: float, rng_max: float) -> DataFrame:
    """Detections with v: unit vectors of the place and of the ends of its beam's centre and edge lines; once per detection."""
    return dets.withColumn("v", geodesy.beam_vectors("lat", "lon", "az", rng_max / 6370.0 * 180 / np.pi, (0.0, width, -width)))


def pair_region(a: Column, b: Column, width: float, rad_min: float, rad_max: float) -> Column:
    """STRUCT(lat, lon, radius) of where two beams may meet, null if they do not.

    Nine arc crossings of the beams' centre and edge lines; the centre is the
    mean of the first five. If each array is in the other's beam the disc lies
    between them, if one is, it reaches to the nearer array, else its radius is
    the mean distance of the edge crossings; within rad_min..rad_max and not over an array.
    """
    here = {k: (d["lat"], d["lon"]) for k, d in (("a", a), ("b", b))}
    order = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in _CROSSINGS])
    meets = F.transform(order, lambda k: geodesy.arc_crossing(a["v"][0], a["v"][k["i"]], b["v"][0], b["v"][k["j"]]))

    def shaped(points: Column) -> Column:
        main = F.filter(F.slice(points, 1, 5), lambda x: x.isNotNull())
        total = lambda f: F.aggregate(main, F.lit(0.0), lambda s, x: s + f(x))
        lat, lon, _ = geodesy.from_xyz(*[total(lambda x, i=i: geodesy.to_xyz(x["lat"], x["lon"])[i]) for i in range(3)])
        return F.when(F.size(main) > 0, F.struct(lat.alias("lat"), lon.alias("lon"), F.filter(F.slice(points, 2, 8), lambda x: x.isNotNull()).alias("edges")))

    def sized(c: Column) -> Column:
        km = lambda p, q: F.radians(geodesy.haversine(p[0], p[1], q[0], q[1])) * geodesy.SPHERE_KM
        dist, az_ab, az_ba = geodesy.spherical_inv(*here["a"], *here["b"])
        in_a, in_b = F.abs(geodesy.azdiff(az_ab, a["az"])) < width, F.abs(geodesy.azdiff(az_ba, b["az"])) < width
        between = geodesy.spherical_fwd(*here["a"], dist / 2, az_ab)
        both = in_a & in_b
        lat, lon = F.when(both, between[0]).otherwise(c["lat"]), F.when(both, between[1]).otherwise(c["lon"])
        near = F.least(km((lat, lon), here["a"]), km((lat, lon), here["b"])) - 0.01
        edges = F.aggregate(c["edges"], F.lit(0.0), lambda s, x: s + km((c["lat"], c["lon"]), (x["lat"], x["lon"]))) / F.greatest(F.size(c["edges"]), F.lit(1))
        free = F.least(F.greatest(edges, F.lit(rad_min)), F.lit(rad_max), near)
        radius = F.when(both, F.radians(dist) * geodesy.SPHERE_KM / 2 - 0.1).when(in_a | in_b, near).otherwise(free)
        return F.struct(lat.alias("lat"), lon.alias("lon"), F.least(radius, F.lit(rad_max)).alias("radius"))

    def moved(c: Column) -> Column:
        """A disc that is too small is moved off the nearer array and set to rad_min."""
        da, db = (geodesy.haversine(*here[k], c["lat"], c["lon"]) for k in "ab")
        shift = lambda k: geodesy.spherical_fwd(*here[k], np.degrees(rad_min / geodesy.SPHERE_KM), geodesy.spherical_inv(*here[k], c["lat"], c["lon"])[1])
        sa, sb = shift("a"), shift("b")
        new = F.struct(F.when(da < db, sa[0]).otherwise(sb[0]).alias("lat"), F.when(da < db, sa[1]).otherwise(sb[1]).alias("lon"), F.lit(rad_min).alias("radius"))
        return F.when(c["radius"] < rad_min, new).otherwise(c)

    let = geodesy._let
    return let(let(let(meets, shaped), sized), moved)


def pair_likelihoods(dets: DataFrame, width: float = 10.0, rng_max: float = 2000.0, rad_min: float = 100.0, rad_max: float | None = None, tolerance: float = 1e-4, origin: float | None = None, known: DataFrame | None = None) -> DataFrame:
    """id_a < id_b, likelihood, error of every pair of detections that share an association window.

    The joint density (two von Mises factors and the closed-form time marginal)
    is integrated over the pair's disc, a batch of pairs at a time; error is the bound of its relative error, at most ``tolerance``
    where the rounds of dividing suffice. Pairs of one array go over azimuth and range from it. Beams that do not meet give SMALLEST.
    With ``known`` detections, only pairs with at least one of ``dets`` are made. A pair is made in the first window that both are in.
    """
    rad_max = rng_max / 4 if rad_max is None else rad_max
    det = F.struct("lat", "lon", "t", "az", "f_stat", "channels", "v")

    def placed(d: DataFrame) -> DataFrame:
        w = assign_windows(with_beams(d, width, rng_max), rng_max, origin).select("win", "id", det.alias("d"))
        first = F.min("win").over(Window.partitionBy("id"))  # windows of a detection are a few, one after the other
        return w.withColumn("w0", first)

    new = placed(dets)
    both = new.select("win", F.col("id").alias("id_a"), F.col("d").alias("a"), F.col("w0").alias("wa"))
    pairs = both.join(new.select("win", F.col("id").alias("id_b"), F.col("d").alias("b"), F.col("w0").alias("wb")), "win").where("id_a < id_b")
    if known is not None:
        old = placed(known).select("win", F.col("id").alias("id_b"), F.col("d").alias("b"), F.col("w0").alias("wb"))
        mixed = both.join(old, "win").where("id_a != id_b")
        turned = [F.when(F.col("id_a") < F.col("id_b"), F.col(f"{c}{x}")).otherwise(F.col(f"{c}{y}")).alias(f"{c}{x}") for c in ("id_", "", "w") for x, y in ("ab", "ba")]
        pairs = pairs.unionByName(mixed.select("win", *turned))
    pairs = pairs.where(F.col("win") == F.greatest("wa", "wb")).drop("win", "wa", "wb")
    near = F.radians(geodesy.haversine(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon"))) * geodesy.SPHERE_KM < 1.0
    region = F.when(near, F.struct(F.col("a.lat").alias("lat"), F.col("a.lon").alias("lon"), F.lit(float(rng_max)).alias("radius"))).otherwise(pair_region(F.col("a"), F.col("b"), width, rad_min, rad_max))
    apart = F.abs(geodesy.azdiff(F.col("a.az"), F.col("b.az"))) > 2 * width
    pairs = pairs.withColumns({"near": near, "r": F.when(~(near & apart), region), "ka": circular.von_mises_kappa("a.f_stat", "a.channels"), "kb": circular.von_mises_kappa("b.f_stat", "b.channels")})

    mixture = (physics.RCEL_WEIGHTS, physics.RCEL_MEANS, physics.RCEL_SDS)
    names = ("lat", "lon", "az", "t")
    flat = [F.col(f"{d}.{n}").alias(f"{d}_{n}") for d in "ab" for n in names]
    rows = pairs.select("id_a", "id_b", "near", *flat, F.col("ka").alias("a_kappa"), F.col("kb").alias("b_kappa"), F.col("r.lat").alias("r_lat"), F.col("r.lon").alias("r_lon"), F.col("r.radius").alias("r_radius"))

    def batches(found: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in found:
            for lo in range(0, len(pdf), 256):  # a few MB of panels at a time
                part = pdf.iloc[lo : lo + 256]
                side = lambda d, ns: {n: part[f"{d}_{n}"].to_numpy(float) for n in ns}  # noqa: B023, E731
                value, error = numeric.disc_integrals(side("a", (*names, "kappa")), side("b", (*names, "kappa")), side("r", ("lat", "lon", "radius")), part["near"].to_numpy(bool), geodesy.SPHERE_KM, mixture, tolerance)
                value = np.where(np.isfinite(value), value / (np.pi * rng_max), SMALLEST)
                yield pd.DataFrame({"id_a": part["id_a"], "id_b": part["id_b"], "likelihood": np.maximum(value, SMALLEST), "error": np.nan_to_num(error)})

    kind = dets.schema["id"].dataType.simpleString()
    return spread(rows).mapInPandas(batches, f"id_a {kind}, id_b {kind}, likelihood double, error double")


def distances(pairs: DataFrame, most: float = 8.0) -> DataFrame:
    """id_a, id_b, dist = -log10 of the likelihood, at most ``most``."""
    return pairs.withColumn("dist", F.least(-F.log10(F.greatest("likelihood", F.lit(SMALLEST))), F.lit(most)))


def merged_clusters(pairs: DataFrame, cut: float, linkage: str = "weighted", most: float = 8.0) -> DataFrame:
    """node, cluster (its least node): hierarchical clusters of any size, cut at a distance, of pairs (u < v, d); pairs that are not
    there are ``most`` apart, nodes without pairs are left out.

    All linkages here are reducible, so all pairs that are each other's nearest may merge at once: a round finds every node's nearest,
    merges the mutual ones below the cut, and works out the distances of what has merged from those of its parts. Rounds are joins and
    sums over the table of distances, each written; no task holds a matrix.
    """
    if linkage not in ("single", "complete", "average", "weighted"):
        raise ValueError(f"no linkage {linkage}")
    edges = pairs.select(F.col("u").alias("u"), F.col("v").alias("v"), F.col("d").cast("double").alias("d"), F.lit(1.0).alias("su"), F.lit(1.0).alias("sv"))
    edges = stored(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "d", "su", "sv")))
    nodes, merges = edges.select(F.col("u").alias("node")).distinct(), []
    while True:
        near = edges.groupBy("u").agg(F.min(F.struct("d", F.least("u", "v").alias("lo"), F.greatest("u", "v").alias("hi"))).alias("n")).select("u", "n.*")
        mutual = near.where("u = lo").select("lo", "hi", "d").join(near.where("u = hi").select("lo", "hi"), ["lo", "hi"]).where(F.col("d") <= cut)
        merge = stored(mutual.select(F.col("hi").alias("gone"), F.col("lo").alias("into")))
        if merge.isEmpty():
            break
        merges.append(merge)
        parts = merge.select(F.col("gone").alias("node"), F.col("into").alias("to")).unionByName(merge.select(F.col("into").alias("node"), F.col("into").alias("to")))
        moved = edges
        for c in "uv":
            moved = moved.join(parts.select(F.col("node").alias(c), F.col("to").alias(f"{c}2")), c, "left")
        both = moved.select(F.coalesce("u2", "u").alias("u"), F.coalesce("v2", "v").alias("v"), "d", "su", "sv", *[F.when(F.col(f"{c}2").isNull(), 1).otherwise(2).alias(f"k{c}") for c in "uv"]).where("u != v")
        # a merged node's size is that of its parts, of which each has an edge to the other
        sizes = edges.join(merge, (F.col("u") == F.col("gone")) & (F.col("v") == F.col("into"))).select(F.col("into").alias("to"), (F.col("su") + F.col("sv")).alias("size"))
        own = F.col("ku") * F.col("kv")
        there = F.count(F.lit(1))
        d = {
            "single": F.min("d"),
            "complete": F.when(there == F.first(own), F.max("d")).otherwise(float(most)),
            "weighted": (F.sum("d") + most * (F.first(own) - there)) / F.first(own),
            "average": F.sum(F.col("d") * F.col("su") * F.col("sv")),
        }[linkage]
        summed = both.groupBy("u", "v").agg(d.alias("d"), F.sum(F.col("su") * F.col("sv")).alias("seen"), F.first("ku").alias("ku"), F.first("kv").alias("kv"), F.first("su").alias("su"), F.first("sv").alias("sv"))
        for c in "uv":
            summed = summed.join(sizes.select(F.col("to").alias(c), F.col("size").alias(f"{c}3")), c, "left").withColumn(f"s{c}", F.when(F.col(f"k{c}") == 2, F.col(f"{c}3")).otherwise(F.col(f"s{c}")))
        if linkage == "average":
            whole = F.col("su") * F.col("sv")
            summed = summed.withColumn("d", (F.col("d") + most * (whole - F.col("seen"))) / whole)
        edges = stored(summed.select("u", "v", "d", "su", "sv"))
    from sondera.operators.relational import components

    if not merges:
        return nodes.withColumn("cluster", F.col("node"))
    found = components(reduce(DataFrame.unionByName, merges), "gone", "into")  # the node that stays is the smaller one
    return nodes.join(found, "node", "left").select("node", F.coalesce("label", "node").alias("cluster"))


#: Members of a component that one task clusters; larger ones are merged in rounds first.
LARGE = 2000


def cluster_windows(members: DataFrame, dist: DataFrame, cut: float = 5.0, linkage: str = "weighted", trim: float = 3.8, most: float = 8.0, min_size: int = 3, large: int = LARGE) -> DataFrame:
    """win, cluster, id, quality: hierarchical clusters of each window's detections, with 10 ** -(mean distance) as quality; ``min_size`` is two or more.

    No linkage is below the least distance of two clusters' members, so clusters below the cut never leave a connected component
    of the pairs below it. Windows are divided into these components, and a task holds the distances of one. A component above
    ``large`` members is first divided into its clusters by ``merged_clusters``, which are then trimmed each for itself.
    """
    from sondera.operators.relational import components

    a = members.select("win", F.col("id").alias("id_a"))
    inside = durable(a.join(dist, "id_a").join(members.select("win", F.col("id").alias("id_b")), ["win", "id_b"]))
    node = lambda c: F.struct(F.col("win").alias("win"), F.col(c).alias("id"))
    part = components(inside.where(F.col("dist") <= cut).select(node("id_a").alias("u"), node("id_b").alias("v")), "u", "v")
    part = part.select("node.win", F.col("node.id").alias("id"), F.xxhash64("label").alias("label"))
    inside = inside.join(part.select("win", F.col("id").alias("id_a"), "label"), ["win", "id_a"]).join(part.select("win", F.col("id").alias("id_b"), F.col("label").alias("other")), ["win", "id_b"]).where("label = other").drop("other")
    many = part.groupBy("label").count().where(F.col("count") > large).select("label")
    if not many.isEmpty():
        inside = durable(inside)
        wide = inside.join(many, "label")
        name = lambda c: F.xxhash64("win", c)
        found = merged_clusters(wide.select(F.least(name("id_a"), name("id_b")).alias("u"), F.greatest(name("id_a"), name("id_b")).alias("v"), F.col("dist").alias("d")), cut, linkage, most)
        for c in ("id_a", "id_b"):
            wide = wide.withColumn("node", name(c)).join(found.withColumnRenamed("cluster", f"of_{c}"), "node").drop("node")
        wide = wide.where("of_id_a = of_id_b").withColumn("label", F.col("of_id_a")).select(inside.columns)
        inside = inside.join(many, "label", "left_anti").select(inside.columns).unionByName(wide)

    def of_window(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(np.r_[pdf["id_a"], pdf["id_b"]])
        d = np.full((len(ids), len(ids)), most)
        np.fill_diagonal(d, 0)
        i, j = np.searchsorted(ids, pdf["id_a"]), np.searchsorted(ids, pdf["id_b"])
        d[i, j] = d[j, i] = pdf["dist"]
        labels = numeric.trimmed_clusters(d, cut, linkage, trim, min_size)
        out = []
        for k in np.unique(labels):
            own = np.flatnonzero(labels == k)
            if len(own) >= min_size:
                q = 10 ** -d[np.ix_(own, own)][np.triu_indices(len(own), 1)].mean()
                out += [(pdf["win"].iloc[0], str(ids[own].min()), ids[x], q) for x in own]
        return pd.DataFrame(out, columns=["win", "cluster", "id", "quality"])

    return spread(inside.select("win", "label", "id_a", "id_b", "dist"), "win", "label").groupBy("win", "label").applyInPandas(of_window, f"win long, cluster string, id {members.schema['id'].dataType.simpleString()}, quality double")


def events(dets: DataFrame, clusters: DataFrame, min_stations: int = 2, overlap: float = 0.5) -> DataFrame:
    """event_id, id, quality: clusters of neighbouring windows that share over half of the smaller one's members are one event.

    Merging is by connected overlaps, so it does not depend on order; events need
    ``min_stations`` distinct positions.
    """
    from sondera.operators.relational import components, overlap_merge

    c = clusters.withColumn("c", F.xxhash64("win", "cluster"))
    links = overlap_merge(c, "c", "id", overlap)
    merged = components(links, "cluster_a", "cluster_b")
    labels = c.select("c").distinct().join(merged, F.col("c") == F.col("node"), "left").select("c", F.coalesce("label", "c").alias("label"))
    grouped = c.join(labels, "c").groupBy(F.col("label").alias("event_id"), "id").agg(F.max("quality").alias("quality"))
    spread = grouped.join(dets.select("id", "lat", "lon"), "id").groupBy("event_id").agg(F.greatest(F.count_distinct("lat"), F.count_distinct("lon")).alias("n"))
    return grouped.join(spread.where(F.col("n") >= min_stations).select("event_id"), "event_id")


def run_assoc(dets: DataFrame, width: float = 10.0, rng_max: float = 2000.0, most: float = 8.0, cut: float = 5.0, linkage: str = "weighted", trim: float = 3.8, min_size: int = 3, min_stations: int = 2, origin: float | None = None) -> DataFrame:
    """Events of detections (id, lat, lon, t, az, f_stat, channels)."""
    dist = durable(distances(pair_likelihoods(dets, width, rng_max, origin=origin), most))
    clusters = cluster_windows(assign_windows(dets, rng_max, origin).select("win", "id"), dist, cut, linkage, trim, most, min_size)
    return events(dets, durable(clusters), min_stations)


_STATE = {"detections": "id {id}, lat double, lon double, t double, az double, f_stat double, channels int", "pairs": "id_a {id}, id_b {id}, dist double", "clusters": "win long, cluster string, id {id}, quality double", "events": "event_id long, id {id}, quality double"}


def run_assoc_batch(spark: SparkSession, dets: DataFrame, folder: str, batch: int, origin: float, width: float = 10.0, rng_max: float = 2000.0, most: float = 8.0, cut: float = 5.0, linkage: str = "weighted", trim: float = 3.8, min_size: int = 3, min_stations: int = 2) -> DataFrame:
    """Events (event_id, id, quality) of all detections so far, after batch number ``batch`` (0, 1, ...) of new ones.

    ``folder`` keeps, batch by batch, detections, pairs' distances, clusters and events; nothing is overwritten, and a batch that is
    there already is read, not made, so a run that broke off goes on where it stopped. Only new detections meet their neighbours: pairs
    are made for them alone, and only windows that hold one are clustered again (a window's clusters are those of its last batch).
    Windows begin at ``origin``, so that all batches share them; given that, any division into batches ends in the same events.
    An event keeps its number: a new event takes that of the old event it shares most members with, if no other shares more; the rest
    are numbered on from the largest, by time of their first detection.
    """
    kind = dets.schema["id"].dataType.simpleString()

    def stored(name: str, upto: int) -> DataFrame:
        paths = [f"{folder}/{name}/batch={k}" for k in range(upto)]
        schema = _STATE[name].format(id=kind)
        parts = [spark.read.schema(schema).parquet(p).withColumn("batch", F.lit(k)) for k, p in enumerate(paths)]
        return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], f"{schema}, batch int")

    def keep(name: str, df: DataFrame) -> DataFrame:
        path, schema = f"{folder}/{name}/batch={batch}", _STATE[name].format(id=kind)
        done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
            df.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in schema.split(", ")]).write.mode("overwrite").parquet(path)
        return spark.read.schema(schema).parquet(path)

    columns = [c.split()[0] for c in _STATE["detections"].split(", ")]
    known = stored("detections", batch).drop("batch")
    new = keep("detections", dets.select(columns).join(known.select("id"), "id", "left_anti").dropDuplicates(["id"]))
    reach = 3 * int(rng_max / 0.22)  # two windows
    ends = new.agg(F.min("t").alias("a"), F.max("t").alias("b")).first()
    around = known.where(F.lit(False)) if ends["a"] is None else known.where(F.col("t").between(ends["a"] - reach, ends["b"] + reach))
    pairs = keep("pairs", distances(pair_likelihoods(new, width, rng_max, origin=origin, known=around), most))
    windows_of = lambda d: assign_windows(d, rng_max, origin).select("win", "id")
    touched = windows_of(new).select("win").distinct()
    members = durable(windows_of(around.unionByName(new)).join(touched, "win"))
    dist = stored("pairs", batch).drop("batch").unionByName(pairs)
    made = keep("clusters", cluster_windows(members, dist, cut, linkage, trim, most, min_size))
    every = stored("clusters", batch).unionByName(made.withColumn("batch", F.lit(batch)))
    last = members.select("win").distinct().withColumn("last", F.lit(batch))
    for k in range(batch):
        older = windows_of(spark.read.schema(_STATE["detections"].format(id=kind)).parquet(f"{folder}/detections/batch={k}"))
        last = last.unionByName(older.select("win").distinct().withColumn("last", F.lit(k)))
    last = last.groupBy("win").agg(F.max("last").alias("last"))
    clusters = durable(every.join(last, "win").where("batch = last").drop("batch", "last"))
    dets_all = known.unionByName(new)
    found = durable(events(dets_all, clusters, min_stations).withColumnRenamed("event_id", "label"))
    old = stored("events", batch).where(F.col("batch") == batch - 1).select("event_id", "id")
    return keep("events", _numbered(found, old, dets_all))


def _numbered(found: DataFrame, old: DataFrame, dets: DataFrame) -> DataFrame:
    """Events ``found`` (label, id, quality) with the numbers of the ``old`` ones (event_id, id) they go on from."""
    shared = found.join(old, "id").groupBy("label", "event_id").agg(F.count(F.lit(1)).alias("n"))
    best = lambda a, b: F.row_number().over(Window.partitionBy(a).orderBy(F.desc("n"), b))
    kept = shared.withColumns({"x": best("label", "event_id"), "y": best("event_id", "label")}).where("x = 1 AND y = 1").select("label", "event_id")
    top = old.agg(F.coalesce(F.max("event_id"), F.lit(0)).alias("top"))
    firsts = found.join(dets.select("id", "t"), "id").groupBy("label").agg(F.min("t").alias("t"), F.min("id").alias("first"))
    fresh = firsts.join(kept, "label", "left_anti").withColumn("n", F.row_number().over(Window.orderBy("t", "first")))  # one row per new event
    fresh = fresh.crossJoin(F.broadcast(top)).select("label", (F.col("top") + F.col("n")).alias("event_id"))
    return found.join(kept.unionByName(fresh), "label").select("event_id", "id", "quality")
