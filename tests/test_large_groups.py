"""Results that do not depend on how many rows a group holds, and on odd rows in it."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from sondera.operators import relational


def test_argmax_payload_leaves_out_rows_without_key_or_price(spark, tmp_path):
    import duckdb

    from sondera.plans import registry

    rows = [(1, 7, 5.0), (None, 7, 9.0), (2, 7, 3.0), (3, 8, None), (4, 8, None), (None, 9, 1.0), (5, 9, None)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    got = {tuple(r) for r in registry.QUERIES["argmax_payload"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    assert got == set(con.execute(registry.ORACLE_SQL["argmax_payload"]).fetchall()) == {(7, 1, 9.0), (8, None, None), (9, None, 1.0)}


def test_strongest_points_of_crowded_spans_without_pairs(spark):
    """Spans in one bucket, across buckets and over many, with equal times, values and nulls; no row is copied once per point of a span."""
    rng = random.Random(4)
    points = [(k, float(t), rng.choice([None, 1.0, 2.0, 7.0]), i) for i, (k, t) in enumerate(itertools.product((0, 1), [rng.choice([rng.uniform(0, 99), rng.randrange(99)]) for _ in range(200)]))]
    spans = [(rng.randrange(3), i, lo, lo + rng.choice([0.0, 0.5, 3.0, 20.0, 90.0, -1.0])) for i, lo in enumerate(float(rng.choice([rng.uniform(-9, 99), rng.randrange(99)])) for _ in range(300))]
    df = spark.createDataFrame(points, "k int, t double, v double, i int")
    sp = spark.createDataFrame(spans, "k int, s int, lo double, hi double")
    got = {r["s"]: (r["peak"]["v"], r["peak"]["t"]) for r in relational.interval_argmax(df, sp, ["k"], "t", "lo", "hi", 40.0, "s", "v").collect()}
    best = {s: min(((v is None, -(v or 0), t, v) for k2, t, v, _ in points if k2 == k and lo <= t <= hi), default=None) for k, s, lo, hi in spans}
    assert got == {s: (b[3], b[2]) for s, b in best.items() if b}

    n = 3000
    crowd = spark.range(n).select(F.lit(1).alias("k"), (F.col("id") / 1000.0).alias("t"), F.col("id").cast("double").alias("v"))
    every = spark.range(n).select(F.lit(1).alias("k"), F.col("id").alias("s"), (F.col("id") / 1000.0 - 1).alias("lo"), (F.col("id") / 1000.0).alias("hi"))
    out = relational.interval_argmax(crowd, every, ["k"], "t", "lo", "hi", 800.0, "s", "v")
    assert out.where("peak.v = s").count() == n
    assert _most_rows(out) < 100 * n


def _most_rows(df) -> int:
    """The most rows that one join of the executed plan put out."""
    df.collect()
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        plan = todo.pop()
        name = plan.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(plan.executedPlan())
        elif "QueryStage" in name:
            todo.append(plan.plan())
        elif "Join" in name and plan.metrics().contains("numOutputRows"):
            found.append(plan.metrics().apply("numOutputRows").value())
        children = plan.children()
        todo += [children.apply(i) for i in range(children.size())]
    return max(found, default=0)


def _overlaps(rows, ratio=0.5):
    sets = {}
    for c, m in rows:
        sets.setdefault(c, set()).add(m)
    out = set()
    for a, b in itertools.combinations(sorted(c for c in sets if c is not None), 2):
        shared, smaller = len((sets[a] & sets[b]) - {None}), min(len(sets[a]), len(sets[b]))
        if shared > ratio * smaller:
            out.add((a, b, shared, smaller))
    return out


@pytest.mark.parametrize("sizes", [{}, {"hot": 5, "block": 8}, {"hot": 20, "block": 16, "block_members": 100}, {"hot": 1, "block": 1000}])
def test_overlaps_of_hot_and_cold_members(spark, sizes):
    rng = random.Random(1)
    rows = [(c, rng.randrange(12 if c % 3 else 400)) for c in range(60) for _ in range(rng.randrange(1, 15))] + [(c, -c // 2) for c in range(60, 90)] + [(3, None), (None, 3), (4, None)]
    got = relational.overlap_merge(spark.createDataFrame(rows, "c long, m long"), "c", "m", **sizes).collect()
    assert len(got) == len({tuple(r) for r in got}) and {tuple(r) for r in got} == _overlaps(rows)


def test_clusters_of_hot_members_make_no_row_per_shared_member(spark):
    clusters, members = 300, 400
    df = spark.range(clusters * members).select((F.col("id") % clusters).alias("c"), F.floor(F.col("id") / clusters).alias("m"))
    out = relational.overlap_merge(df, "c", "m")
    assert out.agg(F.count(F.lit(1)), F.min("shared"), F.max("smaller")).first()[:] == (clusters * (clusters - 1) // 2, members, members)
    assert _most_rows(out) <= clusters * members


def test_shared_counts_of_rare_and_frequent_members():
    import numpy as np

    rng = np.random.default_rng(0)
    sets = [np.unique(np.r_[rng.integers(0, 30, 10), rng.integers(1000, 3000, 40)]) for _ in range(150)]
    want = [[len(np.intersect1d(x, y)) for y in sets[60:]] for x in sets[:60]]
    assert relational._shared_counts(sets[:60], sets[60:]).tolist() == want


def test_path_geometry_reads_rays_once_and_pools_their_moments(spark):
    import numpy as np

    from sondera.operators import propagation

    rng = np.random.default_rng(3)
    n = 4000
    rows = {"rng": np.round(rng.uniform(-20, 330, n) / 5) * 5.0, "rcel": rng.normal(3.6, 0.3, n), "az_dev": rng.normal(1, 2, n), "az_bin": rng.integers(0, 2, n)}
    rows = [(*[float(rows[c][i]) for c in ("rng", "rcel", "az_dev")], int(rows["az_bin"][i])) for i in range(n)]
    seen = spark.sparkContext.accumulator(0)

    def counted(found):
        for pdf in found:
            seen.add(len(pdf))
            yield pdf

    schema = "rng double, rcel double, az_dev double, az_bin int"
    model = propagation.path_geometry(spark.createDataFrame(rows, schema).mapInPandas(counted, schema), rng_max=300.0, least=5)
    out = {(r["az_bin"], r["rng"], r["comp"]): r for r in model.collect()}
    assert len(out) == 2 * 30 * 3 and seen.value == n
    x = np.array(rows)
    comp = np.digitize(x[:, 1], [(a + b) / 2 for a, b in itertools.pairwise(propagation.physics.RCEL_MEANS)])
    for (az, at, k), r in out.items():
        near = (x[:, 3] == az) & (np.abs(x[:, 0] - at) <= 20)
        own = x[near & (comp == k)]
        assert r["n"] == len(own)
        if len(own) >= 5:
            assert (r["mn"], r["sd"]) == pytest.approx((own[:, 1].mean(), max(own[:, 1].std(), 1e-3)), abs=1e-9)
            assert (r["az_mn"], r["az_sd"]) == pytest.approx((x[near][:, 2].mean(), max(x[near][:, 2].std(), 1e-3)), abs=1e-9)


def test_filter_reads_segments_three_times_and_takes_no_table_per_group(spark, monkeypatch):
    import numpy as np
    from pyspark.sql import GroupedData

    from sondera.functions import filters
    from sondera.operators import records

    def refused(*_):
        raise AssertionError("a table per group")

    monkeypatch.setattr(GroupedData, "applyInPandas", refused)
    rng = np.random.default_rng(0)
    whole = {c: rng.standard_normal(90) + 3 for c in "abc"}
    rows = [("x", c, 100.0 + i / 10, 10.0, 1.0, 0.0, 0.0, x[i : i + 9].tolist()) for c, x in whole.items() for i in range(0, 90, 9)]
    schema = "array_id string, channel string, t0 double, fs double, calib double, dx double, dy double, samples array<double>"
    seen = spark.sparkContext.accumulator(0)

    def counted(found):
        for pdf in found:
            seen.add(len(pdf))
            yield pdf

    out = records.filtered(spark.createDataFrame(rows, schema).mapInPandas(counted, schema), None, 1.5, order=2, block=3.0).collect()
    assert seen.value <= 3 * len(rows)
    system, k = filters.butterworth(10.0, None, 1.5, 2), np.arange(90)
    for c, x in whole.items():
        y = system.run(system.run(x - np.polyval(np.polyfit(k, x, 1), k))[0][::-1])[0][::-1]
        got = np.concatenate([r["samples"] for r in sorted((r for r in out if r["channel"] == c), key=lambda r: r["t0"])])
        assert got == pytest.approx(y, abs=1e-9)


def test_events_are_located_by_more_than_one_task(spark):
    from sondera.operators import location

    places = [(40.0, -112.0, 231.0), (36.0, -120.0, 62.0)]
    rows = [(e, la, lo, 1000.0 + 40_000.0 * e + 700 * k, az, 12.0, 4) for e in range(40) for k, (la, lo, az) in enumerate(places)]
    members = spark.createDataFrame(rows, "event_id long, lat double, lon double, t double, az double, f_stat double, channels int")
    out = location.refined_summary(location.event_region(location.event_rows(members)), levels=0).select("event_id", F.spark_partition_id().alias("p")).collect()
    assert len({r["p"] for r in out}) > 1


def test_celerities_of_a_location_are_those_of_the_mixture():
    import numpy as np

    from sondera.functions import geodesy, physics, posterior

    mixture = (physics.RCEL_WEIGHTS, physics.RCEL_MEANS, physics.RCEL_SDS)
    dets = {c: np.array(v) for c, v in {"lat": [40.0, 36.0], "lon": [-112.0, -120.0], "t": [1500.0, np.nan], "az": [np.nan, 60.0], "kappa": [30.0, 30.0]}.items()}
    t, at = np.linspace(-3000, 3000, 20_000), np.zeros(20_000, int)
    lat, lon = np.array([38.0]), np.array([-115.0])
    got = posterior.density(dets, lat, lon, at, t, mixture, geodesy.SPHERE_KM)
    km = posterior._azimuth_and_km(40.0, -112.0, lat, lon, geodesy.SPHERE_KM)[1]
    u = (1500.0 - t) / km
    want = sum(w / (s * np.sqrt(2 * np.pi)) * np.exp(-0.5 * ((u - m) / s) ** 2) for w, m, s in zip(*mixture, strict=True))
    assert got / got.max() == pytest.approx(want / want.max(), abs=1e-9) and got.min() >= 0


def test_pairs_and_clusters_are_dealt_to_more_than_one_task(spark):
    from sondera.operators import association

    places = [(40.0, -112.0, 215.0), (36.0, -120.0, 60.0), (35.0, -110.0, 310.0)]
    rows = [(3 * e + k, la, lo, 1000.0 + 40_000.0 * e + 300 * k, az, 12.0, 4) for e in range(30) for k, (la, lo, az) in enumerate(places)]
    dets = spark.createDataFrame(rows, "id long, lat double, lon double, t double, az double, f_stat double, channels int")
    pairs = association.pair_likelihoods(dets, rng_max=1200.0)
    assert len({r["p"] for r in pairs.select(F.spark_partition_id().alias("p")).collect()}) > 1
    near = spark.createDataFrame([(3 * e + i, 3 * e + j, 1.0) for e in range(30) for i, j in ((0, 1), (0, 2), (1, 2))], "id_a long, id_b long, dist double")
    found = association.cluster_windows(association.assign_windows(dets, 1200.0).select("win", "id"), near)
    assert len({r["p"] for r in found.select(F.spark_partition_id().alias("p")).collect()}) > 1
