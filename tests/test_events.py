"""Association, location, propagation, yield and network operators on synthetic events."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sondera.operators import association, likelihood, location, propagation, yields

R = 6370.997
STATIONS = [(40.0, -112.0), (35.0, -110.0), (36.0, -120.0), (42.0, -118.0)]


def arc(a, b):
    la, lo, lb, mo = map(np.radians, (*a, *b))
    h = np.sin((lb - la) / 2) ** 2 + np.cos(la) * np.cos(lb) * np.sin((mo - lo) / 2) ** 2
    az = np.degrees(np.arctan2(np.sin(mo - lo) * np.cos(lb), np.cos(la) * np.sin(lb) - np.sin(la) * np.cos(lb) * np.cos(mo - lo)))
    return 2 * R * np.arctan2(np.sqrt(h), np.sqrt(1 - h)), az


def seen(source, t0, first_id, stations, celerity=0.29):
    rows = []
    for k, s in enumerate(stations):
        km, az = arc(s, source)
        rows.append((first_id + k, float(s[0]), float(s[1]), float(t0 + km / celerity), float(az), 12.0, 4))
    return rows


DETS = "id long, lat double, lon double, t double, az double, f_stat double, channels int"


def test_two_events_and_clutter_are_told_apart(spark):
    rows = seen((38.0, -115.0), 10_000.0, 1, STATIONS) + seen((39.5, -116.5), 16_000.0, 11, STATIONS[:3])
    rows += [(90 + k, *map(float, STATIONS[k % 4]), 12_000.0 + 700 * k, float(40 * k), 8.0, 4) for k in range(4)]
    dets = spark.createDataFrame(rows, DETS)
    found = association.run_assoc(dets, rng_max=1500.0).toPandas()
    groups = {frozenset(g["id"]) for _, g in found.groupby("event_id")}
    assert any({1, 2, 3, 4} <= g and not g & {11, 12, 13} for g in groups)
    assert any({11, 12, 13} <= g and not g & {1, 2, 3, 4} for g in groups)


def test_pair_likelihood_converges_and_prefers_true_pairs(spark):
    dets = spark.createDataFrame(seen((38.0, -115.0), 0.0, 1, STATIONS) + [(9, 40.0, -112.0, 4000.0, 20.0, 12.0, 4)], DETS)
    few, many = (association.pair_likelihoods(dets, rng_max=1500.0, tolerance=e).toPandas().set_index(["id_a", "id_b"])["likelihood"] for e in (1e-3, 1e-7))
    assert len(few) == 10 and many[1, 2] == pytest.approx(few[1, 2], rel=1e-3)
    assert few[2, 3] > 100 * few[2, 9]


def test_time_marginal_is_the_integral_over_origin_time(spark):
    km1, km2, t1, t2 = 300.0, 500.0, 1000.0, 1700.0
    t0 = np.arange(-1500.0, 900.0, 0.5)
    wts, mns, sds = np.array([0.0539, 0.0899, 0.8562]), 1 / np.array([0.327, 0.293, 0.26]), np.array([0.066, 0.08, 0.33])
    pdf = lambda t, km: sum(w * np.exp(-0.5 * (((t - t0) / km - m) / s) ** 2) / (s * np.sqrt(2 * np.pi)) for w, m, s in zip(wts, mns, sds)) / km
    expected = (pdf(t1, km1) * pdf(t2, km2)).sum() * 0.5
    got = spark.range(1).select(likelihood.pair_time_marginal(*[F.lit(x) for x in (t1, t2, km1, km2)])).first()[0]
    assert got == pytest.approx(expected, rel=1e-3)


def test_location_contains_the_source(spark):
    rows = [(7, *r[1:]) for r in seen((38.0, -115.0), 50_000.0, 1, STATIONS, 0.26)]
    members = spark.createDataFrame(rows, "event_id long, lat double, lon double, t double, az double, f_stat double, channels int")
    cells = location.posterior(location.event_region(location.event_rows(members)), 21, 21)
    row = location.summary(cells).first()
    km, _ = arc((row["lat_mean"], row["lon_mean"]), (38.0, -115.0))
    assert km < 2.5 * np.hypot(row["sd_x"], row["sd_y"]) and row["mass"] > 0
    assert abs(row["t_mean"] - 50_000) < 4 * row["sd_t"]
    bounds = location.time_bounds(cells).first()
    assert bounds["lo"] <= row["t_mean"] <= bounds["hi"] and bounds["mass"] >= 0.9
    one = location.summary(cells)
    assert location.ellipse(one).count() == 73 and "latitude" in location.summary_text(one).first()["text"]


def test_path_geometry_fills_thin_bins(spark):
    rng = np.random.default_rng(0)
    rows = [(float(r), 3.85 + 0.1 * float(e), float(a), 0) for r, e, a in zip(rng.uniform(50, 300, 6000), rng.standard_normal(6000), rng.normal(1.0, 2.0, 6000))]
    rays = spark.createDataFrame(rows, "rng double, rcel double, az_dev double, az_bin int")
    model = propagation.path_geometry(rays, rng_max=500.0)
    out = model.toPandas()
    assert len(out) == 150 and np.allclose(out.groupby("rng")["wt"].sum(), 1)
    dense = out[(out["rng"] == 200) & (out["comp"] == 2)].iloc[0]
    assert dense["mn"] == pytest.approx(3.85, abs=0.03) and dense["wt"] > 0.8
    far = out[(out["rng"] == 500) & (out["comp"] == 2)].iloc[0]
    assert dense["mn"] > far["mn"] - 0.1 and far["n"] == 0
    points = spark.createDataFrame([(180.0, 205.0, 3.85), (180.0, 900.0, 3.85)], "az double, rng double, rcel double")
    assert all(r["pdf"] > 0.5 for r in propagation.evaluate(points, model).collect())


def test_bounces_and_sectors(spark):
    rays = spark.createDataFrame([(100.0, -20.0, 44.0)], "rng double, loss double, az double")
    assert sorted(r["rng"] for r in propagation.bounces(rays, 5, 350.0, -3.0).collect()) == [100.0, 200.0, 300.0]
    assert sorted(r["az_bin"] for r in propagation.sectors(rays).collect()) == [5]
    assert propagation.loss_histogram(propagation.sectors(rays)).agg(F.sum("p")).first()[0] == pytest.approx(1.0)


def test_yield_posterior_peaks_at_the_true_yield(spark):
    from sondera.functions import physics

    f = [0.25, 0.35, 0.5, 0.7, 1.0]
    level = physics.decibel(physics.blast_spectrum("f", F.lit(2 * 50_000.0), F.lit(1.0))) * 2
    df = spark.createDataFrame([(1, s, x, km) for s, km in (("a", 200.0), ("b", 400.0)) for x in f], "event_id int, station string, f double, km double")
    loss = 20 * F.log10(F.pow("km", F.lit(-0.835))) - 3.0
    grid = yields.yield_posterior(df.withColumn("db", level + loss))
    row = yields.yield_summary(grid).first()
    assert row["lo95"] <= row["lo68"] <= row["hi68"] <= row["hi95"] and row["lo95"] < 50 < row["hi95"]


def test_network_probability(spark):
    s = spark.createDataFrame([(1, 0.0, 0.0)], "source_id int, s_lat double, s_lon double")
    a = spark.createDataFrame([(0.0, 1.0), (0.0, 2.0), (0.0, 3.0)], "a_lat double, a_lon double")
    p = yields.detection_probability(s, a, F.lit(0.5), 2).first()["p"]
    assert p == pytest.approx(0.5)
    level = spark.range(1).select(yields.noise_level([(0.1, -10.0), (1.0, -20.0)], F.lit(0.55))).first()[0]
    assert level == pytest.approx(-15.0)


def test_network_performance_is_the_tail_of_the_loss_density(spark):
    """Against densities interpolated and integrated by Simpson's rule for one pair at a time."""
    from sondera.functions import geodesy

    rng = np.random.default_rng(4)
    ranges, loss = np.arange(10.0, 610.0, 10.0), np.arange(-100.0, -9.0)
    density = {b: np.array([np.exp(-0.5 * ((loss + 15 * np.log10(r) + b) / (4 + b / 4)) ** 2) for r in ranges]) for b in range(8)}
    density = {b: d / d.sum(axis=1, keepdims=True) for b, d in density.items()}
    losses = spark.createDataFrame([(b, float(r), float(x), float(d[i, j])) for b, d in density.items() for i, r in enumerate(ranges) for j, x in enumerate(loss)], "az_bin int, rng double, loss double, p double")
    arrays = [(k, float(a), float(o)) for k, (a, o) in enumerate(rng.uniform(-3, 3, (5, 2)))]
    sources = [(k, float(a), float(o)) for k, (a, o) in enumerate(rng.uniform(-3, 3, (12, 2)))]
    levels = [(0.5, 72.0, 50.0), (1.0, 66.0, 44.0)]
    s, a = spark.createDataFrame(sources, "source_id int, s_lat double, s_lon double"), spark.createDataFrame(arrays, "array_id int, a_lat double, a_lon double")
    got = {(r["source_id"], r["f"]): r["p"] for r in yields.network_performance(s, a, losses, levels, 2).collect()}
    arc, az, _ = geodesy.spherical_inv("s_lat", "s_lon", "a_lat", "a_lon")
    pairs = s.crossJoin(a).select("source_id", "array_id", (F.radians(arc) * geodesy.SPHERE_KM).alias("km"), geodesy.azimuth_bin(az).alias("bin")).collect()
    for f, src, noise in levels:
        seen = np.zeros((len(sources), len(arrays)))
        for r in pairs:
            km = max(r["km"], 10.0)
            x = np.linspace(-20 * np.log10(km), -5 * np.log10(km), 8001)
            at = np.clip(km, ranges[0], ranges[-1])
            p = np.array([np.interp(at, ranges, density[r["bin"]][:, j]) for j in range(len(loss))])
            y = np.interp(x, loss, p) * (src + x > noise / 2 + 5 * np.log10(max(5.0, km * (0.34 - 0.28) / (0.34 * 0.28))))
            seen[r["source_id"], r["array_id"]] = ((y[1:] + y[:-1]) / 2 * np.diff(x)).sum()
        assert 0.05 < seen.mean() < 0.95
        none = np.prod(1 - seen, axis=1)
        one = sum(seen[:, k] * np.prod(np.delete(1 - seen, k, axis=1), axis=1) for k in range(len(arrays)))
        for k in range(len(sources)):
            assert got[k, f] == pytest.approx(1 - none[k] - one[k], abs=2e-3)


def test_noise_and_source_levels(spark):
    low, high = (spark.createDataFrame([(0.1, a), (1.0, a - 2)], "f double, log_psd double") for a in (-4.0, -1.0))
    got = {kind: [r["level"] for r in yields.noise_curve(low, high, kind).orderBy("f").collect()] for kind in ("low", "medium", "high")}
    ref = 10 * np.log10(20e-6)
    assert got["low"] == pytest.approx([-40 - 2 * ref, -60 - 2 * ref]) and got["medium"] == pytest.approx([(a + b) / 2 for a, b in zip(got["low"], got["high"])])
    with pytest.raises(ValueError):
        yields.noise_curve(low, high, "loud")
    level = spark.range(1).select(yields.source_level(F.lit(0.5), F.lit(1e5))).first()[0]
    assert 60 < level < 110
    many = spark.range(yields.MOST_ARRAYS + 1).selectExpr("0D a_lat", "0D a_lon")
    with pytest.raises(ValueError, match="at most"):
        yields.detection_probability(spark.createDataFrame([(1, 0.0, 0.0)], "source_id int, s_lat double, s_lon double"), many, F.lit(0.5), 1)


def not_a_knot(x, y, at):
    """Values of the spline through (x, y), all of whose conditions are solved at once."""
    n = len(x) - 1
    m, rhs, row = np.zeros((4 * n, 4 * n)), np.zeros(4 * n), 0
    powers = lambda d, k: np.array([np.prod(np.arange(p, p - k, -1)) * d ** (p - k) if p >= k else 0.0 for p in range(4)])
    for i in range(n):
        for d, v in ((0.0, y[i]), (x[i + 1] - x[i], y[i + 1])):
            m[row, 4 * i : 4 * i + 4], rhs[row], row = powers(d, 0), v, row + 1
        for k in (1, 2) if i < n - 1 else ():
            m[row, 4 * i : 4 * i + 4], m[row, 4 * i + 4 : 4 * i + 8], row = powers(x[i + 1] - x[i], k), -powers(0.0, k), row + 1
    for i in (0, n - 2):
        m[row, 4 * i + 3], m[row, 4 * i + 7], row = 1, -1, row + 1
    c = np.linalg.solve(m, rhs).reshape(n, 4)
    i = np.clip(np.searchsorted(x, at, "right") - 1, 0, n - 1)
    d = at - x[i]
    return sum(c[i, p] * d**p for p in range(4))


def test_splines_solve_their_conditions():
    from sondera.functions import numeric

    rng = np.random.default_rng(0)
    for n in (2, 3, 4, 5, 30):
        x, y = np.cumsum(rng.uniform(0.5, 2, n)), rng.standard_normal((n, 2))
        c, at = numeric.spline(x, y), np.linspace(x[0], x[-1], 50)
        i = np.clip(np.searchsorted(x, at, "right") - 1, 0, n - 2)
        got = sum(c[p, i] * (at - x[i])[:, None] ** p for p in range(4))
        want = np.stack([not_a_knot(x, v, at) if n > 3 else np.polyval(np.polyfit(x, v, n - 1), at) for v in y.T], axis=1)
        assert np.allclose(got, want, atol=1e-9)


def test_models_are_cubic_along_the_range(spark):
    rng = np.random.default_rng(1)
    ranges = np.arange(10.0, 310.0, 10.0)
    table = {(b, k): rng.uniform(0.2, 1.0, (len(ranges), 5)) for b in range(8) for k in range(3)}
    model = spark.createDataFrame([(b, float(r), k, *map(float, t[i])) for (b, k), t in table.items() for i, r in enumerate(ranges)], "az_bin int, rng double, comp int, wt double, mn double, sd double, az_mn double, az_sd double").repartition(4)
    points = [(i, float(a), float(r), float(v)) for i, (a, r, v) in enumerate(zip(rng.uniform(-180, 180, 200), rng.uniform(0, 330, 200), rng.uniform(0, 1.5, 200)))] + [(200, 10.0, 300.0, 0.5), (201, 10.0, 10.0, 0.5)]
    df = spark.createDataFrame(points, "id int, az double, rng double, rcel double")
    from sondera.functions import geodesy, numeric

    bins = {r["id"]: r["b"] for r in df.select("id", geodesy.azimuth_bin("az").alias("b")).collect()}
    for smooth in (False, True):
        got = {r["id"]: r for r in propagation.evaluate(df, model, smooth=smooth).collect()}
        assert len(got) == len(points)
        for i, _, r, v in points:
            at = np.array([min(max(r, 10.0), 300.0)])
            y = [[float(not_a_knot(ranges, numeric.smoothed(c, 9, 3) if smooth else c, at)[0]) for c in table[bins[i], k].T] for k in range(3)]
            want = sum(w / (s * np.sqrt(2 * np.pi)) * np.exp(-0.5 * ((v - m) / s) ** 2) for w, m, s, *_ in y)
            assert got[i]["pdf"] == pytest.approx(want, rel=1e-9, abs=1e-9) and got[i]["az_mn"] == pytest.approx(y[0][3], abs=1e-9) and got[i]["az_sd"] == pytest.approx(y[0][4], abs=1e-9)


def test_losses_are_bicubic_surfaces(spark):
    rng = np.random.default_rng(2)
    ranges, loss = np.arange(20.0, 200.0, 20.0), np.arange(-40.0, -20.0)
    table = rng.random((8, len(ranges), len(loss)))
    losses = spark.createDataFrame([(b, float(r), float(x), float(table[b, i, j])) for b in range(8) for i, r in enumerate(ranges) for j, x in enumerate(loss)], "az_bin int, rng double, loss double, p double")
    points = [(i, float(a), float(r), float(v)) for i, (a, r, v) in enumerate(zip(rng.uniform(-180, 180, 60), rng.uniform(10, 200, 60), rng.uniform(-42, -19, 60)))] + [(60, 0.0, 40.0, -30.0)]
    df = spark.createDataFrame(points, "id int, az double, rng double, loss double")
    from sondera.functions import geodesy

    bins = {r["id"]: r["b"] for r in df.select("id", geodesy.azimuth_bin("az").alias("b")).collect()}
    got = {r["id"]: r["pdf"] for r in propagation.evaluate_loss(df, losses, step=20.0).collect()}
    for i, _, r, v in points:
        at = np.clip(v, loss[0], loss[-1])
        line = np.array([not_a_knot(loss, row, np.array([at]))[0] for row in table[bins[i]]])
        assert got[i] == pytest.approx(not_a_knot(ranges, line, np.array([np.clip(r, 20, 180)]))[0], abs=1e-9)
