"""Older array analysis, reference curves, rays, headers, marginals and densities against brute force."""

import numpy as np
import pytest

from sondera.functions import numeric, physics
from sondera.operators import beamforming, classic, likelihood, propagation, relational
from sondera.sources import beams, rays, sac, tables

GEOMETRY = 0.2 * np.array([[0.0, 0.0], [0.9, 0.2], [-0.4, 0.8], [-0.5, -0.7], [0.3, -0.9]])
SEGMENTS = "array_id string, channel string, t0 double, fs double, calib double, dx double, dy double, samples array<double>"


def waves(az, slowness, fs=40.0, seconds=70.0, noise=0.3):
    rng = np.random.default_rng(3)
    way = np.array([np.sin(np.radians(az)), np.cos(np.radians(az))]) * slowness
    tones, phases = np.linspace(0.6, 4.5, 60), rng.uniform(0, 2 * np.pi, 60)
    t = np.arange(int(seconds * fs)) / fs
    return [("A", f"c{k}", 0.0, fs, 1.0, *map(float, g), (np.sin(2 * np.pi * tones[:, None] * (t + way @ g) + phases[:, None]).sum(axis=0) + noise * rng.standard_normal(len(t))).tolist()) for k, g in enumerate(GEOMETRY)]


@pytest.mark.parametrize("method", sorted(classic.METHODS))
def test_classic_methods_find_the_wave(spark, method):
    df = spark.createDataFrame(waves(140.0, 2.8), SEGMENTS)
    run = classic.Classic(method, freq=(0.5, 4.5), length=30.0, overlap=15.0, slowness=(-3.6, 3.6, 0.1))
    rows = classic.run_classic(df, run).toPandas().sort_values(["t", "source"], ignore_index=True)
    first = rows[rows["source"] == 0]
    assert first["t"].tolist() == [0.0, 15.0, 30.0]
    assert (abs(first["back_az"] - 140) < 12).all() and (abs(first["slowness"] - 2.8) < 0.6).all()
    assert (first["f_stat"] > 5).all() and (first["corr_min"] > 0.5).all() and (first["corr_max"] <= 1).all()


def test_array_response_is_one_at_its_wave():
    axis = np.arange(-3.0, 3.01, 0.25)
    grid = classic.array_response(GEOMETRY, np.array([1.0, 2.0]), axis, (0.5, -1.0))
    i, j = np.unravel_index(np.argmax(grid), grid.shape)
    assert (axis[j], axis[i]) == (0.5, -1.0) and grid[i, j] == pytest.approx(1.0)


def test_spherical_delays_tend_to_plane_ones():
    az = np.array([30.0])
    far = 1e7 * np.array([[np.sin(np.radians(30)), np.cos(np.radians(30))]])
    assert np.allclose(beamforming.spherical_delays(GEOMETRY, far, 0.0, 340.0), beamforming.delays_of(GEOMETRY - GEOMETRY[0], az, np.array([340.0])), atol=1e-9)
    near = beamforming.spherical_delays(GEOMETRY, np.array([[3.0, 4.0]]), 12.0, 2.0)
    assert near[0, 0] == 0 and near[0, 1] == pytest.approx((13 - np.sqrt((3 - GEOMETRY[1, 0]) ** 2 + (4 - GEOMETRY[1, 1]) ** 2 + 144)) / 2)


def test_curves(spark, tmp_path):
    (tmp_path / "t.dat").write_text("DEG P S\n" + "\n".join(f"{x} {x**3 - 2 * x} {x * 2}" for x in np.linspace(0, 4, 9)))
    t = tables.read_columns(spark, str(tmp_path / "t.dat"), ["deg", "p", "s"])
    assert t.count() == 9
    x = spark.createDataFrame([(float(v),) for v in [-0.1, 0.0, 0.3, 1.77, 4.0, 4.1]] + [(None,)], "x double")
    got = {r["x"]: r["y"] for r in tables.along(x, "x", tables.curve(t, "deg", "p", "cubic"), "y").collect()}
    assert len(got) == 7 and all(got[v] is None for v in (-0.1, 4.1, None))
    assert all(got[v] == pytest.approx(v**3 - 2 * v, abs=1e-9) for v in (0.0, 0.3, 1.77, 4.0))  # such a spline is exact for cubics
    linear = {r["x"]: r["y"] for r in tables.along(x, "x", tables.curve(t, "deg", "s"), "y").collect()}
    assert linear[1.77] == pytest.approx(3.54)
    km = spark.createDataFrame([(111.0,)], "km double")
    assert likelihood.travel_times(km, "km", t, "s").first()["expected"] == pytest.approx(2 * np.degrees(111 / 6370.997), abs=1e-6)


def test_models_are_saved_with_their_kind(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0)], "az_bin int, wt double")
    tables.save_model(df, str(tmp_path / "m"), "path geometry")
    assert tables.load_model(spark, str(tmp_path / "m"), "path geometry").collect() == df.collect()
    with pytest.raises(Exception, match="not a model"):
        tables.load_model(spark, str(tmp_path / "m"), "loss").collect()
    with pytest.raises(Exception, match="(?i)exist"):
        tables.save_model(df, str(tmp_path / "m"), "loss")


def test_rays_and_eigenrays(spark, tmp_path):
    (tmp_path / "r.dat").write_text("# theta phi\n5 190 1 -100 -100 500 0.28 40 20 46 -30 -2\n")
    r = rays.read_rays(spark, str(tmp_path / "r.dat")).first()
    assert (r["rng"], r["rcel"], r["az"], r["az_dev"], r["phi"], r["loss"]) == pytest.approx((np.hypot(100, 100), 500 / np.hypot(100, 100), -135.0, -1.0, -170.0, -32.0))
    (tmp_path / "o.dat").write_text("5 190 1 -100 -100 500 40 20 46 -30 -2\n")
    assert rays.read_rays(spark, str(tmp_path / "o.dat"), "old").first()["back_az"] == 46
    (tmp_path / "e.dat").write_text("1 2 0 41.00049 -112.1239 1000.5 0.3 50 10 123.456 -40 -3\n")
    e = rays.eigenray_detections(spark, str(tmp_path / "e.dat"), 1.6e9, 335.0, 12.0, 4).first()
    assert (e["latitude"], e["longitude"], e["back_az"], e["trace_vel"]) == (41.0, -112.124, 123.46, pytest.approx(340.2)) and e["time"].timestamp() == 1.6e9 + 1000.5


def test_sac_files_round_trip(spark, tmp_path):
    rng = np.random.default_rng(1)
    x = rng.standard_normal(50).astype(np.float32).astype(float).tolist()
    df = spark.createDataFrame([("NN", "STA1", None, "BDF", 1.6e9 + 0.25, 20.0, 2.0, 41.5, -112.25, None, x)], sac.SCHEMA)
    row = sac.to_sac(df).first()
    assert row["name"] == "NN.STA1..BDF_2020.09.13_12.26.40.sac"
    (tmp_path / row["name"]).write_bytes(row["content"])
    back = sac.read_sac(spark, str(tmp_path)).first()
    assert back["samples"] == x and (back["network"], back["station"], back["location"], back["channel"]) == ("NN", "STA1", None, "BDF")
    assert (back["t0"], back["fs"], back["calib"], back["lat"], back["lon"]) == pytest.approx((1.6e9 + 0.25, 20.0, 2.0, 41.5, -112.25)) and back["elev"] is None


def test_beam_files_with_header(spark, tmp_path):
    df = spark.createDataFrame(waves(140.0, 2.8, seconds=5), SEGMENTS)
    beam = beamforming.Beam(method="gls", noise=(0.0, 3.0))
    rows = spark.createDataFrame([(5.0, 10.5, 340.0, 2.5), (0.0, 11.5, 341.0, 3.5)], "t double, back_az double, trace_vel double, f_stat double")
    beams.write_beams_with_header(rows, beams.header_lines(df, beam, (40.0, -111.0)), str(tmp_path / "out"), "v0")
    back = beams.read_beams(spark, str(tmp_path / "out" / "run=v0")).orderBy("t").collect()
    assert [(r["t"], r["f_stat"]) for r in back] == [(0.0, 3.5), (5.0, 2.5)]
    head = {r["key"]: r["value"] for r in beams.read_beam_header(spark, str(tmp_path / "out" / "run=v0")).collect()}
    assert head["method"] == "gls" and head["noise_end"] == "3.0" and head["channel_cnt"] == "5" and head["latitude"] == "40.0"


def test_time_marginal_is_the_integral(spark):
    mixture = tuple(np.array(x) for x in (physics.RCEL_WEIGHTS, physics.RCEL_MEANS, physics.RCEL_SDS))
    km = np.array([200.0, 350.0, 280.0])
    t = 1000 + km * np.array([3.7, 3.6, 3.8])
    none = np.zeros(0)
    for st, stt, ssd in ((none, none, none), (np.array([1031.0]), np.array([30.0]), np.array([3.0]))):
        x = np.linspace(-500, 3000, 200_001)
        dens = np.ones_like(x)
        for ti, ki in zip(t, km):
            dens *= sum(w * np.exp(-0.5 * (((ti - x) / ki - m) / s) ** 2) / (s * np.sqrt(2 * np.pi)) for w, m, s in zip(*mixture)) / ki
        for a, b, d in zip(st, stt, ssd):
            dens *= np.exp(-0.5 * ((a - b - x) / d) ** 2) / (d * np.sqrt(2 * np.pi))
        want = dens.sum() * (x[1] - x[0])
        assert likelihood.time_marginal(t, km, mixture, st, stt, ssd) == pytest.approx(want, rel=1e-6)
        assert likelihood.time_marginal(t, km, mixture, st, stt, ssd, most=5 if len(st) else 9) != pytest.approx(want, rel=1e-9)
    assert likelihood.time_marginal(np.r_[t, t + 5, t], np.r_[km, km, km], mixture, none, none, none, most=2001) > 0
    assert likelihood.time_marginal(none, none, mixture, none, none, none) == 1.0


def test_densities_by_cells_are_those_of_the_values(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(-60, 6, 3000)
    df = spark.createDataFrame([("a", float(v)) for v in x] + [("b", -50.0)] * 5, "k string, v double")
    got = propagation.density_rows(df, ["k"], "v", -90.0, -30.0, 121).toPandas()
    a = got[got["k"] == "a"].sort_values("x")
    assert np.allclose(a["p"], numeric.kde(x, a["x"].to_numpy()), atol=2e-4)
    b = got[got["k"] == "b"]
    assert b.loc[b["p"].idxmax(), "x"] == -50 and b["p"].max() == pytest.approx(1 / (0.01 * np.sqrt(2 * np.pi)))


def test_celerity_fit_recovers_its_mixture(spark):
    rng = np.random.default_rng(6)
    rc = np.r_[rng.normal(3.06, 0.06, 8000), rng.normal(3.42, 0.08, 12000), rng.normal(3.9, 0.3, 40000)]
    df = spark.createDataFrame([(float(1 / v), -10.0) for v in rc], "cel double, loss double")
    row = propagation.fit_celerity(df, loss="loss", least_loss=-20.0).first()
    assert row["settled"] and np.allclose(row["means"], [3.06, 3.42, 3.9], atol=0.08)


def test_shell_patterns_and_parameter_sets(spark):
    import fnmatch

    names = ["BDF", "BDF1", "bdf", "HDF", "B.F", "B[F", "B-F", "BD\nF"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    for pattern in ("B*", "?DF", "[BH]DF", "[!H]DF", "B.F", "B[.]F", "*F?", "B[a-z]F", "B*F"):
        got = {r["n"] for r in df.where(relational.matches("n", pattern)).collect()}
        assert got == {n for n in names if fnmatch.fnmatchcase(n, pattern)}, pattern
    sets = spark.createDataFrame([(1, "a", None), (2, "a", 5), (3, "b", 5), (4, "b", 5)], "id int, m string, w int")
    assert [r["id"] for r in relational.parameter_set(sets, m="a", w=None).collect()] == [1]
    assert relational.parameter_set(sets, m="z", w=1).count() == 0
    with pytest.raises(Exception, match="several parameter sets"):
        relational.parameter_set(sets, m="b", w=5).collect()



def test_segments_from_catalog_tables(spark, tmp_path):
    from sondera.sources import waveforms as w

    one, two = np.arange(10, dtype=">i4"), (np.arange(6) * 0.5).astype("<f4")
    (tmp_path / "a.w").write_bytes(b"head" + one.tobytes())
    (tmp_path / "b.w").write_bytes(two.tobytes())
    sites = spark.createDataFrame([("S1", "ARR", 40.0, -110.0, 1.0, 2019001, -1), ("S2", "ARR", 40.1, -110.1, 1.0, 2019001, 2019100), ("S3", "OTH", 1.0, 2.0, 0.0, 2019001, -1)], "sta string, refsta string, lat double, lon double, elev double, ondate int, offdate int")
    t = 1.6e9
    rows = [("S1", "BDF", t, t + 0.9, 10, 10.0, 2.0, "s4", "a.w", 4), ("S1", "XXX", t, t + 0.9, 10, 10.0, 2.0, "s4", "a.w", 4), ("S2", "BDF", t, t + 0.5, 6, 10.0, 0.0, "f4", "b.w", 0), ("S3", "BDF", t + 900, t + 900.5, 6, 10.0, 0.0, "f4", "b.w", 0)]
    wfdisc = spark.createDataFrame(rows, "sta string, chan string, time double, endtime double, nsamp int, samprate double, calib double, datatype string, dfile string, foff int")
    got = w.waveforms(spark, catalog=(sites, wfdisc, str(tmp_path)), array="ARR", channel="?DF", start=t - 5, end=t + 5).collect()
    assert [(r["station"], r["channel"], r["calib"]) for r in got] == [("S1", "BDF", 2.0)] and got[0]["samples"] == (np.arange(10) - 4.5).tolist()
    every = w.waveforms(spark, catalog=(sites, wfdisc, str(tmp_path)), channel="BDF").collect()
    assert {(r["station"], r["calib"]) for r in every} == {("S1", 2.0), ("S3", 1.0)}  # S2 was closed by then
    with pytest.raises(ValueError):
        w.waveforms(spark, files="a", table="b")
    assert [r["sta"] for r in w.copy_new(sites, sites.where("sta = 'S1'"), ["sta"], {"lat": (39.0, 41.0)}).collect()] == ["S2"]


def test_source_spectrum_is_the_product_of_stations(spark):
    from sondera.operators import yields

    grid = [(0, 100.0, float(x), np.exp(-0.5 * ((x + 40) / 5) ** 2)) for x in range(-80, 1, 2)] + [(0, 200.0, float(x), np.exp(-0.5 * ((x + 50) / 5) ** 2)) for x in range(-80, 1, 2)]
    losses = spark.createDataFrame([(a, r, x, float(p)) for a, r, x, p in grid], "az_bin int, rng double, loss double, p double")
    seen = spark.createDataFrame([(1, "a", 0.5, 62.0, 98.0, 0), (1, "b", 0.5, 49.0, 203.0, 0)], "event_id int, station string, f double, db double, km double, az_bin int")
    got = {r["level"]: r["p"] for r in yields.source_spectrum(seen, losses, (90.0, 110.0, 11)).collect()}
    for level, p in got.items():
        want = np.prod([np.interp(db - level, [g[2] for g in grid if g[1] == r], [g[3] for g in grid if g[1] == r]) for db, r in ((62.0, 100.0), (49.0, 200.0))])
        assert p == pytest.approx(max(want, 1e-18), rel=1e-6)
    assert max(got, key=got.get) in (100.0, 102.0)
