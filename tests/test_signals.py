"""Beamforming, detection and spectral operators on synthetic records with known answers."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sondera.functions import numeric
from sondera.operators import beamforming, detection, spectral, windows

GEOMETRY = np.array([[0.0, 0.0], [160.0, 30.0], [-60.0, 140.0], [-90.0, -120.0]])


def plane_wave(az, vel, fs=20.0, seconds=60.0, noise=0.1, seed=1, rates=None):
    """Segments of four channels with a band-limited signal from a back azimuth."""
    rng = np.random.default_rng(seed)
    s = np.array([np.sin(np.radians(az)), np.cos(np.radians(az))]) / vel
    tones, phases = np.linspace(0.4, 5.2, 97), rng.uniform(0, 2 * np.pi, 97)
    rows = []
    for k, (dx, dy) in enumerate(GEOMETRY):
        rate = fs if rates is None else rates[k]
        t = np.arange(int(seconds * rate)) / rate + 0.013 * k
        u = t + s @ (dx, dy)
        x = np.sin(2 * np.pi * tones[:, None] * u + phases[:, None]).sum(axis=0) + noise * rng.standard_normal(len(t))
        rows.append(("A", f"c{k}", 1000.0 + 0.013 * k, float(rate), 1.0, float(dx), float(dy), x.tolist()))
    return rows


SEGMENTS = "array_id string, channel string, t0 double, fs double, calib double, dx double, dy double, samples array<double>"


@pytest.mark.parametrize("method", ["bartlett", "bartlett_covar", "gls", "capon", "music"])
def test_plane_wave_is_recovered(spark, method):
    beam = beamforming.Beam(az=(-180.0, 180.0, 4.0), vel=(300.0, 500.0, 10.0), method=method, sub_length=None if method in ("bartlett", "gls") else 4.0)
    rows = beamforming.run_fk(spark.createDataFrame(plane_wave(-42.0, 360.0), SEGMENTS), beam).toPandas()
    assert len(rows) >= 9 and rows["t"].is_unique
    # tapered sub-windows favour short delays, which the sharper methods show in the velocity
    assert abs(rows["back_az"].median() + 42) < 4 and abs(rows["trace_vel"].median() - 360) < (60 if method in ("capon", "music") else 12)
    if method == "bartlett":
        assert rows["power"].min() > 0.9 and rows["f_stat"].min() > 20


def test_channels_with_other_rates_are_aligned(spark):
    segments = spark.createDataFrame(plane_wave(100.0, 340.0, rates=[20.0, 25.0, 20.0, 20.0]), SEGMENTS)
    rows = beamforming.run_fk(segments, beamforming.Beam(az=(-180.0, 180.0, 4.0), vel=(300.0, 400.0, 10.0))).toPandas()
    assert abs(rows["back_az"].median() - 100) < 4


def test_f_distribution_and_kde():
    assert numeric.f_cdf(numeric.f_ppf(0.95, 8, 24), 8, 24) == pytest.approx(0.95, abs=1e-10)
    assert numeric.f_ppf(0.95, 5, 10) == pytest.approx(3.3258, abs=1e-4)  # tables of the F distribution
    x = np.random.default_rng(0).normal(3.0, 0.5, 4000)
    assert numeric.kde_mode(x) == pytest.approx(3.0, abs=0.15)


def test_white_noise_threshold_keeps_its_false_alarm_rate(spark):
    d1, channels = 20.0, 4
    rng = np.random.default_rng(3)
    f = rng.f(d1, d1 * (channels - 1), 4000)
    beams = spark.createDataFrame(pd.DataFrame({"array_id": "A", "t": 10.0 * np.arange(4000), "f_stat": f}))
    out = detection.adaptive_threshold(beams, ["array_id"], "t", "f_stat", 4000.0, 0.05, d1, channels).toPandas()
    assert len(out) == 4000 and 0.02 < (out["f_stat"] >= out["threshold"]).mean() < 0.09


def brute_runs(mask, least):
    out, start = [], None
    for i, m in enumerate([*mask[:-1], False]):
        if m and start is None:
            start = i
        if not m and start is not None:
            if i - start >= least:
                out.append((start, i - 1))
            start = None
    return out


def test_runs_follow_the_rule_that_the_last_row_is_out(spark):
    rng = np.random.default_rng(5)
    rows, expected = [], []
    for key in range(30):
        mask = (rng.random(25) < 0.7).tolist()
        rows += [(key, i, bool(m)) for i, m in enumerate(mask)]
        expected += [(key, a, b) for a, b in brute_runs(mask, 3)]
    df = spark.createDataFrame(rows, "k int, t int, hit boolean")
    got = windows.runs(df, ["k"], "t", "hit", 3).groupBy("k", "run").agg(F.min("t"), F.max("t")).collect()
    assert sorted((r[0], r[2], r[3]) for r in got) == sorted(expected)


def test_near_detections_merge_to_a_fixpoint(spark):
    rows = [("A", 1, 100.0, 5.0, 10.0, 0.0, -10.0, 10.0), ("A", 2, 125.0, 9.0, 12.0, 0.0, -10.0, 10.0), ("A", 3, 150.0, 4.0, 11.0, 0.0, -10.0, 10.0), ("A", 4, 400.0, 4.0, 11.0, 0.0, -10.0, 10.0), ("A", 5, 426.0, 4.0, 90.0, 0.0, -10.0, 10.0)]
    df = spark.createDataFrame(rows, "array_id string, run long, t double, f_stat double, back_az double, trace_vel double, start double, end double")
    out = windows.merge_detections(df, ["array_id"], "t", "f_stat", "back_az", 15.0).orderBy("t").collect()
    assert [(r["t"], r["f_stat"], r["start"], r["end"]) for r in out] == [(125.0, 9.0, -35.0, 35.0), (400.0, 4.0, -10.0, 10.0), (426.0, 4.0, -10.0, 10.0)]


def test_run_fd_finds_a_strong_stretch(spark):
    rng = np.random.default_rng(7)
    n = 1200
    f = rng.f(20, 60, n)
    f[600:620] += 30
    az = rng.uniform(-180, 180, n)
    az[600:620] = 35 + rng.normal(0, 1, 20)
    beams = spark.createDataFrame(pd.DataFrame({"array_id": "A", "t": 5.0 * np.arange(n), "back_az": az, "trace_vel": 350.0, "f_stat": f}))
    found = detection.run_fd(beams, window=3600.0, p=0.01, time_bandwidth=20.0, channels=4, min_rows=3, az_width=15.0).collect()
    assert len(found) == 1 and 3000 <= found[0]["t"] <= 3095 and abs(found[0]["back_az"] - 35) < 4


def test_histogram_detector_passes_what_stands_out(spark):
    rng = np.random.default_rng(11)
    f = rng.f(20, 60, 400)
    f[200:204] = 12.0
    beams = spark.createDataFrame(pd.DataFrame({"sta": "A", "t": 10.0 * np.arange(400), "f": f}))
    out = detection.histogram_detector(beams, ["sta"], "t", "f", 1000.0, 0.001, 20.0, 60.0, 0.5).toPandas().sort_values("t")
    hit = out["hit"].to_numpy()
    assert hit[200:204].all() and hit.sum() <= 10


def test_spectral_detection_finds_the_burst(spark):
    rng = np.random.default_rng(2)
    fs, n = 20.0, 20 * 1200
    x = rng.standard_normal(n)
    t = np.arange(n) / fs
    burst = (t > 500) & (t < 530)
    x[burst] += 6 * np.sin(2 * np.pi * 4 * t[burst])
    segments = spark.createDataFrame([("c0", 0.0, fs, x.tolist())], "channel string, t0 double, fs double, samples array<double>")
    found = spectral.run_sd(segments, 1.0, 9.0, 600.0, 300.0, 0.001, min_points=30).toPandas()
    best = found.sort_values("n_points").iloc[-1]
    assert abs(best["t"] - 515) < 10 and best["f_lo"] <= 4 <= best["f_hi"]
    psd = spectral.welch_psd(segments, 4.0).toPandas()
    assert abs(psd.loc[psd["db"].idxmax(), "f"] - 4) < 0.3


def test_dbscan_matches_brute_force(spark):
    rng = np.random.default_rng(9)
    pts = np.vstack([rng.normal(c, 0.4, (40, 2)) for c in ((0, 0), (5, 5), (5, 0))] + [rng.uniform(-3, 8, (30, 2))])
    df = spark.createDataFrame([("k", i, float(a), float(b)) for i, (a, b) in enumerate(pts)], "k string, pid long, x double, y double")
    got = {r["pid"]: r["cluster"] for r in spectral.dbscan(df, ["k"], "x", "y", 0.5, 5).collect()}
    near = [[j for j in range(len(pts)) if np.hypot(*(pts[i] - pts[j])) <= 0.5] for i in range(len(pts))]
    core = {i for i in range(len(pts)) if len(near[i]) >= 5}
    label = {i: i for i in core}
    for _ in range(len(pts)):
        label = {i: min(label[j] for j in near[i] if j in core) for i in core}
    for i in range(len(pts)):
        expected = label[i] if i in core else min((label[j] for j in near[i] if j in core), default=None)
        assert got[i] == expected


@pytest.mark.parametrize("pairs", [spectral.PAIRS, 6])
def test_density_clusters_of_dense_cells(spark, pairs):
    """Lines, clumps and repeated points; boxes are divided down to a few points."""
    rng = np.random.default_rng(3)
    pts = np.vstack([rng.normal((0, 0), 0.02, (60, 2)), rng.normal((0.5, 0.02), 0.02, (50, 2)), np.repeat([[1.02, 0.0]], 30, axis=0), rng.uniform(-1, 3, (150, 2)), [[1.51, 0.0], [1.53, 0.0]]])
    df = spark.createDataFrame([("k", i, float(a), float(b)) for i, (a, b) in enumerate(pts)] + [("k", 9000, None, 1.0)], "k string, pid long, x double, y double")
    got = {r["pid"]: r["cluster"] for r in spectral.dbscan(df, ["k"], "x", "y", 0.5, 5, pairs).collect()}
    near = (((pts[:, None] - pts[None]) ** 2).sum(axis=2) <= 0.25)
    core = near.sum(axis=1) >= 5
    label = np.where(core, np.arange(len(pts)), len(pts))
    while True:
        new = np.where(core, np.where(near & core[None], label[None], len(pts)).min(axis=1), len(pts))
        if (new == label).all():
            break
        label = new
    border = np.where(near & core[None], label[None], len(pts)).min(axis=1)
    assert got.pop(9000) is None
    assert [got[i] for i in range(len(pts))] == [None if v == len(pts) else v for v in border.tolist()]


def test_a_cell_of_very_many_points_makes_no_pairs(spark):
    from pyspark.sql import functions as F

    n = 100_000
    df = spark.range(n).select(F.lit("k").alias("k"), F.col("id").alias("pid"), (F.rand(1) * 0.3).alias("x"), (F.rand(2) * 0.3).alias("y"))
    df = df.union(spark.createDataFrame([("k", n, 0.6, 0.1), ("k", n + 1, 9.0, 9.0)], df.schema))
    got = {r["cluster"]: r["count"] for r in spectral.dbscan(df, ["k"], "x", "y", 0.5, 5).groupBy("cluster").count().collect()}
    assert got == {0: n + 1, None: 1}


def test_strongest_point_of_each_span(spark):
    from sondera.operators import relational

    rng = np.random.default_rng(8)
    points = [(int(rng.integers(3)), float(t), float(rng.integers(0, 6)), i) for i, t in enumerate(np.sort(rng.uniform(0, 500, 400)))]
    spans = [(int(rng.integers(4)), i, float(a), float(a + d)) for i, (a, d) in enumerate(zip(rng.uniform(-20, 500, 200), rng.choice([0.5, 10, 60, 300, -1], 200)))]
    df, sp = spark.createDataFrame(points, "k int, t double, v double, i int"), spark.createDataFrame(spans, "k int, s int, lo double, hi double")
    out = relational.interval_argmax(df, sp, ["k"], "t", "lo", "hi", 50.0, "s", "v")
    got = {r["s"]: r["peak"]["i"] for r in out.collect()}
    want = {s: min(((-v, t, i) for q, t, v, i in points if q == k and lo <= t <= hi), default=None) for k, s, lo, hi in spans}
    assert got == {s: w[2] for s, w in want.items() if w}
    assert "SortAggregate" not in out._jdf.queryExecution().executedPlan().toString()


def test_linkage_cut():
    x = np.array([0.0, 0.1, 0.3, 5.0, 5.2, 9.0])
    d = np.abs(x[:, None] - x[None, :])
    for how in ("single", "complete", "average", "weighted"):
        assert numeric.cut_linkage(d, 1.0, how).tolist() == [0, 0, 0, 1, 1, 2]


def test_pure_state_and_best_beam():
    x = np.array([[1 + 0j], [1j], [-1 + 0j]])
    assert numeric.pure_state(np.einsum("mf,nf->fmn", x, x.conj()))[0] == pytest.approx(1.0)
    assert numeric.pure_state(np.eye(3)[None].astype(complex))[0] == pytest.approx(0.0)
    f, tau = np.array([1.0, 2.0]), np.array([0.0, 0.1, 0.2])
    wave = np.exp(2j * np.pi * f[None, :] * tau[:, None])
    beam, rest = numeric.best_beam(wave, f, tau)
    assert np.abs(rest).max() < 1e-12 and np.abs(beam) == pytest.approx([1.0, 1.0])  # the mean of the aligned channels


def test_short_segments_give_the_same_windows(spark):
    """A record in ten segments, one sample apart or with a hole, and the same record whole."""
    from sondera.operators import records

    whole = plane_wave(-42.0, 360.0, seconds=120.0)
    cut = [(a, c, t0 + k * 12.0, fs, cal, dx, dy, x[k * 240 : (k + 1) * 240]) for a, c, t0, fs, cal, dx, dy, x in whole for k in range(10)]
    beam = beamforming.Beam(az=(-180.0, 180.0, 4.0), vel=(300.0, 500.0, 10.0))
    one, ten = (beamforming.run_fk(spark.createDataFrame(rows, SEGMENTS), beam).toPandas().sort_values("t") for rows in (whole, cut))
    assert len(one) == 22 and np.allclose(one[["t", "back_az", "trace_vel", "power"]].to_numpy(), ten[["t", "back_az", "trace_vel", "power"]].to_numpy(), atol=1e-9)
    back = records.split(spark.createDataFrame(whole, SEGMENTS), 7.0).orderBy("channel", "t0").collect()
    assert [x for r in back if r["channel"] == "c1" for x in r["samples"]] == whole[1][-1] and max(len(r["samples"]) for r in back) == 140


def test_gaps_hold_zeros_and_trends_are_those_of_the_record(spark):
    from sondera.operators import records

    rng = np.random.default_rng(4)
    x = rng.standard_normal(400) + 0.01 * np.arange(400) + 3
    parts = [("A", "c0", 0.0, 10.0, 2.0, 0.0, 0.0, x[:150].tolist()), ("A", "c0", 25.0, 10.0, 2.0, 0.0, 0.0, x[250:].tolist())]
    df = spark.createDataFrame(parts, SEGMENTS)
    filled = 2 * np.where((np.arange(400) < 150) | (np.arange(400) >= 250), x, 0)
    slope, mean = np.polyfit(np.arange(400) / 10 - 19.95, filled, 1)
    line = records.channel_lines(df).first()
    assert (line["slope"], line["mean"], line["last"]) == pytest.approx((slope, mean, 39.9))
    w = {r["start"]: r for r in records.windows_of(df, 10.0, 5.0).collect()}
    assert sorted(w) == [0, 5, 10, 15, 20, 25]
    for start, r in w.items():
        got, dt, _ = records.aligned(r["channels"], r["pieces"], start, 10.0)
        i = int(start * 10) + np.arange(100)
        assert dt == 0.1 and np.allclose(got[0], filled[i] - mean - slope * (i / 10 - 19.95))


def test_least_squares_beam_needs_its_noise(spark):
    """A loud wave all along and a weak one from elsewhere later: with the loud one's covariance the beam is another, and follows its formula."""
    loud, weak = plane_wave(80.0, 330.0, seconds=160.0, seed=2), plane_wave(-60.0, 350.0, seconds=160.0, seed=9, noise=0.0)
    rows = []
    for a, b in zip(loud, weak, strict=True):
        y = np.array(b[-1]) * 0.25 * (np.arange(len(b[-1])) > 2000)
        rows.append((*a[:-1], (np.array(a[-1]) + y).tolist()))
    df = spark.createDataFrame(rows, SEGMENTS)
    base = beamforming.Beam(az=(-180.0, 180.0, 4.0), vel=(300.0, 420.0, 10.0), method="gls")
    found = {}
    for name, beam in (("white", base), ("noise", beamforming.with_noise(base, (1000.5, 1095.0)))):
        found[name] = beamforming.run_fk(df, beam).toPandas().sort_values("t")["power"].to_numpy()
    assert len(found["white"]) == len(found["noise"]) and np.abs(found["white"] - found["noise"]).max() > 1e-3
    # the inverse against numpy, and the power against its formula
    beam = beamforming.with_noise(base, (1000.5, 1095.0))
    inv = np.frombuffer(beamforming.noise_inverse(df, beam).first()["inverse"], complex).reshape(-1, 4, 4)
    from sondera.operators import records

    made = [numeric.spectra(records.aligned(r["channels"], r["pieces"], r["start"], 10.0)[0], 0.05) for r in records.windows_of(df, 10.0, 5.0, beam.noise).collect()]
    s = np.mean([m[1] for m in made], axis=0)
    own = np.stack([np.linalg.inv(x + 1e-3 * np.trace(x).real / 4 * np.eye(4)) for x in s])
    assert np.allclose(inv, own, rtol=1e-6)
    x, cov, f = made[0]
    d = beamforming.delays_of(GEOMETRY, *base.axes())
    got = numeric.beam_power(x[None, :, 20:24], cov[None, 20:24], f[20:24], d, "gls", noise_inverse=own[20:24])[0, ::97]
    a = np.exp(2j * np.pi * f[20:24, None, None] * d[None, ::97]) / 2
    ref = [np.mean([abs(a[i, k].conj() @ own[20 + i] @ x[:, 20 + i]) ** 2 / (a[i, k].conj() @ own[20 + i] @ a[i, k]).real ** 2 / (abs(x[:, 20 + i]) ** 2).sum() for i in range(4)]) for k in range(a.shape[1])]
    assert np.allclose(got, ref)


def test_two_waves_give_two_peaks(spark):
    one, two = plane_wave(80.0, 340.0, seed=2), plane_wave(-60.0, 350.0, seed=9)
    rows = [(*a[:-1], (np.array(a[-1]) + 0.9 * np.array(b[-1])).tolist()) for a, b in zip(one, two, strict=True)]
    beam = beamforming.Beam(az=(-180.0, 180.0, 4.0), vel=(300.0, 420.0, 10.0), method="music", sub_length=4.0, signals=2)
    out = beamforming.run_fk(spark.createDataFrame(rows, SEGMENTS), beam).toPandas()
    sides = out.groupby("t")["back_az"].apply(lambda z: sorted(z))
    assert (out["signal"].isin([0, 1])).all()
    assert np.median([abs(s[0] + 60) for s in sides]) < 12 and np.median([abs(s[-1] - 80) for s in sides]) < 12


def test_a_quadric_has_its_own_top():
    az, vel = np.arange(-10.0, 11, 1), np.arange(300.0, 400, 5)
    a, v = np.meshgrid(az, vel)
    power = 0.8 - 0.002 * (a - 2.3) ** 2 - 1e-5 * (v - 341.7) ** 2 - 2e-5 * (a - 2.3) * (v - 341.7)
    assert numeric.peaks(power.ravel(), az, vel)[0] == pytest.approx((2.3, 341.7, 0.8), abs=1e-6)


def test_frequency_weights(spark):
    df = spark.createDataFrame(plane_wave(30.0, 345.0, noise=2.0), SEGMENTS)
    for how in (None, "arrival", "pure"):
        out = beamforming.run_fk(df, beamforming.Beam(az=(-180.0, 180.0, 4.0), vel=(300.0, 420.0, 10.0), weights=how, sub_length=4.0 if how == "pure" else None)).toPandas()
        assert abs(out["back_az"].median() - 30) < 5


def test_best_beam_over_windows_is_the_wave(spark):
    rows = plane_wave(-42.0, 360.0, seconds=60.0, noise=0.0)
    df = spark.createDataFrame(rows, SEGMENTS)
    fk = spark.createDataFrame([("A", 1010.0 + 5 * k, -42.0, 360.0) for k in range(9)], "array_id string, t double, back_az double, trace_vel double")
    out = beamforming.best_beams(df, fk, 5.0, 20.0).toPandas().sort_values("t")
    mid = out[(out["t"] > 1015) & (out["t"] < 1045)]
    wave = np.interp(mid["t"], 1000 + np.arange(1200) / 20, np.array(rows[0][-1]))
    got = mid["beam"].to_numpy() / mid["weight"].to_numpy()
    assert np.corrcoef(wave, got)[0, 1] > 0.97
    rest = np.stack(mid["residual"].to_numpy())
    assert rest.shape[1] == 4 and (rest**2).mean() < 0.1 * (wave**2).mean()


@pytest.mark.parametrize("noise", ["pre", "post", "beam"])
def test_detection_spectra_hold_the_tone(spark, noise):
    fs, n = 20.0, 4000
    t = np.arange(n) / fs
    rng = np.random.default_rng(3)
    tone = np.where((t > 80) & (t < 120), 5 * np.sin(2 * np.pi * 2.0 * t), 0.0)
    rows = [("A", f"c{k}", 0.0, fs, 1.0, float(x), float(y), (tone + 0.1 * rng.standard_normal(n)).tolist()) for k, (x, y) in enumerate(GEOMETRY * 1e-3)]
    det = spark.createDataFrame([("A", 100.0, -20.0, 20.0, 0.0, 340.0)], "array_id string, t double, start double, end double, back_az double, trace_vel double")
    got = beamforming.detection_spectra(spark.createDataFrame(rows, SEGMENTS), det, noise=noise).toPandas()
    assert abs(got.loc[got["db"].idxmax(), "f"] - 2.0) < 0.3 and got["db"].max() - got["db"].median() > 15


def test_clamped_windows_of_the_adaptive_threshold(spark):
    rng = np.random.default_rng(3)
    t, f = 10.0 * np.arange(200), rng.f(20, 60, 200)
    beams = spark.createDataFrame(pd.DataFrame({"array_id": "A", "t": t, "f_stat": f}))
    got = detection.adaptive_threshold(beams, ["array_id"], "t", "f_stat", 500.0, 0.05, 20.0, 4).toPandas().sort_values("t")
    for i in range(200):
        lo = min(max(t[i] - 250, t[0]), t[-1] - 500)
        assert got["threshold"].iloc[i] == pytest.approx(numeric.detection_threshold(f[(t >= lo) & (t <= lo + 500)], 0.05, 20.0, 4))


def test_noise_threshold_is_that_of_the_rows(spark):
    f = np.random.default_rng(3).f(20, 60, 900)
    beams = spark.createDataFrame(pd.DataFrame({"array_id": "A", "t": np.arange(900.0), "f_stat": f}))
    got = detection.noise_threshold(beams, ["array_id"], "t", "f_stat", (0.0, 899.0), 0.01, 20.0, 4).first()["threshold"]
    assert got == pytest.approx(numeric.detection_threshold(f, 0.01, 20.0, 4), rel=0.02)


def test_background_threshold_of_known_levels():
    rng = np.random.default_rng(1)
    x = rng.normal(-40, 3, 4000)
    got, peak = numeric.background_threshold(x, 0.01)
    assert abs(got - (-40 + 2.326 * 3)) < 0.8 and abs(peak + 40) < 0.6
    burst = np.r_[x, np.full(400, 0.0)]
    assert numeric.background_threshold(burst, 0.01)[0] < -25  # a mean and deviation alone would give -8
    assert numeric.background_threshold(np.full(9, 2.0), 0.01) == (2.0, 2.0)
    assert numeric.skew_normal_quantile(0.975, 0.0, 1.0, 2.0) == pytest.approx(1 + 1.959964 * 2, abs=1e-3)


def test_clusters_by_chains_are_those_of_plain_merging():
    rng = np.random.default_rng(7)
    for how, update in numeric._LINKAGE.items():
        for _ in range(20):
            p = rng.random((12, 2))
            d = np.hypot(*(p[:, None] - p[None]).transpose(2, 0, 1))
            own, size, lab, alive = d + np.diag([np.inf] * 12), np.ones(12), np.arange(12), set(range(12))
            while len(alive) > 1:
                i, j = min(((i, j) for i in alive for j in alive if i < j), key=lambda x: own[x])
                if own[i, j] > 0.3:
                    break
                row = update(own[i], own[j], size[i], size[j])
                own[i], own[:, i] = row, row
                own[i, i] = np.inf
                lab[lab == lab[j]] = lab[i]
                size[i] += size[j]
                alive.remove(j)
            got = numeric.cut_linkage(d, 0.3, how)
            assert len(set(zip(got, lab))) == len(set(got)) == len(set(lab))


def test_smoothing_keeps_cubics_and_wavelets_find_tones():
    x = np.arange(120.0)
    y = 1 + 0.2 * x - 0.01 * x**2 + 1e-4 * x**3
    assert np.allclose(numeric.smoothed(y), y)
    t = np.arange(2000) / 100
    f = np.geomspace(1, 20, 40)
    power = numeric.wavelet_power(np.sin(2 * np.pi * 5 * t), 0.01, f)[:, 600:1400].mean(axis=1)
    assert abs(f[np.argmax(power)] - 5) < 0.5
    _, g, z = numeric.stft(np.sin(2 * np.pi * 5 * t), 0.01, 200)
    assert g[np.argmax(np.abs(z[5]))] == 5.0 and np.abs(z[5]).max() == pytest.approx(0.5, abs=1e-6)


def test_source_counts_grid_peaks_and_rolled_beams():
    rng = np.random.default_rng(0)
    m, n, k = 7, 400, 2
    mix = rng.standard_normal((m, k)) * 2
    x = mix @ rng.standard_normal((k, n)) + rng.standard_normal((m, n))
    values = np.linalg.eigvalsh(x @ x.T / n)
    for how in ("aic", "mdl"):
        got, best = numeric.model_order(values, how, n)
        assert best == k
        for q in range(m):
            tail = np.sort(values)[: m - q]
            likelihood = n * (np.log(tail).sum() - (m - q) * np.log(tail.mean()))
            free = q * (2 * m - q)
            assert got[q] == pytest.approx(-2 * likelihood + 2 * free if how == "aic" else -likelihood + 0.5 * free * np.log(n))
    g = np.zeros((9, 9))
    g[2, 3], g[6, 6], g[6, 7] = 5, 7, 6
    assert numeric.grid_peaks(g, 3, 2) == [(6, 6, 7.0), (2, 3, 5.0)]
    rng = np.random.default_rng(2)
    s = rng.standard_normal(400)
    geometry = np.array([[0.0, 0.0], [1.0, 0.0], [0.0, 2.0]])
    x = np.stack([np.roll(s, -int(k)) for k in np.rint(geometry @ (np.sin(np.radians(30)), np.cos(np.radians(30))) * 3.0 * 20)])
    assert np.allclose(numeric.rolled_beam(x, 20.0, 30.0, 3.0, geometry), s[None])
    rolled, c = numeric.correlation_beam(x)
    assert np.corrcoef(rolled)[0, 1:].min() > 0.99 and c.min() > 0.7
    assert numeric.fisher_and_correlations(np.stack([s, s + 0.1 * rng.standard_normal(400)]))[0] > 50


def test_many_detections_of_one_key_merge_as_one_group_would(spark):
    rng = np.random.default_rng(12)
    t = np.cumsum(rng.exponential(60, 400))
    rows = [("A", i, float(t[i]), float(rng.random()), float(rng.choice([10.0, 100.0])), 0.0, -float(rng.integers(1, 20)), float(rng.integers(1, 20))) for i in range(400)]
    df = spark.createDataFrame(rows, "array_id string, run long, t double, f_stat double, back_az double, trace_vel double, start double, end double")
    got = sorted((r["t"], r["start"], r["end"]) for r in windows.merge_detections(df, ["array_id"], "t", "f_stat", "back_az", 15.0).collect())
    own, changed = [dict(zip(("t", "f", "az", "start", "end"), (r[2], r[3], r[4], r[6], r[7]))) for r in rows], True
    while changed:
        changed, out = False, []
        for r in own:
            a = out[-1] if out else None
            if a and abs(r["az"] - a["az"]) < 15 and r["t"] + r["start"] - a["t"] - a["end"] < max(a["end"] - a["start"], r["end"] - r["start"]):
                lo, hi = min(a["t"] + a["start"], r["t"] + r["start"]), max(a["t"] + a["end"], r["t"] + r["end"])
                best = dict(r if r["f"] > a["f"] else a)
                best["start"], best["end"] = lo - best["t"], hi - best["t"]
                out[-1], changed = best, True
            else:
                out.append(r)
        own = out
    expected = sorted((r["t"], r["start"], r["end"]) for r in own)
    assert len(got) == len(expected) < 390 and np.allclose(got, expected)
