"""Locations on the refined polar grid against dense sums."""

import numpy as np
import pytest

from sondera.functions import physics, posterior
from sondera.functions.geodesy import SPHERE_KM
from sondera.functions.numeric import _azimuth_and_km
from sondera.operators import location

MIXTURE = (physics.RCEL_WEIGHTS, physics.RCEL_MEANS, physics.RCEL_SDS)
PLACES = ((40.0, -112.0), (36.5, -118.0), (41.0, -117.5), (35.0, -113.0))
CENTRE, RADIUS = (38.3, -115.4), 500.0


def detections(n, seed, times=True):
    rng = np.random.default_rng(seed)
    lat, lon = np.array(PLACES[:n]).T
    az, km = _azimuth_and_km(lat, lon, 38.0, -115.0, SPHERE_KM)
    widths = np.radians([8, 12, 16, 9][:n])
    t = 50_000 + km / np.array([0.3, 0.26, 0.29, 0.31])[:n]
    return {"lat": lat, "lon": lon, "t": t if times else np.full(n, np.nan), "az": np.degrees(az) % 360 + rng.normal(0, 3, n), "kappa": np.log(2) / (1 - np.cos(widths))}


def dense(dets, n):
    """Moments of a square grid of n by n by n nodes inside the region."""
    lo, hi = posterior.origin_span(dets, CENTRE, RADIUS, SPHERE_KM)
    size = np.degrees(RADIUS / SPHERE_KM)
    y, x = (g.ravel() for g in np.meshgrid(CENTRE[0] + np.linspace(-size, size, n), CENTRE[1] + np.linspace(-size, size, n) / np.cos(np.radians(CENTRE[0])), indexing="ij"))
    inside = (_azimuth_and_km(y, x, *CENTRE, SPHERE_KM)[1] <= RADIUS) * np.cos(np.radians(y))
    at, sums, times = np.arange(n * n), np.zeros(9), np.linspace(lo, hi, n) if np.isfinite(lo) else [np.nan]
    for t in times:
        p = posterior.density(dets, y, x, at, np.full(n * n, t), MIXTURE, SPHERE_KM) * inside
        b = t - lo
        sums += [p.sum(), *(float((p * v).sum()) for v in (y, x, y * y, x * x, x * y)), p.sum() * b, p.sum() * b * b, 1]
    m = sums / sums[0]
    deg = np.radians(1.0) * SPHERE_KM
    east = deg * np.cos(np.radians(m[1]))
    return {"lat": m[1], "lon": m[2], "t": lo + m[6], "sd_x": east * (m[4] - m[2] ** 2) ** 0.5, "sd_y": deg * (m[3] - m[1] ** 2) ** 0.5, "sd_t": (m[7] - m[6] ** 2) ** 0.5, "cov": deg * east * (m[5] - m[1] * m[2])}


@pytest.mark.parametrize("n", [2, 3, 4])
def test_refined_cells_sum_to_what_a_dense_grid_does(n):
    dets = detections(n, n)
    cells = posterior.refined(dets, CENTRE, RADIUS, MIXTURE, SPHERE_KM)
    mass, lat, lon, t, sd_x, sd_y, cov, sd_t, *_, count = posterior.summary(cells, 0.9, SPHERE_KM)
    want = dense(dets, 201)
    deg = np.radians(1.0) * SPHERE_KM
    assert count < 201**3 / 10 and mass > 0
    assert abs(lat - want["lat"]) * deg < 0.01 * want["sd_y"] and abs(lon - want["lon"]) * deg < 0.01 * want["sd_x"] and abs(t - want["t"]) < 0.01 * want["sd_t"]
    for got, name in ((sd_x, "sd_x"), (sd_y, "sd_y"), (sd_t, "sd_t")):
        assert got == pytest.approx(want[name], rel=0.01)
    assert abs(cov - want["cov"]) < 0.01 * want["sd_x"] * want["sd_y"]


def test_azimuths_alone_give_a_place():
    dets = detections(3, 1, times=False)
    cells = posterior.refined(dets, CENTRE, RADIUS, MIXTURE, SPHERE_KM)
    _, lat, lon, _, sd_x, sd_y, *_ = posterior.summary(cells, 0.9, SPHERE_KM)
    want = dense(dets, 401)
    assert (lat, lon) == (pytest.approx(want["lat"], abs=0.02), pytest.approx(want["lon"], abs=0.02))
    assert (sd_x, sd_y) == (pytest.approx(want["sd_x"], rel=0.01), pytest.approx(want["sd_y"], rel=0.01))


def test_the_bound_is_above_all_of_a_cell():
    rng = np.random.default_rng(5)
    dets = detections(4, 2)
    lat, lon, t = CENTRE[0] + rng.uniform(-4, 4, 300), CENTRE[1] + rng.uniform(-5, 5, 300), 50_000 + rng.uniform(-900, 900, 300)
    at, half, half_s = np.arange(300), rng.uniform(1, 60, 300), 40.0
    bound = posterior.density(dets, lat, lon, at, t, MIXTURE, SPHERE_KM, half, half_s)
    for _ in range(40):
        y, x = posterior._forward(0.0, 0.0, np.zeros(300), np.zeros(300)), None
        away, turn = half * rng.random(300), rng.uniform(0, 2 * np.pi, 300)
        pairs = [posterior._forward(a, o, np.array([r / SPHERE_KM]), np.array([z])) for a, o, r, z in zip(lat, lon, away, turn)]
        y, x = np.array([p[0][0] for p in pairs]), np.array([p[1][0] for p in pairs])
        assert (posterior.density(dets, y, x, at, t + rng.uniform(-half_s, half_s, 300), MIXTURE, SPHERE_KM) <= bound * (1 + 1e-9)).all()


def test_located_events(spark):
    rows = []
    for event, times in ((1, True), (2, False), (3, True)):
        d = detections(3 if event < 3 else 2, event, times)
        rows += [(event, float(a), float(o), float(t) if times else None, float(z), 9.0, 4) for a, o, t, z in zip(d["lat"], d["lon"], d["t"] + (0 if event < 3 else [0.0, 90_000.0]), d["az"])]
    members = spark.createDataFrame(rows, "event_id long, lat double, lon double, t double, az double, f_stat double, channels int")
    got = {r["event_id"]: r for r in location.run_loc(members).collect()}
    assert set(got) == {1, 2}  # no origin explains the third's arrivals
    square = location.run_loc(members.where("event_id = 1"), nodes=61, times=61).first()
    for c in ("lat_mean", "lon_mean"):
        assert got[1][c] == pytest.approx(square[c], abs=0.1)
    assert got[1]["t_lo"] < got[1]["t_mean"] < got[1]["t_hi"] and abs(got[1]["t_mean"] - square["t_mean"]) < 0.2 * square["sd_t"]
    assert got[2]["t_mean"] is None and got[2]["sd_x"] > 0
