"""Pair integrals, clusters in rounds, and association batch by batch."""

import numpy as np
import pytest

from sondera.functions import numeric, physics
from sondera.functions.geodesy import SPHERE_KM
from sondera.operators import association

MIXTURE = (physics.RCEL_WEIGHTS, physics.RCEL_MEANS, physics.RCEL_SDS)
DETS = "id long, lat double, lon double, t double, az double, f_stat double, channels int"


def test_the_nested_rule_is_exact_for_polynomials():
    x, kronrod, gauss = numeric.nested_rule()
    assert len(x) == 15 and (gauss > 0).sum() == 7
    for k in range(24):
        want = 0.0 if k % 2 else 2 / (k + 1)
        assert abs((kronrod * x**k).sum() - want) < 1e-14
        assert k > 13 or abs((gauss * x**k).sum() - want) < 1e-14


def discs():
    """Pairs with wide and narrow beams; arrays far from the disc, at its edge and inside; one array twice."""
    rng = np.random.default_rng(2)
    n = 12
    a = {"lat": rng.uniform(30, 45, n), "lon": rng.uniform(-120, -105, n), "az": rng.uniform(0, 360, n), "t": np.zeros(n), "kappa": rng.uniform(8, 71, n)}
    b = {"lat": rng.uniform(30, 45, n), "lon": rng.uniform(-120, -105, n), "az": rng.uniform(0, 360, n), "t": rng.uniform(-900, 900, n), "kappa": rng.uniform(8, 71, n)}
    centre = {"lat": rng.uniform(34, 41, n), "lon": rng.uniform(-116, -109, n), "radius": rng.uniform(100, 500, n)}
    for k in range(n):  # beams that look at the disc, and two arrays in or at it
        for d in (a, b):
            az, km = numeric._azimuth_and_km(d["lat"][k], d["lon"][k], centre["lat"][k], centre["lon"][k], SPHERE_KM)
            d["az"][k] = np.degrees(az) + rng.normal(0, 5)
            d["t"][k] += km / 0.28
    a["lat"][0], a["lon"][0] = centre["lat"][0] + 0.3, centre["lon"][0]
    a["lat"][1], a["lon"][1] = centre["lat"][1] + np.degrees(centre["radius"][1] / SPHERE_KM), centre["lon"][1]
    flat = np.zeros(n, bool)
    for d in ("lat", "lon"):
        b[d][2] = centre[d][2] = a[d][2]
    b["az"][2], b["t"][2], centre["radius"][2], flat[2] = a["az"][2] + 4, a["t"][2] + 30, 1500.0, True
    return a, b, centre, flat


def test_pair_integrals_are_within_their_tolerance():
    a, b, centre, flat = discs()
    value, error = numeric.disc_integrals(a, b, centre, flat, SPHERE_KM, MIXTURE)
    u, w = np.polynomial.legendre.leggauss(400)
    dense = np.zeros(len(flat))
    for k in range(len(flat)):
        of, turn = np.array([k]), 2 * np.pi * np.arange(3000) / 3000
        km = centre["radius"][k] * (u + 1) / 2
        f = numeric._pair_density(a, b, centre, flat, of, km[None, :, None], turn[None, None, :], SPHERE_KM, MIXTURE)
        dense[k] = (f[0] * w[:, None]).sum() * centre["radius"][k] / 2 * 2 * np.pi / 3000
    worst = int(np.argmax(np.abs(value / dense - 1)))
    assert abs(value[worst] / dense[worst] - 1) < 1e-4, (worst, value[worst], dense[worst])
    assert (error <= 1e-4).all() and (dense > 0).all()
    none = numeric.disc_integrals(a, b, {**centre, "radius": np.full(len(flat), np.nan)}, flat, SPHERE_KM, MIXTURE)
    assert np.isnan(none[0]).all()
    rough, bound = numeric.disc_integrals(a, b, centre, flat, SPHERE_KM, MIXTURE, rounds=0)
    assert bound.max() > 1e-4 and (np.abs(rough / dense - 1) <= bound + 1e-12).all()


def near_points(n, seed, most=8.0):
    """Pairs of points of the plane that are nearer than ``most``."""
    p = np.random.default_rng(seed).uniform(0, 2.6 * n**0.5, (n, 2))
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(axis=2))
    return np.minimum(d, most), [(int(i), int(j), float(d[i, j])) for i, j in zip(*np.nonzero(np.triu(d < most, 1)))]


def same(labels, other):
    return all(len({(a, b) for a, b in zip(labels, other)}) == len(set(x)) for x in (labels, other))


@pytest.mark.parametrize("linkage", ["weighted", "average", "complete", "single"])
def test_clusters_in_rounds_are_those_of_one_matrix(spark, linkage):
    n, cut = 2000 if linkage == "weighted" else 60, 4.0
    d, pairs = near_points(n, 3)
    got = {r["node"]: r["cluster"] for r in association.merged_clusters(spark.createDataFrame(pairs, "u long, v long, d double"), cut, linkage).collect()}
    assert same([got.get(i, i) for i in range(n)], numeric.cut_linkage(d, cut, linkage).tolist())


def test_large_components_are_divided_before_they_are_clustered(spark):
    d, pairs = near_points(60, 5)
    members = spark.createDataFrame([(w, i) for w in (0, 1) for i in range(60)], "win long, id long")
    dist = spark.createDataFrame(pairs, "id_a long, id_b long, dist double")
    whole, parts = (sorted(map(tuple, association.cluster_windows(members, dist, 4.0, trim=99.0, large=n).collect())) for n in (2000, 6))
    assert whole == parts and len(whole) > 20


def detections(spark):
    """Three events seen from four places, each detection with a doubtful companion, over some hours."""
    rng = np.random.default_rng(8)
    places = [(40.0, -112.0), (35.0, -110.0), (36.0, -120.0), (42.0, -118.0)]
    rows = []
    for k, (source, t0) in enumerate((((38.0, -115.0), 10_000.0), ((39.5, -116.5), 16_000.0), ((37.0, -113.0), 31_000.0), ((38.4, -114.2), 52_000.0))):
        for s, p in enumerate(places):
            az, km = numeric._azimuth_and_km(*p, *source, SPHERE_KM)
            rows.append((10 * k + s, *p, float(t0 + km / 0.29), float(np.degrees(az)), 12.0, 4))
            rows.append((10 * k + 5 + s, *p, float(t0 + rng.uniform(-3000, 6000)), float(rng.uniform(0, 360)), 8.0, 4))
    return spark.createDataFrame(rows, DETS).orderBy("t")


def groups(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["event_id"], set()).add(r["id"])
    return out


def test_batches_end_in_the_events_of_one_run(spark, tmp_path):
    dets = detections(spark)
    origin, rng_max = 0.0, 1500.0
    want = groups(association.run_assoc(dets, rng_max=rng_max, origin=origin))
    assert len(want) >= 4
    cuts = [None, 14_000.0, 33_000.0, None]
    seen = []
    for k in range(3):
        part = dets
        part = part if cuts[k] is None else part.where(f"t >= {cuts[k]}")
        part = part if cuts[k + 1] is None else part.where(f"t < {cuts[k + 1]}")
        part = part.unionByName(dets.where(f"t < {cuts[k]}").limit(2)) if cuts[k] else part  # told again: they are known
        seen.append(groups(association.run_assoc_batch(spark, part, str(tmp_path), k, origin, rng_max=rng_max)))
    key = lambda g: sorted(map(sorted, g.values()))
    assert key(seen[-1]) == key(want)
    for before, after in zip(seen, seen[1:]):
        for number, ids in before.items():
            assert number in after and after[number] & ids
    again = groups(association.run_assoc_batch(spark, dets.limit(0), str(tmp_path), 2, origin, rng_max=rng_max))
    assert again == seen[-1]  # the batch was there
    assert groups(association.run_assoc_batch(spark, dets.limit(0), str(tmp_path), 3, origin, rng_max=rng_max)) == seen[-1]
    assert sum(1 for _ in tmp_path.glob("pairs/batch=*")) == 4
