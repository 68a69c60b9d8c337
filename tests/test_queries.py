"""Every registered query runs on the smallest tables; those with SQL agree with DuckDB."""

import math
import os

import pytest

from sondera.plans import registry

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {"sd_detections", "hjl_clusters", "bisl_grid_posterior"}  # covered by tests of their operators


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if os.path.exists(f"{D}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return con


def plain(df):
    def one(v):
        if v is None or v is not v:
            return "-"
        if isinstance(v, float):
            return f"{round(v, 6) + 0.0:.6f}" if math.isfinite(v) else str(v)
        return v.isoformat() if hasattr(v, "isoformat") else str(v)

    return sorted(tuple(map(one, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - SLOW))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, D).toPandas()
    if name in registry.ORACLE_SQL:
        expected = duck.execute(registry.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(expected.columns)
        assert plain(got) == plain(expected)
    else:
        assert len(got)


def test_entry_lists_all():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert set(registry.QUERIES) <= names and set(entry.oracle_sql()) <= names


def test_band_join_is_an_equi_join(spark):
    from sondera.operators.relational import band_join

    p = spark.createDataFrame([("a", 1.0), ("a", 9.0), ("b", 5.0)], "k string, t double")
    s = spark.createDataFrame([("a", 0, 0.0, 5.0), ("a", 1, 4.0, 40.0), ("b", 2, 6.0, 5.0)], "k string, id int, lo double, hi double")
    out = band_join(p, s, ["k"], "t", "lo", "hi", 3.0)
    assert sorted((r["t"], r["id"]) for r in out.collect()) == [(1.0, 0), (9.0, 1)]
    assert "NestedLoop" not in out._jdf.queryExecution().toString()


def test_geodesy_agrees_with_known_values(spark):
    """St. Louis to Yaounde, the Galapagos and Los Alamos, and other published values."""
    from pyspark.sql import functions as F

    from sondera.functions import geodesy as g

    row = spark.range(1)
    arc = [row.select(g.haversine(38.649, -90.305, *to)).first()[0] for to in ((3.861, 11.521), (-0.823, -91.097), (35.891, -106.298))]
    assert arc == pytest.approx([96.75578437, 39.47872366, 13.00431661], abs=1e-7)
    assert list(row.select(*g.spherical_inv(38.649, -90.305, 3.861, 11.521)).first()) == pytest.approx([96.75578437, 79.53972827, 309.66814964], abs=1e-6)
    assert list(row.select(*g.spherical_fwd(38.649, -90.305, 45, -30)).first()) == pytest.approx([66.90805234, -154.65352366, 95.35931627], abs=1e-6)
    assert [row.select(g.azdiff(*x)).first()[0] for x in ((340, 20), (20, 340), (180, -180), (540, -180))] == [40, -40, 0, 0]
    assert [row.select(g.lonmod(x)).first()[0] for x in (181, 180, -180, -181, 360, 540, -540)] == [-179, 180, -180, 179, 0, 180, -180]
    assert list(row.select(*g.fixlatlon(100, 0)).first()) == [80, 180] and list(row.select(*g.fixlatlon(-5, 315)).first()) == [-5, -45]
    assert row.select(g.earth_radius(38.649)).first()[0] == pytest.approx(6369.83836784, abs=1e-6)
    assert row.select(g.geocentric_to_geographic(45)).first()[0] == pytest.approx(45.19242322, abs=1e-7)
    for lo, hi, x in ((-10, 10, 360), (170, 190, -180), (-190, -170, 180), (350, 370, 0), (0, 0, 360), (0, 360, 0)):
        assert row.select(g.inlonrng(lo, hi, x)).first()[0]
    p = lambda la, lo: (F.lit(float(la)), F.lit(float(lo)))
    cross = row.select(g.gcarc_intersect(p(0, 0), p(0, 10), p(-5, 5), p(5, 5)).alias("x")).first()["x"]
    assert (cross["lat"], cross["lon"]) == pytest.approx((0, 5), abs=1e-9)
    assert row.select(g.gcarc_intersect(p(0, 0), p(0, 10), p(0, 5), p(0, 15)).alias("x")).first()["x"] is None
    assert row.select(g.gcarc_intersect(p(0, 0), p(0, 10), p(0, 0), p(10, 0)).alias("x")).first()["x"] is None


def test_detection_files_round_trip(spark, tmp_path):
    import json

    from sondera.sources import detections as s

    new = {"Name": "a", "Time (UTC)": "2010-01-01T12:07:29.773", "F Stat.": 9.123456, "Trace Vel. (m/s)": None, "Back Azimuth": 12.345, "Latitude": 40.0, "Longitude": -112.0, "Array Dim.": 4, "Elevation (m)": -999.0}
    old = {"Name": "b", "Peak F-Stat Time (UTC)": "9999-01-02T00:00:00", "F Statistic": 5, "Trace Velocity (m/s)": 340.0, "Latitude": 41.0, "Longitude": -110.0, "Array Dimension": 6, "Start": -3, "End": 4.5}
    (tmp_path / "d.json").write_text(json.dumps([new, old]))
    got = {r["name"]: r for r in s.read_detections(spark, str(tmp_path / "d.json")).collect()}
    assert got["a"]["f_stat"] == 9.123456 and got["a"]["array_dim"] == 4 and got["a"]["elevation"] is None
    assert got["b"]["time"] is None and got["b"]["trace_vel"] == 340.0 and got["b"]["start"] == -3.0
    s.write_detections(s.define_detection(s.read_detections(spark, str(tmp_path / "d.json"))), str(tmp_path / "out"), by="name")
    (tmp_path / "t.dat").write_text("# lat lon time az F n\n\n40.0 -112.0 2010-01-01T12:00:00 15.5 8.2 4\n")
    row = s.read_ascii_detections(spark, str(tmp_path / "t.dat")).first()
    assert (row["latitude"], row["back_az"], row["array_dim"]) == (40.0, 15.5, 4)
    (tmp_path / "bad.json").write_text(json.dumps([{"Latitude": 99.0, "Longitude": 0.0}]))
    with pytest.raises(Exception, match="out of range"):
        s.read_detections(spark, str(tmp_path / "bad.json")).collect()
