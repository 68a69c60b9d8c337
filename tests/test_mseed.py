"""miniSEED records built by hand, read back."""

import datetime
import struct

import numpy as np
import pytest

from sondera.sources import mseed, waveforms

T0 = datetime.datetime(2019, 12, 31, 23, 59, 58, 250_000, tzinfo=datetime.timezone.utc).timestamp()


def steim_words(diffs, encoding):
    """(code, word) of differences, as many to a word as fit."""
    forms = {10: [(4, 8, 1, None), (2, 16, 2, None), (1, 32, 3, None)], 11: [(7, 4, 3, 2), (6, 5, 3, 1), (5, 6, 3, 0), (4, 8, 1, None), (3, 10, 2, 3), (2, 15, 2, 2), (1, 30, 2, 1)]}[encoding]
    out, i = [], 0
    while i < len(diffs):
        for count, bits, code, top in forms:
            some = diffs[i : i + count]
            if len(some) == count and all(-(1 << bits - 1) <= d < 1 << bits - 1 for d in some):
                word = 0
                for d in some:
                    word = word << bits | d & (1 << bits) - 1
                out.append((code, word | (top or 0) << 30))
                i += count
                break
        else:
            raise AssertionError(diffs[i])
    return out


def record(x, before, t0, fs, id_, encoding, order, number=1, power=9, correction=0, activity=0, rate=None, micros=None):
    """One record of as many samples of ``x`` as fit: bytes, samples taken."""
    size, data = 1 << power, 64 if micros is None else 128
    if encoding in (10, 11):
        diffs = np.diff(x, prepend=before).tolist()
        words, n, frames = [], 0, (size - data) // 64
        room = frames * 15 - 2
        for code, word in steim_words(diffs, encoding):
            if len(words) == room:
                break
            words.append((code, word))
        count = {10: {1: lambda w: 4, 2: lambda w: 2, 3: lambda w: 1}, 11: {1: lambda w: 4, 2: lambda w: w >> 30, 3: lambda w: 5 + (w >> 30)}}[encoding]
        n = sum(count[c](w) for c, w in words)
        cells = [(0, int(x[0]) & 0xFFFFFFFF), (0, int(x[n - 1]) & 0xFFFFFFFF), *words]
        cells += [(0, 0)] * (frames * 15 - len(cells))
        body = b""
        for f in range(frames):
            own = cells[15 * f : 15 * f + 15]
            head = sum(c << 28 - 2 * k for k, (c, _) in enumerate(own))
            body += struct.pack(f"{order}16I", head, *[w for _, w in own])
    else:
        kind = mseed.PLAIN[encoding]
        n = min(len(x), (size - data) // int(kind[1]))
        body = np.asarray(x[:n]).astype(order + kind).tobytes()
    t = datetime.datetime.fromtimestamp(round(t0 * 1e4) / 1e4 - correction / 1e4, datetime.timezone.utc)
    factor, multiplier = rate or (int(fs), 1)
    net, sta, loc, cha = id_
    head = f"{number:06d}D ".encode() + sta.ljust(5).encode() + loc.ljust(2).encode() + cha.ljust(3).encode() + net.ljust(2).encode()
    head += struct.pack(f"{order}HHBBBxHHhhBBBBiHH", t.year, t.timetuple().tm_yday, t.hour, t.minute, t.second, t.microsecond // 100, n, factor, multiplier, activity, 0, 0, 1 + (micros is not None), correction, data, 48)
    head += struct.pack(f"{order}HHBBBx", 1000, 0 if micros is None else 56, encoding, order == ">", power)
    if micros is not None:
        head += struct.pack(f"{order}HHBbBB", 1001, 0, 100, micros, 0, (size - data) // 64)
    return (head.ljust(data, b"\0") + body).ljust(size, b"\0"), n


def file_of(x, t0, fs, id_, encoding, order, power=9, **more):
    out, i, before = b"", 0, 0
    while i < len(x):
        raw, n = record(x[i:], before, t0 + i / fs, fs, id_, encoding, order, i % 999_999, power, **more)
        out, i, before = out + raw, i + n, x[i + n - 1]
    return out


ID = ("XX", "STA1", "", "BDF")


@pytest.mark.parametrize("order", [">", "<"])
@pytest.mark.parametrize("encoding", [1, 3, 4, 5, 10, 11])
def test_round_trip(encoding, order):
    rng = np.random.default_rng(encoding)
    steps = rng.integers(-7, 8, 3000) * rng.choice([1, 1, 1, 3, 20, 900, 30_000 if encoding in (10, 11, 3) else 1, 3_000_000 if encoding in (3, 10) else 1], 3000)
    x = np.cumsum(steps) if encoding != 1 else rng.integers(-30_000, 30_000, 3000)
    x = x * 0.25 if encoding in (4, 5) else x
    raw = file_of(x, T0, 20.0, ID, encoding, order)
    (found,) = mseed.segments(raw)
    assert found[:4] == ("XX", "STA1", None, "BDF") and found[4] == pytest.approx(T0, abs=1e-6) and found[5] == 20.0
    assert found[-1] == x.astype(float).tolist()


def test_gaps_channels_and_disorder():
    x = np.arange(900) % 37
    a, b = file_of(x, T0, 20.0, ID, 11, ">"), file_of(x[:400], T0 + 45.0 + 3.0, 20.0, ID, 10, "<", power=8)
    other = file_of(x, T0, 40.0, ("XX", "STA2", "01", "HDF"), 3, ">", power=12)
    found = list(mseed.segments(b + other + a))
    assert [(f[1], f[2], round(f[4] - T0, 4), len(f[-1])) for f in found] == [("STA1", None, 0.0, 900), ("STA1", None, 48.0, 400), ("STA2", "01", 0.0, 900)]
    whole = list(mseed.segments(a + file_of(x, T0 + 45.0, 20.0, ID, 11, ">")))
    assert len(whole) == 1 and whole[0][-1] == [*x.tolist(), *x.tolist()]


def test_times_and_rates():
    x = np.arange(50)
    at = lambda **more: mseed.header(record(x, 0, T0, 20.0, ID, 3, ">", **more)[0], 0)
    assert at(correction=-1234).t0 == pytest.approx(T0, abs=1e-6)
    assert at(correction=5000, activity=2).t0 == pytest.approx(T0 - 0.5, abs=1e-6)  # already in the time
    assert at(micros=-37).t0 == pytest.approx(T0 - 37e-6, abs=1e-7)
    for rate, fs in (((20, 1), 20.0), ((-10, 1), 0.1), ((30, -4), 7.5), ((-10, -4), 1 / 40), ((5, 8), 40.0)):
        assert at(rate=rate).fs == pytest.approx(fs)


def test_damage_is_an_error():
    raw = bytearray(file_of(np.arange(3000) % 91, T0, 20.0, ID, 11, ">"))
    raw[64 + 80] ^= 1
    with pytest.raises(ValueError, match="differences lead to"):
        list(mseed.segments(bytes(raw)))
    with pytest.raises(ValueError, match="cut off"):
        list(mseed.segments(bytes(raw[:700])))
    with pytest.raises(ValueError, match="encoding 19"):
        list(mseed.segments(bytes(raw[:52]) + b"\x13" + bytes(raw[53:512])))


@pytest.fixture(scope="module")
def archive(tmp_path_factory):
    """Day files of two stations and three days, and a file with another kind of name."""
    folder = tmp_path_factory.mktemp("archive")
    x = np.cumsum(np.random.default_rng(3).integers(-50, 51, 6000))
    for sta in ("STA1", "STA2"):
        for day in (1, 2, 3):
            t = datetime.datetime(2020, 1, day, 5, tzinfo=datetime.timezone.utc).timestamp()
            (folder / f"XX.{sta}..BDF.D.2020.{day:03d}").write_bytes(file_of(x + day, t, 20.0, ("XX", sta, "", "BDF"), 11, ">"))
    early = T0 - 43_200
    (folder / "more.bin").write_bytes(file_of(x, early, 20.0, ("XX", "STA1", "", "BDF"), 10, "<") + file_of(x, early, 20.0, ("XX", "STA9", "", "BDF"), 10, "<"))
    return folder, x


def test_readers_agree_with_what_was_written(spark, archive):
    folder, x = archive
    mseed.register(spark)
    small = spark.read.format("mseed").option("rangeBytes", 1500).load(f"{folder}/*")
    assert small.rdd.getNumPartitions() > 20
    for df in (waveforms.waveforms(spark, files=f"{folder}/*"), spark.read.format("mseed").load(f"{folder}/*"), small):
        runs = {}
        for r in df.collect():
            runs.setdefault((r["station"], int(r["t0"] // 86400)), []).append((r["t0"], r["samples"]))
        assert len(runs) == 8, sorted(runs)
        for (sta, day), rows in runs.items():
            rows.sort()
            got = np.concatenate([s for _, s in rows])
            assert got.tolist() == (x + (day - 18261 if day > 18261 else 0)).tolist()
            assert all(abs(t + len(s) / 20.0 - u) < 1e-3 for (t, s), (u, _) in zip(rows, rows[1:]))


def test_filters_choose_the_files_that_are_opened(spark, archive, tmp_path):
    folder, x = archive
    mseed.register(spark)
    for f in folder.iterdir():
        f.rename(tmp_path / f.name) if False else (tmp_path / f.name).write_bytes(f.read_bytes())
    for f in tmp_path.iterdir():  # what must not be opened can not be
        if f.name.startswith("XX.STA2") or f.name.endswith(".003"):
            f.write_bytes(b"not a record at all " * 40)
    t = datetime.datetime(2020, 1, 2, 20, tzinfo=datetime.timezone.utc).timestamp()
    df = spark.read.format("mseed").load(f"{tmp_path}/*").where("station = 'STA1' AND network IN ('XX', 'YY')").where(f"t0 < {t} AND t0 >= {t - 86400}")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "station" not in plan.split("BatchScan")[0].replace("station#", "") and "t0" in plan
    assert df.rdd.getNumPartitions() == 3  # two day files and the one whose name says nothing
    assert [(r["station"], len(r["samples"])) for r in df.collect()] == [("STA1", 6000)]


def test_reader_counts_partitions():
    from pyspark.sql.datasource import EqualTo, GreaterThan

    reader = mseed.MseedReader("/nowhere/*", 1000)
    rest = list(reader.pushFilters([EqualTo(("station",), "A"), EqualTo(("station",), "B"), GreaterThan(("t0",), 5.0), EqualTo(("fs",), 1.0)]))
    assert len(rest) == 2 and not reader.wanted((None, "A", None, None)) and reader.after == 5.0
    assert [p.path for p in reader.partitions()] == [""] and list(reader.read(reader.partitions()[0])) == []


def test_a_file_of_many_descriptions_is_read_once(spark, tmp_path):
    n = 10_000
    (tmp_path / "a.w").write_bytes(np.arange(4 * n, dtype="<i4").tobytes())
    (tmp_path / "b.w").write_bytes(b"never opened")
    sites = spark.createDataFrame([("S1", "ARR", 40.0, -110.0, 1.0, 2019001, -1)], "sta string, refsta string, lat double, lon double, elev double, ondate int, offdate int")
    wfdisc = spark.range(n).selectExpr("'S1' sta", "'BDF' chan", "1.6e9D + id time", "1.6e9D + id + 0.75D endtime", "4 nsamp", "4.0D samprate", "1.0D calib", "'i4' datatype", "'a.w' dfile", "CAST(16 * id AS INT) foff")
    wfdisc = wfdisc.union(wfdisc.limit(1).selectExpr("sta", "'XXX' chan", "time", "endtime", "nsamp", "samprate", "calib", "datatype", "'b.w' dfile", "foff"))
    got = waveforms.catalog_segments(spark, sites, wfdisc, str(tmp_path), channel="BDF")
    assert [f.rpartition("/")[2] for f in got.inputFiles()] == ["a.w"]
    rows = got.collect()
    assert len(rows) == n and all(r["samples"] == [-1.5, -0.5, 0.5, 1.5] for r in rows)
    assert waveforms.catalog_segments(spark, sites, wfdisc, str(tmp_path), channel="none").collect() == []
    assert waveforms.catalog_segments(spark, sites, wfdisc, str(tmp_path), channel="BDF", named=0).count() == n
