"""Filters of whole records, whatever segments they come in."""

import numpy as np
import pytest

from sondera.functions import filters
from sondera.operators import records

SCHEMA = "array_id string, channel string, t0 double, fs double, calib double, dx double, dy double, samples array<double>"


@pytest.mark.parametrize("order", [1, 2, 3, 4, 7])
@pytest.mark.parametrize("band", [(None, 3.0), (0.5, None), (0.5, 5.0), (0.02, 0.08)])
def test_response_is_that_of_the_closed_form(order, band):
    fs, (low, high) = 50.0, band
    f = np.linspace(0.01, 24.9, 400)
    w = lambda x: np.tan(np.pi * x / fs)
    if low and high:
        ratio = (w(f) ** 2 - w(low) * w(high)) / (w(f) * (w(high) - w(low)))
    else:
        ratio = w(f) / w(high) if high else w(low) / w(f)
    got = np.abs(filters.response(filters.sections(fs, low, high, order), f, fs)) ** 2
    assert np.allclose(got, 1 / (1 + ratio ** (2 * order)), atol=1e-9)


def test_corners_are_checked():
    for low, high in ((None, None), (1.0, 30.0), (26.0, None)):
        with pytest.raises(ValueError):
            filters.sections(50.0, low, high, 2)


def sample_by_sample(sos, x):
    for b0, b1, b2, a1, a2 in sos:
        y, s, t = np.zeros_like(x), 0.0, 0.0
        for i, v in enumerate(x):
            u = b0 * v + s
            s, t = b1 * v - a1 * u + t, b2 * v - a2 * u
            y[i] = u
        x = y
    return x


def test_states_carry_the_filter_over():
    sos = filters.sections(50.0, 0.4, 6.0, 3)
    system = filters.System(sos)
    x = np.random.default_rng(0).standard_normal(1500)
    want = sample_by_sample(sos, x)
    a, state = system.run(x[:401])
    b, _ = system.run(x[401:], state)
    assert np.allclose(np.r_[a, b], want, atol=1e-11)
    parts = [x[:401], x[600:601], x[601:]]
    x[401:600] = 0
    whole = system.joined(system.joined(system.stretch(parts[0]), 199, system.stretch(parts[1])), 0, system.stretch(parts[2]))
    assert whole[0] == 1500 and all(np.allclose(p, q, atol=1e-11) for p, q in zip(whole[1:], system.stretch(x)[1:], strict=True))


def record(rng, n, gaps):
    """Samples with a trend, and which of them are there."""
    x = rng.standard_normal(n).cumsum() * 0.1 + 40 + 0.002 * np.arange(n)
    there = np.ones(n, bool)
    for a, b in gaps:
        there[a:b] = False
    return x, there


def cut_up(x, there, borders, t0, fs, calib, channel):
    out = []
    edges = sorted({0, len(x), *borders, *(np.flatnonzero(np.diff(there)) + 1).tolist()})
    for a, b in zip(edges, edges[1:]):
        if there[a]:
            out.append(("A", channel, t0 + a / fs, fs, calib, 0.0, 0.0, (x[a:b] / (calib or 1.0)).tolist()))
    return out


def expected(x, there, fs, low, high, order, decimate, zero_phase):
    i = np.arange(len(x))
    fit = np.polyfit(i[there], x[there], 1)
    level = np.where(there, x - np.polyval(fit, i), 0.0)
    sos = filters.sections(fs, low, high, order)
    y = sample_by_sample(sos, level)
    y = sample_by_sample(sos, y[::-1])[::-1] if zero_phase else y
    return {int(k): y[k] for k in i[there] if k % decimate == 0}


@pytest.mark.parametrize("low, high, order, decimate, zero_phase, block", [(0.5, 3.0, 3, 1, True, 345_600.0), (None, 4.0, 4, 5, True, 10.0), (0.2, None, 2, 3, False, 3.0)])
def test_segments_filter_as_their_merged_record(spark, low, high, order, decimate, zero_phase, block):
    rng = np.random.default_rng(1)
    fs, t0 = 20.0, 1.6e9
    rows, want = [], {}
    for channel, n, gaps, borders, calib in (("a", 1200, [(300, 340), (900, 1100)], [1, 2, 77, 500, 640, 1150], 2.0), ("b", 700, [], [], None), ("c", 700, [], rng.integers(1, 700, 40).tolist(), 1.0)):
        x, there = record(rng, n, gaps)
        rows += cut_up(x, there, borders, t0, fs, calib, channel)
        want[channel] = expected(x, there, fs, low, high, order, decimate, zero_phase)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    out = records.filtered(df, low, high, order, decimate, zero_phase, block)
    assert out.columns == df.columns
    got = {c: {} for c in want}
    for r in out.collect():
        assert r["fs"] == fs / decimate and r["calib"] == 1.0 and len(r["samples"])
        i0 = round((r["t0"] - t0) * fs)
        for k, y in enumerate(r["samples"]):
            got[r["channel"]][i0 + k * decimate] = y
    for c, y in want.items():
        assert sorted(got[c]) == sorted(y)
        assert max(abs(got[c][k] - y[k]) for k in y) < 1e-9


def test_no_segments(spark):
    assert records.filtered(spark.createDataFrame([], SCHEMA), 0.5, 3.0).collect() == []
