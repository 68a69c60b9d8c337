"""Ordered operators over blocks of a hot key: the same results as over the whole key, and no task with all its rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sondera.operators import blocks, integrate, relational, windows


def brute_runs(mask, least):
    """First and last row of each run of the rows but the last."""
    flips = np.flatnonzero(np.diff([0, *map(int, mask[:-1]), 0]))
    return [(int(a), int(b) - 1) for a, b in zip(flips[0::2], flips[1::2]) if b - a >= least]


@pytest.mark.parametrize("block", [1.0, 7.0, 40.0, 1e6])
@pytest.mark.parametrize("share", [0.3, 0.7, 0.97])
def test_runs_do_not_depend_on_blocks(spark, block, share):
    rng = np.random.default_rng(int(block) + int(100 * share))
    rows, expected, with_last = [], [], []
    for key, n in enumerate([1, 2, 3, 60, 300, 41]):
        mask = (rng.random(n) < share).tolist()
        t = np.cumsum(rng.integers(1, 4, n))
        rows += [(key, int(t[i]), bool(m) if m or i % 2 else None, -5) for i, m in enumerate(mask)]
        for out, own in ((expected, mask), (with_last, [*mask, False])):
            out += [(key, int(t[a]), int(t[b]), b - a + 1, sum(own[i] and not own[i - 1] for i in range(1, a + 1)) + own[0]) for a, b in brute_runs(own, 3)]
    df = spark.createDataFrame(rows, "k int, t int, hit boolean, run int").repartition(3)
    for last, want in ((False, expected), (True, with_last)):
        got = windows.runs(df, ["k"], "t", "hit", 3, last, block).groupBy("k", "run").agg(F.min("t"), F.max("t"), F.count("t")).collect()
        assert sorted((r[0], r[2], r[3], r[4], r[1]) for r in got) == sorted(want)


@pytest.mark.parametrize("block", [3.0, 50.0, 1e6])
def test_nearest_rows_do_not_depend_on_blocks(spark, block):
    rng = np.random.default_rng(1)
    left = [(int(rng.integers(3)), float(rng.integers(0, 400)), i) for i in range(300)]
    right = list({(k, t): (k, t, i) for i, (k, t) in enumerate((int(rng.integers(2)), float(rng.integers(0, 60) * 7)) for _ in range(60))}.values())
    got = relational.asof_nearest(spark.createDataFrame(left, "k int, t double, i int"), spark.createDataFrame(right, "k int, t double, j int"), ["k"], "t", ["j"], block=block).collect()
    assert len(got) == 300
    for r in got:
        near = min(((abs(t - r["t"]), t, j) for k, t, j in right if k == r["k"]), default=(None, None, None))
        assert (r["near_t"], r["near_j"]) == near[1:]


@pytest.mark.parametrize("n", [1, 2, 9, 100, 101])
def test_integrals_do_not_depend_on_blocks(spark, n):
    x = np.linspace(2.0, 5.0, n)
    df = spark.createDataFrame([(1, float(v), float(np.sin(v))) for v in x], "k int, x double, y double").repartition(3)
    whole = integrate.simpson(df, ["k"], "x", "y").first()["integral"]
    assert integrate.simpson(df, ["k"], "x", "y", block=0.3).first()["integral"] == pytest.approx(whole, rel=1e-12)


@pytest.mark.parametrize("block", [100.0, 5000.0])
def test_merged_detections_do_not_depend_on_blocks(spark, block):
    rng = np.random.default_rng(12)
    t = np.cumsum(rng.exponential(60, 300))
    rows = [("AB"[i % 7 == 0], i, float(t[i]), float(rng.random()), float(rng.choice([10.0, 100.0])), 0.0, -float(rng.integers(1, 20)), float(rng.integers(1, 20))) for i in range(300)]
    df = spark.createDataFrame(rows, "array_id string, run long, t double, f_stat double, back_az double, trace_vel double, start double, end double")
    made = [sorted(map(tuple, windows.merge_detections(df, ["array_id"], "t", "f_stat", "back_az", 15.0, b).collect())) for b in (block, 1e9)]
    assert made[0] == made[1] and len(made[0]) < 290


def test_running_values(spark):
    rng = np.random.default_rng(2)
    v = rng.integers(-50, 50, 200).tolist()
    df = blocks.blocked(spark.createDataFrame([(0, i, x) for i, x in enumerate(v)], "k int, t int, v int"), "t", 9)
    outs = {"s": ("sum", F.col("v"), True), "b": ("sum", F.col("v"), False), "m": ("max", F.col("v"), False), "n": ("min", F.col("v"), True)}
    for r in blocks.running(df, ["k"], ["t"], outs).collect():
        i = r["t"]
        assert (r["s"], r["b"], r["n"]) == (sum(v[: i + 1]), sum(v[:i]), min(v[: i + 1])) and r["m"] == max(v[:i], default=None)


def test_no_task_holds_a_hot_array(spark):
    """One array, 60,000 rows in 40 blocks: the largest task that a window works on holds a few blocks of it."""
    n = 60_000
    df = spark.range(n, numPartitions=4).select(F.lit("A").alias("k"), (F.col("id") * 5.0).alias("t"), (F.col("id") % 97 != 0).alias("hit"))
    kept = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        out = windows.runs(df, ["k"], "t", "hit", 3, block=n * 5.0 / 40)
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == n - len(range(0, n, 97)) - (1 if (n - 1) % 97 else 0) and max(sizes) < n / 5
    finally:
        for c, v in kept.items():
            spark.conf.set(c, v)
