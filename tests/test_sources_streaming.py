"""SAC and beam text round trips; a stream's runs equal the batch's."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F


def sac_bytes(samples, order="<"):
    f, i = [-12345.0] * 70, [-12345] * 40
    f[0], f[5], f[31], f[32] = 0.05, 0.5, 40.0, -112.0
    i[0:6], i[6], i[9] = [2010, 32, 1, 2, 3, 250], 6, len(samples)
    text = b"STA1".ljust(8) + b"-12345".ljust(16) + b"-12345  " * 17 + b"BDF".ljust(8) + b"IM".ljust(8) + b"-12345  " * 2
    return struct.pack(f"{order}70f", *f) + struct.pack(f"{order}40i", *i) + text[:192].ljust(192) + struct.pack(f"{order}{len(samples)}f", *samples)


@pytest.mark.parametrize("order", ["<", ">"])
def test_sac(spark, tmp_path, order):
    from sondera.sources.sac import SacSource, read_sac

    x = np.arange(50, dtype=float).tolist()
    (tmp_path / "a.sac").write_bytes(sac_bytes(x, order))
    spark.dataSource.register(SacSource)
    for df in (read_sac(spark, str(tmp_path)), spark.read.format("sac").load(str(tmp_path / "*.sac"))):
        row = df.first()
        assert row["station"] == "STA1" and row["samples"] == x and row["fs"] == pytest.approx(20.0)
        assert row["t0"] == pytest.approx(1264986123.25 + 0.5) and row["lat"] == 40.0 and row["location"] is None


def test_beam_text(spark, tmp_path):
    from sondera.sources import beams

    (tmp_path / "x.dat").write_text("# t0: 2012-04-09T18:00:00\n# Channel cnt: 4\n0.0 -41.8 370.1 31.9\n5.0 -42 368 20\n")
    rows = beams.read_beams(spark, str(tmp_path / "x.dat")).orderBy("t").collect()
    assert [r["f_stat"] for r in rows] == [31.9, 20.0]
    head = {r["key"]: r["value"] for r in beams.read_beam_header(spark, str(tmp_path / "x.dat")).collect()}
    assert head == {"t0": "2012-04-09T18:00:00", "channel_cnt": "4"}
    beams.write_beams(beams.read_beams(spark, str(tmp_path / "x.dat")), str(tmp_path / "out"))
    with pytest.raises(Exception, match="exists"):
        beams.write_beams(beams.read_beams(spark, str(tmp_path / "x.dat")), str(tmp_path / "out"))


def test_stream_runs_equal_batch_runs(spark, tmp_path):
    from sondera.operators.windows import runs
    from sondera.streaming.runs import stream_runs

    rng = np.random.default_rng(3)
    rows = [(s, float(10 * i), float(rng.random())) for s in ("a", "b") for i in range(60)]
    schema = "sta string, t double, f double"
    for part in range(3):
        spark.createDataFrame([r for r in rows if part * 200 <= r[1] < part * 200 + 200], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream_runs(stream, 0.4, 2, 15.0).writeStream.format("memory").queryName("found_runs").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        got = sorted(tuple(r) for r in spark.table("found_runs").select("sta", "first", "last", "n_rows").collect())
    finally:
        q.stop()
    df = spark.createDataFrame(rows, schema).withColumn("hit", F.col("f") > 0.4)
    g = runs(df, ["sta"], "t", "hit", 2, include_last=True).groupBy("sta", "run").agg(F.min("t").alias("a"), F.max("t").alias("b"), F.count(F.lit(1)).alias("n")).collect()
    closed = sorted((r["sta"], r["a"], r["b"], r["n"]) for r in g if r["b"] < 590.0)
    assert got == closed
