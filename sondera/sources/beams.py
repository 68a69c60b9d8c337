"""Beam results as text: a commented header of parameters, then columns of time, azimuth, velocity and F."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_beams(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """source_file, t (seconds after the header's t0), back_az, trace_vel, f_stat of each row."""
    lines = spark.read.text(path).select(F.trim("value").alias("v"), F.input_file_name().alias("source_file"))
    p = F.split("v", r"\s+")
    rows = lines.where((F.col("v") != "") & ~F.col("v").startswith("#")).withColumn("p", p)
    return rows.select("source_file", *[F.try_element_at("p", F.lit(i + 1)).cast("double").alias(n) for i, n in enumerate(("t", "back_az", "trace_vel", "f_stat"))])


def read_beam_header(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """source_file, key, value of each ``# key: value`` line."""
    lines = spark.read.text(path).select(F.trim("value").alias("v"), F.input_file_name().alias("source_file"))
    head = lines.where(F.col("v").startswith("#") & F.col("v").contains(":"))
    key = F.trim(F.regexp_extract("v", r"^#\s*([^:]+):", 1))
    return head.select("source_file", F.regexp_replace(F.lower(key), r"[^a-z0-9]+", "_").alias("key"), F.trim(F.regexp_extract("v", r":\s*(.*)$", 1)).alias("value"))


def write_beams(df: DataFrame, path: str) -> None:
    """Beam rows as whitespace columns; never overwrites."""
    line = F.format_string("%.3f %.4f %.4f %.6f", "t", "back_az", "trace_vel", "f_stat")
    df.select(line.alias("value")).write.mode("errorifexists").text(path)


def header_lines(segments: DataFrame, beam, station: tuple[float, float] | None = None) -> list[str]:
    """The commented header of one array's beam results: what its channels cover, the place, and the run's parameters."""
    ends = segments.groupBy("channel").agg(F.min("t0").alias("t0"), F.max(F.col("t0") + (F.size("samples") - 1) / F.col("fs")).alias("t1"))
    stamp = lambda c: F.date_format(F.timestamp_micros(F.round(F.col(c) * 1e6).cast("long")), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    rows = ends.select("channel", stamp("t0").alias("a"), stamp("t1").alias("b")).orderBy("channel").limit(1000).collect()
    lines = ["beam results", "", "data summary"] + [f"  {r['channel']}\t{r['a']} - {r['b']}" for r in rows]
    lines += ["", f"  channel_cnt: {len(rows)}", f"  t0: {rows[0]['a'] if rows else None}"]
    if station:
        lines += [f"  latitude: {station[0]}", f"  longitude: {station[1]}"]
    lines += ["", "algorithm parameters", f"  freq_min: {beam.freq[0]}", f"  freq_max: {beam.freq[1]}"]
    lines += [f"  {n}_{k}: {v}" for n, axis in (("back_az", beam.az), ("trace_vel", beam.vel)) for k, v in zip(("min", "max", "step"), axis, strict=True)]
    lines += [f"  method: {beam.method}", f"  signal_start: {beam.span and beam.span[0]}", f"  signal_end: {beam.span and beam.span[1]}"]
    if beam.noise:
        lines += [f"  noise_start: {beam.noise[0]}", f"  noise_end: {beam.noise[1]}"]
    return lines + [f"  window_len: {beam.length}", f"  sub_window_len: {beam.sub_length}", f"  window_step: {beam.step}", "", "time (relative to t0) [s], back azimuth [deg], trace velocity [m/s], F"]


def write_beams_with_header(rows: DataFrame, header: list[str], path: str, run: str) -> None:
    """Beam rows of one run in a folder of their own, ``path``/run=<run>: the header as ``part 0``, then the rows in order of time; never overwrites."""
    spark = rows.sparkSession
    head = spark.createDataFrame([(float(i) - 1e18, f"# {x}".rstrip()) for i, x in enumerate(header)], "at double, value string")
    line = F.format_string("%.3f %.4f %.4f %.6f", "t", "back_az", "trace_vel", "f_stat")
    both = head.unionByName(rows.select(F.col("t").alias("at"), line.alias("value")))
    both.orderBy("at").select("value").write.mode("errorifexists").text(f"{path}/run={run}")
