"""Detection files: JSON in two dialects, whitespace tables, and the writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: column -> (type, keys in files; the first that is present counts). Fixed names of the file formats.
FIELDS = {
    "name": ("string", "Name"),
    "time": ("string", "Time (UTC)", "Peak F-Stat Time (UTC)"),
    "f_stat": ("double", "F Stat.", "F Statistic"),
    "trace_vel": ("double", "Trace Vel. (m/s)", "Trace Velocity (m/s)"),
    "back_az": ("double", "Back Azimuth"),
    "latitude": ("double", "Latitude"),
    "longitude": ("double", "Longitude"),
    "elevation": ("double", "Elevation (m)", "Elevation"),
    "start": ("double", "Start"),
    "end": ("double", "End"),
    "freq_range": ("array<double>", "Freq Range"),
    "array_dim": ("int", "Array Dim.", "Array Dimension"),
    "method": ("string", "Method"),
    "event": ("string", "Event"),
    "note": ("string", "Note"),
    "network": ("string", "Network"),
    "station": ("string", "Station"),
    "channel": ("string", "Channel"),
}
_KEYS = ", ".join(f"`{k}` {v[0]}" for v in FIELDS.values() for k in v[1:])
#: Numbers that stand for "missing" in files and tables.
SENTINELS = (-999.0, -9999999999.999)


def _first(record: Column, keys: tuple[str, ...]) -> Column:
    return F.coalesce(*[record.getField(k) for k in keys]) if len(keys) > 1 else record.getField(keys[0])


def detection_columns(record: Column) -> Column:
    """A raw record struct (all keys of both dialects) as one struct of FIELDS; sentinels become null."""
    columns = []
    for name, (kind, *keys) in FIELDS.items():
        value = _first(record, tuple(keys))
        if kind == "double":
            value = F.when(~value.isin(*SENTINELS), value)
        columns.append(value.alias(name))
    return F.struct(*columns)


def parse_detection(json: Column) -> Column:
    """One detection record in JSON text as a struct of FIELDS."""
    return detection_columns(F.from_json(json, f"struct<{_KEYS.replace('` ', '`:')}>"))


def validated(df: DataFrame) -> DataFrame:
    """Fails on a latitude or longitude out of range, as soon as such a row is read."""
    ok = F.coalesce(F.col("latitude").between(-90, 90) & F.col("longitude").between(-180, 180), F.lit(True))
    return df.withColumn("latitude", F.when(ok, F.col("latitude")).otherwise(F.raise_error(F.lit("latitude or longitude out of range")).cast("double")))


def read_detections(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Detections of one or more JSON files (lists of records; paths may be globs), with the file as ``source_file``."""
    raw = spark.read.option("multiLine", True).schema(_KEYS).json(path)
    record = F.struct(*[F.col(f"`{k}`") for v in FIELDS.values() for k in v[1:]])
    out = raw.select(detection_columns(record).alias("d"), F.input_file_name().alias("source_file")).select("d.*", "source_file")
    far = F.to_timestamp("time") >= F.lit("9999-01-01").cast("timestamp")
    return validated(out.withColumn("time", F.when(~far, F.to_timestamp("time"))))


def read_ascii_detections(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Detections of whitespace tables: latitude, longitude, time, back azimuth, F, channels; comments and blank lines are left out."""
    lines = spark.read.text(path).select(F.trim("value").alias("v"), F.input_file_name().alias("source_file"))
    parts = F.split("v", r"\s+")
    rows = lines.where((F.col("v") != "") & ~F.col("v").startswith("#")).withColumn("p", parts)
    kinds = ("double", "double", "timestamp", "double", "double", "int")
    names = ("latitude", "longitude", "time", "back_az", "f_stat", "array_dim")
    return validated(rows.select(*[F.try_element_at("p", F.lit(i + 1)).cast(k).alias(n) for i, (n, k) in enumerate(zip(names, kinds, strict=True))], "source_file"))


def define_detection(df: DataFrame) -> DataFrame:
    """Detection fields rounded as they are written: azimuth 2, F 4, trace velocity 2 places, halves to even."""
    return df.withColumns({"back_az": F.bround("back_az", 2), "f_stat": F.bround("f_stat", 4), "trace_vel": F.bround("trace_vel", 2)})


def write_detections(df: DataFrame, path: str, by: str | None = None) -> None:
    """Detections as JSON records under the current keys, one folder ``by_<column>=<value>`` for each value of ``by``; never overwrites."""
    known = [F.col(n).cast("string" if n == "time" else k[0]).alias(k[1]) for n, k in FIELDS.items() if n in df.columns]
    writer = df.select(*known, *[F.col(by).alias(f"by_{by}")] if by else []).write.mode("errorifexists")
    (writer.partitionBy(f"by_{by}") if by else writer).json(path)


def export_beams(df: DataFrame, path: str) -> None:
    """Beam results as CSV with the columns Datetime, Fstat, TraceV, BackAz."""
    out = df.select(F.col("time").alias("Datetime"), F.col("f_stat").alias("Fstat"), F.col("trace_vel").alias("TraceV"), F.col("back_az").alias("BackAz"))
    out.write.option("header", True).csv(path)


def export_waveform(df: DataFrame, path: str) -> None:
    """Samples as CSV with the columns DateTime, Waveform."""
    df.select(F.col("time").alias("DateTime"), F.col("value").alias("Waveform")).write.option("header", True).csv(path)
