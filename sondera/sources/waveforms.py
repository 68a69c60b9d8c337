"""Waveform segments by one reader, whatever holds them: SAC and miniSEED files, a segment table, or catalog tables with their data files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondera.operators.relational import matches
from sondera.sources import mseed, sac

#: Sample types of data files, fixed values: big- and little-endian integers and floats of two, four and eight bytes.
SAMPLE_TYPES = {"s2": ">i2", "s4": ">i4", "t4": ">f4", "t8": ">f8", "i2": "<i2", "i4": "<i4", "f4": "<f4", "f8": "<f8"}


def read_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Segments of all SAC and miniSEED files of a path, a glob or several, through Spark's own binary reader; a file's first bytes say what it is."""
    import pyarrow as pa

    kinds = {"string": pa.string(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}
    fields = [(c.split()[0], kinds[c.split()[1]]) for c in sac.SCHEMA.split(", ")]

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for raw in batch.column(0):
                raw = raw.as_py()
                rows = mseed.segments(raw) if mseed.is_mseed(raw) else [sac.parse(raw)]
                for row in rows:
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, (_, t) in zip(row, fields, strict=True)], [n for n, _ in fields])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(batches, sac.SCHEMA)


def waveforms(spark: SparkSession, files: str | None = None, table: str | None = None, catalog: tuple[DataFrame, DataFrame, str] | None = None, **bounds) -> DataFrame:
    """Segments from exactly one source: ``files`` (SAC or miniSEED, globs separated by commas), ``table`` (parquet of segments), or
    ``catalog`` (sites, data file descriptions, folder of the data files) with the bounds of ``catalog_segments``."""
    given = [x for x in (files, table, catalog) if x is not None]
    if len(given) != 1:
        raise ValueError(f"one source is to be given, not {len(given)}")
    if files is not None:
        return read_files(spark, [p.strip() for p in files.split(",") if p.strip()])
    return spark.read.parquet(table) if table is not None else catalog_segments(spark, *catalog, **bounds)


#: Data files whose names are handed to the reader one by one; beyond that the folder is listed and joined.
NAMED_FILES = 20_000


def catalog_segments(spark: SparkSession, sites: DataFrame, wfdisc: DataFrame, folder: str, array: str | None = None, station: str = "*", channel: str = "*", start: float | None = None, end: float | None = None, named: int = NAMED_FILES) -> DataFrame:
    """Segments of the stations of an array (or of all) that overlap start..end, without their mean.

    ``sites``: sta, refsta, lat, lon, elev, ondate, offdate (yyyyddd, -1 for none); ``wfdisc``: sta, chan, time, endtime, nsamp,
    samprate, calib, datatype, dfile, foff. The wanted descriptions of a file are gathered first, so a file is read once and moves once,
    however many there are. The reader opens the files they name and no others; above ``named`` files it opens all of the folder. A missing
    file is an error.
    """
    w = wfdisc.where(matches("sta", station) & matches("chan", channel))
    if start is not None:
        w = w.where(F.col("endtime") >= start)
    if end is not None:
        w = w.where(F.col("time") <= end)
    day = (F.year(F.timestamp_seconds("time")) * 1000 + F.dayofyear(F.timestamp_seconds("time"))).alias("day")
    s = sites if array is None else sites.where(F.col("refsta") == array)
    s = s.select("sta", "refsta", "lat", "lon", "elev", "ondate", "offdate")
    joined = w.withColumn("day", day).join(s, "sta").where((F.col("day") >= F.col("ondate")) & ((F.col("offdate") < 0) | (F.col("day") <= F.col("offdate"))))
    fields = {"refsta": "string", "sta": "string", "chan": "string", "time": "double", "nsamp": "long", "samprate": "double", "calib": "double", "datatype": "string", "foff": "long", "lat": "double", "lon": "double", "elev": "double"}
    known = {"string": "", "double": float("nan"), "long": 0}  # what stands for null in a list
    files = joined.groupBy("dfile").agg(*[F.collect_list(F.coalesce(F.col(c).cast(t), F.lit(known[t]).cast(t))).alias(c) for c, t in fields.items()])
    names = [r["dfile"] for r in files.select("dfile").limit(named + 1).collect()]
    if not names:
        return spark.createDataFrame([], sac.SCHEMA)
    paths = [f"{folder}/{n}" for n in sorted(names)] if len(names) <= named else f"{folder}/*"
    data = spark.read.format("binaryFile").load(paths).select(F.regexp_extract("path", r"([^/]*)$", 1).alias("dfile"), "content")
    columns = [c.split()[0] for c in sac.SCHEMA.split(", ")]

    def batches(found: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in found:
            for row in pdf.itertuples(index=False):
                out = []
                for r in zip(*(getattr(row, c) for c in fields), strict=True):
                    d = dict(zip(fields, r, strict=True))
                    x = np.frombuffer(row.content, SAMPLE_TYPES[d["datatype"]], int(d["nsamp"]), int(d["foff"])).astype(float)
                    calib = d["calib"] if d["calib"] and d["calib"] == d["calib"] else 1.0
                    place = [None if v != v else float(v) for v in (d["lat"], d["lon"], d["elev"])]
                    out.append((d["refsta"] or None, d["sta"], None, d["chan"], float(d["time"]), float(d["samprate"]), float(calib), *place, (x - x.mean()).tolist() if len(x) else []))
                    if len(out) == 64:
                        yield pd.DataFrame(out, columns=columns)
                        out = []
                if out:
                    yield pd.DataFrame(out, columns=columns)

    return files.join(data, "dfile").drop("dfile").mapInPandas(batches, sac.SCHEMA)


def copy_new(source: DataFrame, target: DataFrame, keys: list[str], bounds: dict[str, tuple] | None = None) -> DataFrame:
    """Rows of a table inside bounds (column: (from, to), ends included) whose keys the target does not have yet."""
    for c, (lo, hi) in (bounds or {}).items():
        source = source.where(F.col(c).between(lo, hi))
    return source.join(target.select(*keys).distinct(), keys, "left_anti")
