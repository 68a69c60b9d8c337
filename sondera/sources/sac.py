"""Waveform segments from SAC files, as a Spark Python data source: one partition per file."""

from __future__ import annotations

import glob
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "network string, station string, location string, channel string, t0 double, fs double, calib double, lat double, lon double, elev double, samples array<double>"
#: Fixed positions in the format: words of the float header (delta, scale, begin, station latitude, longitude, elevation),
#: of the integer header (year, day, hour, minute, second, millisecond, points) and bytes of the text header.
_DELTA, _SCALE, _BEGIN, _LAT, _LON, _ELEV = 0, 3, 5, 31, 32, 33
_HEADER, _UNSET = 632, -12345


def parse(raw: bytes) -> tuple:
    """One segment from the bytes of a SAC file of either byte order."""
    order = "<" if struct.unpack_from("<i", raw, 304)[0] == 6 else ">"
    f = struct.unpack_from(f"{order}70f", raw, 0)
    year, day, hour, minute, second, ms, *_ = struct.unpack_from(f"{order}40i", raw, 280)
    n = struct.unpack_from(f"{order}i", raw, 280 + 9 * 4)[0]
    text = lambda at, size=8: (raw[440 + at : 440 + at + size].decode("ascii", "replace").strip("\0 ") or None)
    known = lambda x: None if x == _UNSET else float(x)
    from datetime import datetime, timedelta, timezone

    begin = datetime(year, 1, 1, tzinfo=timezone.utc) + timedelta(days=day - 1, hours=hour, minutes=minute, seconds=second, milliseconds=ms)
    named = [None if x == str(_UNSET) else x for x in (text(168), text(0), text(24), text(160))]
    samples = struct.unpack_from(f"{order}{n}f", raw, _HEADER)
    return (*named, begin.timestamp() + f[_BEGIN], 1 / f[_DELTA], known(f[_SCALE]) or 1.0, known(f[_LAT]), known(f[_LON]), known(f[_ELEV]), list(samples))


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in sorted(glob.glob(self.path))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(partition.value, "rb") as file:
            yield parse(file.read())


class SacSource(DataSource):
    """``spark.read.format("sac").load("records/*.sac")``: local or mounted paths; ``read_sac`` reads any path that Spark can."""

    @classmethod
    def name(cls) -> str:
        return "sac"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])


def read_sac(spark: SparkSession, path: str) -> DataFrame:
    """Segments of all files of a path or glob, through Spark's own binary reader."""
    import pyarrow as pa

    def batches(found):
        for batch in found:
            rows = [parse(x.as_py()) for x in batch.column(0)]
            yield pa.RecordBatch.from_pylist([dict(zip(_NAMES, r, strict=True)) for r in rows], schema=_ARROW)

    kinds = {"string": pa.string(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}
    _NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
    _ARROW = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in SCHEMA.split(", ")])
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(batches, SCHEMA)


def packed(row: dict) -> bytes:
    """The bytes of a SAC file (little-endian, evenly spaced) of one segment; what is not known is left unset."""
    from datetime import datetime, timezone

    x = [float(v) for v in row["samples"]]
    fs = [float(_UNSET)] * 70
    delta = 1 / row["fs"]
    begin = datetime.fromtimestamp(row["t0"], timezone.utc)
    ms = begin.microsecond // 1000
    rest = begin.microsecond / 1e6 - ms / 1e3
    for at, v in ((_DELTA, delta), (_SCALE, row.get("calib")), (_BEGIN, rest), (6, rest + (len(x) - 1) * delta), (_LAT, row.get("lat")), (_LON, row.get("lon")), (_ELEV, row.get("elev"))):
        fs[at] = float(_UNSET) if v is None else float(v)
    if x:
        fs[1], fs[2], fs[56] = min(x), max(x), sum(x) / len(x)  # least, greatest and mean value
    ints = [_UNSET] * 40
    ints[:6] = [begin.year, begin.timetuple().tm_yday, begin.hour, begin.minute, begin.second, ms]
    ints[6], ints[9], ints[15], ints[35] = 6, len(x), 1, 1  # header version, points, time series, evenly spaced
    text = bytearray(b"-12345  " * 24)
    for at, v in ((168, row.get("network")), (0, row.get("station")), (24, row.get("location")), (160, row.get("channel"))):
        if v:
            text[at : at + 8] = v.encode("ascii", "replace")[:8].ljust(8)
    return struct.pack("<70f", *fs) + struct.pack("<40i", *ints) + bytes(text) + struct.pack(f"<{len(x)}f", *x)


def to_sac(segments: DataFrame) -> DataFrame:
    """One row per segment: file name (network.station.location.channel_time.sac) and the file's bytes, for any binary sink."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    have = [c for c in names if c in segments.columns]

    def batches(found):
        import pandas as pd

        for pdf in found:
            out = []
            for row in pdf.to_dict("records"):
                row = {k: None if k != "samples" and v != v else v for k, v in row.items()}
                from datetime import datetime, timezone

                stamp = datetime.fromtimestamp(row["t0"], timezone.utc).strftime("%Y.%m.%d_%H.%M.%S")
                out.append((".".join(row.get(c) or "" for c in ("network", "station", "location", "channel")) + f"_{stamp}.sac", packed(row)))
            yield pd.DataFrame(out, columns=["name", "content"])

    return segments.select(*have).mapInPandas(batches, "name string, content binary")
