"""Waveform segments from miniSEED files: records of SEED 2.4 with integers, floats or Steim-1/2 differences, of either byte order.

Records that follow each other without a gap become one segment. Two readers:
``read_mseed`` takes any path that Spark reads, a file to a row. ``MseedSource``
is a Python data source for mounted paths, with one partition for each byte
range of a file: records that start in a range are its own, so large files are
shared out. It takes over filters on network, station, location and channel:
names of files in the day archive's form (NET.STA.LOC.CHA.D.YEAR.DAY) are held
against them, and those that can not match are never opened; of other files
only records that match are decoded. Filters on t0 also choose among day files;
Spark applies them again.
"""

from __future__ import annotations

import glob
import os
import re
import struct
from collections import defaultdict
from collections.abc import Iterator
from datetime import date
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from sondera.sources.sac import SCHEMA

#: Fixed values of the format: sample types by encoding number, differences of Steim words as (code, upper two bits or none, count, bits).
PLAIN = {1: "i2", 3: "i4", 4: "f4", 5: "f8"}
STEIM = {10: ((1, None, 4, 8), (2, None, 2, 16), (3, None, 1, 32)), 11: ((1, None, 4, 8), (2, 1, 1, 30), (2, 2, 2, 15), (2, 3, 3, 10), (3, 0, 5, 6), (3, 1, 6, 5), (3, 2, 7, 4))}
FRAME, LEAST, LONGEST = 64, 128, 1 << 17  # bytes of a Steim frame, and of a record at least and at most
RANGE = 64 << 20  # bytes of a file that a partition takes
SLACK = 3600.0  # seconds by which a day file's records may lie outside its day
_START = re.compile(rb"[0-9 ]{6}[DRQM][ \0]")
_DAY_FILE = re.compile(r"(\w*)\.(\w*)\.(\w*)\.(\w*)\.\w\.(\d{4})\.(\d{3})")
_NAMES = ("network", "station", "location", "channel")


class Record(NamedTuple):
    id: tuple
    t0: float
    fs: float
    n: int
    encoding: int
    order: str
    data: int  # where its data begin
    end: int


def is_mseed(raw: bytes) -> bool:
    return bool(_START.match(raw))


def header(raw: bytes, at: int) -> Record:
    """The record that begins at ``at``."""
    order = ">" if 1900 <= struct.unpack_from(">H", raw, at + 20)[0] <= 2100 else "<"
    station, location, channel, network = (x.decode("ascii", "replace").strip(" \0") or None for x in struct.unpack_from("5s2s3s2s", raw, at + 8))
    year, day, hour, minute, second, fraction, n, factor, multiplier, activity, blockettes, correction, data, nxt = struct.unpack_from(f"{order}HHBBBxHHhhB2xBiHH", raw, at + 20)
    fs = 0.0
    if factor and multiplier:
        fs = (factor if factor > 0 else -1 / factor) * (multiplier if multiplier > 0 else -1 / multiplier)
    encoding, data_order, size, micros = None, ">", 0, 0
    for _ in range(blockettes):
        if not nxt:
            break
        kind, after = struct.unpack_from(f"{order}HH", raw, at + nxt)
        if kind == 1000:
            encoding, big, power = struct.unpack_from("BBB", raw, at + nxt + 4)
            data_order, size = ">" if big else "<", 1 << power
        elif kind == 1001:
            micros = struct.unpack_from("b", raw, at + nxt + 5)[0]
        elif kind == 100:
            fs = struct.unpack_from(f"{order}f", raw, at + nxt + 4)[0]
        nxt = after
    if encoding is None or size < LEAST:
        raise ValueError(f"no blockette 1000 in the record at byte {at}")
    t = (date(year, 1, 1).toordinal() - date(1970, 1, 1).toordinal() + day - 1) * 86400 + hour * 3600 + minute * 60 + second
    ticks = fraction * 100 + micros + (0 if activity & 2 else correction * 100)  # of a microsecond
    return Record((network, station, location, channel), t + ticks / 1e6, float(fs), n, encoding, data_order, at + (data or size), at + size)


def records(raw: bytes, start: int = 0, stop: int | None = None) -> Iterator[Record]:
    """Records that begin from ``start`` (moved on to the next record) and before ``stop``."""
    at, stop = start, len(raw) if stop is None else stop
    while at < stop:
        if not _START.match(raw, at):
            at += LEAST
            continue
        found = header(raw, at)
        if found.end > len(raw):
            raise ValueError(f"the record at byte {at} is cut off")
        yield found
        at = found.end


def steim(words: np.ndarray, n: np.ndarray, encoding: int) -> list[np.ndarray]:
    """Samples of several records of one size; ``words``: [record, frame, 16]."""
    codes = (words[:, :, :1] >> np.arange(30, -1, -2, dtype=np.uint32)) & 3
    codes[:, :, 0] = 0
    codes[:, 0, 1:3] = 0  # the first and the last sample
    upper = words >> np.uint32(30)
    counts = np.zeros(words.shape, np.int64)
    kinds = [(code == codes if top is None else (code == codes) & (top == upper), count, bits) for code, top, count, bits in STEIM[encoding]]
    for mask, count, _ in kinds:
        counts[mask] = count
    ends = np.cumsum(counts.ravel()).reshape(counts.shape)
    out = np.zeros(int(ends[-1, -1, -1]) if ends.size else 0, np.int64)
    for mask, count, bits in kinds:
        w, at = words[mask].astype(np.int64), (ends - counts)[mask]
        for k in range(count):
            v = (w >> (bits * (count - 1 - k))) & ((1 << bits) - 1)
            out[at + k] = (v ^ (1 << (bits - 1))) - (1 << (bits - 1))
    first, last = (words[:, 0, k].astype(np.int32).astype(np.int64) for k in (1, 2))
    starts = ends[:, 0, 0]
    samples = []
    for a, m, x0, xn, have in zip(starts.tolist(), n.tolist(), first.tolist(), last.tolist(), (ends[:, -1, -1] - starts).tolist(), strict=True):
        if have < m:
            raise ValueError(f"{have} differences for {m} samples")
        d = out[a : a + m]
        if m:
            d[0] = x0
        x = np.cumsum(d)
        if m and x[-1] != xn:
            raise ValueError("a record's last sample is not what its differences lead to")
        samples.append(x)
    return samples


def decoded(raw: bytes, found: list[Record]) -> list[np.ndarray]:
    """Samples of records, those of one form at once."""
    out: list[np.ndarray | None] = [None] * len(found)
    groups = defaultdict(list)
    for i, r in enumerate(found):
        groups[r.encoding, r.order, r.end - r.data].append(i)
    for (encoding, order, size), at in groups.items():
        if encoding in PLAIN:
            for i in at:
                out[i] = np.frombuffer(raw, order + PLAIN[encoding], found[i].n, found[i].data).astype(float)
        elif encoding in STEIM:
            frames = size // FRAME
            words = np.stack([np.frombuffer(raw, f"{order}u4", frames * 16, found[i].data) for i in at]).astype(np.uint32).reshape(len(at), frames, 16)
            for i, x in zip(at, steim(words, np.array([found[i].n for i in at]), encoding), strict=True):
                out[i] = x.astype(float)
        else:
            raise ValueError(f"encoding {encoding} is not read")
    return out


def segments(raw: bytes, start: int = 0, stop: int | None = None, wanted=None) -> Iterator[tuple]:
    """Segments of the records of ``raw``: runs of records of one channel with no gap between them."""
    found = [r for r in records(raw, start, stop) if r.n and r.fs > 0 and (wanted is None or wanted(r.id))]
    found.sort(key=lambda r: (tuple(x or "" for x in r.id), r.t0))
    samples = decoded(raw, found)
    run: list[int] = []
    for i, r in enumerate(found):
        if run:
            p = found[run[-1]]
            if p.id != r.id or p.fs != r.fs or abs(p.t0 + p.n / p.fs - r.t0) > 0.5 / r.fs:
                yield _segment(found, samples, run)
                run = []
        run.append(i)
    if run:
        yield _segment(found, samples, run)


def _segment(found: list[Record], samples: list[np.ndarray], run: list[int]) -> tuple:
    r = found[run[0]]
    return (*r.id, r.t0, r.fs, 1.0, None, None, None, np.concatenate([samples[i] for i in run]).tolist())


def read_mseed(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Segments of all files of a path, a glob or several, through Spark's own binary reader."""
    from sondera.sources.waveforms import read_files

    return read_files(spark, path)


# ------------------------------------------------------------------ data source


class Range(InputPartition):
    def __init__(self, path: str, start: int, stop: int):
        super().__init__(path)
        self.path, self.start, self.stop = path, start, stop


class MseedReader(DataSourceReader):
    def __init__(self, path: str, range_bytes: int):
        self.path, self.range_bytes = path, max(1, range_bytes // LEAST) * LEAST  # records begin at multiples of LEAST
        self.names: dict[str, set] = {}
        self.after, self.before = -np.inf, np.inf

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if len(f.attribute) == 1 else None
            if name in _NAMES and isinstance(f, EqualTo | In):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.names[name] = self.names.get(name, values) & values
                continue
            if name == "t0" and isinstance(f, GreaterThan | GreaterThanOrEqual):
                self.after = max(self.after, f.value)
            elif name == "t0" and isinstance(f, LessThan | LessThanOrEqual):
                self.before = min(self.before, f.value)
            yield f

    def wanted(self, id_: tuple) -> bool:
        return all(x in self.names[c] for c, x in zip(_NAMES, id_, strict=True) if c in self.names)

    def may_hold(self, path: str) -> bool:
        """Whether a file's name, if it says what is in it, leaves anything wanted."""
        m = _DAY_FILE.fullmatch(os.path.basename(path))
        if not m:
            return True
        day = (date(int(m[5]), 1, 1).toordinal() - date(1970, 1, 1).toordinal() + int(m[6]) - 1) * 86400.0
        return self.wanted(tuple(x or None for x in m.groups()[:4])) and day - SLACK <= self.before and day + 86400 + SLACK >= self.after

    def partitions(self) -> list[InputPartition]:
        found = sorted({f for p in self.path.split(",") for f in glob.glob(p.strip(), recursive=True) if os.path.isfile(f)})
        ranges = [Range(f, a, a + self.range_bytes) for f in found if self.may_hold(f) for a in range(0, os.path.getsize(f), self.range_bytes)]
        return ranges or [Range("", 0, 0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if not partition.path:
            return
        with open(partition.path, "rb") as file:
            file.seek(partition.start)
            raw = file.read(partition.stop - partition.start + LONGEST)
        yield from segments(raw, 0, min(len(raw), partition.stop - partition.start), self.wanted)


class MseedSource(DataSource):
    """``spark.read.format("mseed").load("archive/**/*.D.*")``: a glob or several, separated by commas; option rangeBytes."""

    @classmethod
    def name(cls) -> str:
        return "mseed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return MseedReader(self.options["path"], int(self.options.get("rangeBytes", RANGE)))


def register(spark: SparkSession) -> None:
    """Make the format known to the session, and let Spark pass filters on to Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(MseedSource)
