"""Substring dedup: repeated 50-word windows, found behind a count-min prefilter.

Texts are packed (see ``chunks``). Pass one sketches. All 50-word windows are
hashed, and hash ranges divide a count-min sketch of ``DEPTH`` rows into
buckets. A pack's sketch of a bucket is sparse: it travels as sorted 32-bit
seeds, each standing for one window's cell in every row, with whether the
window was counted once or more often. A bucket adds up the sketches of all
packs in its counters and answers, for each seed, whether the smallest of its
counters is two or more. Counters are never below the number of windows that
share them, so a window whose estimate is one is not repeated, and none is lost.

Pass two takes only windows estimated repeated. A pack settles what it can see
itself: of equal windows only those of its smallest id go on, and each distinct
window goes on once, so a passage shared by a third of all documents is one
row of numbers a pack, spread over all buckets. Buckets group them exactly, by
96 bits of two hashes, and answer whether another pack has a smaller id. Pass
three takes the covered words out.

Edge cases: a null text has no words; a null id neither removes words nor loses
any; rows that share an id do not remove each other's words; repeated rows all
come back with the same result; an empty table gives an empty result. Ids must
be integers. Texts are read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from sondera.llm.chunks import dealt, deltas, from_planes, mixed, n_buckets, opened, packs, planes, pressed, released, text_bytes, word_hashes
from sondera.llm.common import cut, documents, tidied

NAME = "op10_substring_dedup"
WINDOW = 50
CHUNK_BYTES, BUCKET_BYTES = 4 << 20, 8 << 20
DEPTH, CELLS_PER_WINDOW = 3, 4  # of the sketch: rows, and cells of a row for each window counted, at least
_ODD = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)  # multipliers of the sketch's rows
_BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class Windows:
    """All windows of the texts that have an id: doc (row number), at (first word) and hash of each."""

    def __init__(self, ids: list[int | None], texts: list[bytes]):
        words = [t.split() if i is not None else [] for i, t in zip(ids, texts, strict=True)]
        n_words = np.fromiter(map(len, words), np.int64, len(words))
        self.hashes = word_hashes([w for ws in words for w in ws])
        ends = np.cumsum(n_words)
        doc = np.repeat(np.arange(len(words)), n_words)
        start = np.arange(max(0, len(doc) - WINDOW + 1))
        self.start = start[start + WINDOW <= ends[doc[: len(start)]]] if len(words) else start
        self.doc = doc[self.start]
        self.at = self.start - (ends - n_words)[self.doc]
        self.hash = self.hashed(_BASES[0], self.start)

    def hashed(self, base: int, start: np.ndarray) -> np.ndarray:
        """The rolling hash of the windows that begin at ``start``."""
        n = len(self.hashes)
        sums = np.r_[np.zeros(1, np.uint64), np.cumsum(self.hashes * _powers(base, n))]
        return mixed((sums[start + WINDOW] - sums[start]) * _powers(pow(base, -1, 1 << 64), n)[start])


def _split(hashes: np.ndarray, buckets: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) of sorted hashes; buckets are ranges of the top bits."""
    limits = np.array([(i << 64) // buckets for i in range(1, buckets)], np.uint64)
    ends = [0, *np.searchsorted(hashes, limits).tolist(), len(hashes)]
    return ((b, lo, hi) for b, (lo, hi) in enumerate(zip(ends, ends[1:], strict=False)) if hi > lo)


def _batch(rows: list[tuple], schema: str) -> pa.Table:
    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    fields = [x.split() for x in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[]] * len(fields)
    return pa.table([pa.array(c, types[t]) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])


_ASKED = "bucket int, chunk long, n int, body binary, more binary"
_TOLD = "chunk long, bucket int, n int, body binary"


def _seeds(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The 32 bits behind those that name the bucket."""
    return (hashes >> np.uint64(33 - buckets.bit_length())) & np.uint64(0xFFFFFFFF)


def _sketch(buckets: int):
    def of_packs(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for i in range(batch.num_rows):
                chunk, _, ids, texts = opened(batch, i)
                hashes, n = np.unique(Windows(ids, texts).hash, return_counts=True)
                seeds, rows = _seeds(hashes, buckets), []
                for b, lo, hi in _split(hashes, buckets):
                    rows.append((b, chunk, hi - lo, planes(deltas(seeds[lo:hi])), pressed(np.packbits(n[lo:hi] > 1).tobytes())))
                yield from _batch(rows, _ASKED).to_batches()

    return of_packs


def estimates(seeds: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Count-min estimates of the windows behind ``seeds`` after all ``counts`` are added."""
    bits = max(4, (CELLS_PER_WINDOW * len(seeds) - 1).bit_length())
    least = None
    for odd in _ODD[:DEPTH]:
        cells = (((seeds * np.uint64(odd)) & np.uint64(0xFFFFFFFF)) >> np.uint64(max(0, 32 - bits))).astype(np.int64)
        row = np.bincount(cells, weights=counts)[cells]
        least = row if least is None else np.minimum(least, row)
    return least


def _repeated(asked: pa.Table) -> pa.Table:
    """Of each pack's seeds: a bit for "estimated to be repeated"."""
    sizes = asked.column("n").to_pylist()
    seeds = np.concatenate([np.cumsum(from_planes(x, n)[0]) for x, n in zip(asked.column("body").to_pylist(), sizes, strict=True)])
    more = np.concatenate([np.unpackbits(np.frombuffer(released(x), np.uint8), count=n) for x, n in zip(asked.column("more").to_pylist(), sizes, strict=True)])
    again = estimates(seeds, more + 1.0) >= 2
    ends = np.cumsum(sizes)
    rows = [(chunk, b, n, pressed(np.packbits(again[end - n : end]).tobytes())) for chunk, b, n, end in zip(asked.column("chunk").to_pylist(), asked.column("bucket").to_pylist(), sizes, ends.tolist(), strict=True)]
    return _batch(rows, _TOLD)


def _bits(told: pa.Table, n: int) -> np.ndarray:
    """A pack's answers in the order of its questions."""
    told = told.sort_by("bucket")
    parts = [np.unpackbits(np.frombuffer(released(x), np.uint8), count=k) for x, k in zip(told.column("body").to_pylist(), told.column("n").to_pylist(), strict=True)]
    out = np.concatenate([np.zeros(0, np.uint8), *parts]).astype(bool)
    if len(out) != n:
        raise ValueError(f"{len(out)} answers for {n} windows")
    return out


_OPEN = "bucket int, chunk long, n int, body binary, more binary"  # bucket -1: the pack's own notes


def _candidates(buckets: int):
    def of_pack(pack: pa.Table, told: pa.Table) -> pa.Table:
        if not len(pack):
            return _batch([], _OPEN)
        chunk, _, ids, texts = opened(pack)
        seen = Windows(ids, texts)
        hashes, at = np.unique(seen.hash, return_inverse=True)
        may = np.flatnonzero(_bits(told, len(hashes))[at])
        own = np.array([i or 0 for i in ids], np.int64)[seen.doc[may]]
        second = seen.hashed(_BASES[1], seen.start[may]) >> np.uint64(32)
        order = np.lexsort((own, second, seen.hash[may]))
        may, own, second = may[order], own[order], second[order]
        first = seen.hash[may]
        new = np.r_[True, (first[1:] != first[:-1]) | (second[1:] != second[:-1])] if len(may) else np.zeros(0, bool)
        group = np.cumsum(new) - 1
        above = own > own[new][group] if len(may) else new  # settled here: a smaller id of this pack has the window
        notes = planes(*(x.astype(np.uint64) for x in (seen.doc[may], seen.at[may], np.where(above, 0, group + 1))))
        rows = [(-1, chunk, len(may), notes, pressed(b""))]
        first, second, own = first[new], second[new], own[new].view(np.uint64)
        for b, lo, hi in _split(first, buckets):
            rows.append((b, chunk, hi - lo, planes(deltas(first[lo:hi]), second[lo:hi], own[lo:hi]), pressed(b"")))
        return _batch(rows, _OPEN)

    return of_pack


def _grouped(asked: pa.Table) -> pa.Table:
    """Of each pack's windows: a bit for "another pack has it with a smaller id"."""
    sizes = asked.column("n").to_pylist()
    parts = [from_planes(x, n) for x, n in zip(asked.column("body").to_pylist(), sizes, strict=True)]
    first = np.concatenate([np.cumsum(p[0]) for p in parts])
    second, own = np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts]).view(np.int64)
    order = np.lexsort((own, second, first))
    a, b, i = first[order], second[order], own[order]
    new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
    above = np.empty(len(own), bool)
    above[order] = i > i[new][np.cumsum(new) - 1]
    ends = np.cumsum(sizes)
    return _batch([(chunk, bucket, n, pressed(np.packbits(above[end - n : end]).tobytes())) for chunk, bucket, n, end in zip(asked.column("chunk").to_pylist(), asked.column("bucket").to_pylist(), sizes, ends.tolist(), strict=True)], _TOLD)


_KEPT = "id long, n_words long, n_removed long, kept_sha256 string"


def _removed(with_text: bool):
    def of_pack(pack: pa.Table, told: pa.Table) -> pa.Table:
        schema = _KEPT + ", kept_text string" * with_text
        if not len(pack):
            return _batch([], schema)
        _, _, ids, texts = opened(pack)
        notes = told.filter(pa.compute.equal(told.column("bucket"), -1))
        answers = told.filter(pa.compute.greater_equal(told.column("bucket"), 0))
        n = notes.column("n")[0].as_py()
        doc, at, group = from_planes(notes.column("body")[0].as_py(), n).astype(np.int64) if n else np.zeros((3, 0), np.int64)
        above = np.r_[True, _bits(answers, int(group.max(initial=0)))]  # group 0: settled in the pack
        doc, at = doc[above[group]], at[above[group]]
        order = np.lexsort((at, doc))
        doc, at = doc[order], at[order]
        limits = np.searchsorted(doc, np.arange(len(ids) + 1)).tolist()
        rows = []
        for i, (id_, text) in enumerate(zip(ids, texts, strict=True)):
            words = text.split()
            starts = at[limits[i] : limits[i + 1]]
            if len(starts):
                cover = np.zeros(len(words) + 1, np.int64)
                cover[starts] += 1  # starts are distinct
                cover[starts + WINDOW] -= 1
                kept = [words[k] for k in np.flatnonzero(np.cumsum(cover[:-1]) == 0).tolist()]
            else:
                kept = words
            joined = b" ".join(kept)
            rows.append((id_, len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), *[joined.decode()] * with_text))
        return _batch(rows, schema)

    return of_pack


def substring_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """One row per row of ``df``: id, n_words, n_removed, kept_sha256 and, if asked for, kept_text (words joined by one space)."""
    size = text_bytes(df, text_col)
    buckets = n_buckets(size, BUCKET_BYTES)
    packed = packs(df, id_col, text_col, CHUNK_BYTES)
    asked = dealt(packed.mapInArrow(tidied(_sketch(buckets)), _ASKED), "bucket", size)
    told = cut(asked.groupBy("bucket").applyInArrow(_repeated, _TOLD), "repeated")
    by_chunk = dealt(packed, "chunk", size).groupBy("chunk")
    open_ = cut(by_chunk.cogroup(dealt(told, "chunk", size).groupBy("chunk")).applyInArrow(_candidates(buckets), _OPEN), "windows")
    answers = dealt(open_.where("bucket >= 0"), "bucket", size).groupBy("bucket").applyInArrow(_grouped, _TOLD)
    answers = answers.unionByName(open_.where("bucket < 0").select("chunk", "bucket", "n", "body"))
    kept = by_chunk.cogroup(dealt(answers, "chunk", size).groupBy("chunk")).applyInArrow(_removed(with_text), _KEPT + ", kept_text string" * with_text)
    return kept.withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(documents(spark, sf_dir), with_text=False)


ORACLE_SQL = """
WITH t AS (SELECT doc_id, row_number() OVER () AS r, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
p AS (SELECT doc_id, r, w, unnest(range(1, len(w) - 48)) AS i FROM t WHERE len(w) >= 50),
x AS (SELECT doc_id, r, i, md5(array_to_string(w[i:i + 49], ' ')) AS k FROM p),
m AS (SELECT *, min(doc_id) OVER (PARTITION BY k) AS least FROM x),
c AS (SELECT DISTINCT r, unnest(range(i, i + 50)) AS pos FROM m WHERE doc_id > least),
g AS (SELECT r, list(pos) AS gone FROM c GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256
FROM t LEFT JOIN g USING (r)
"""
