"""Packs and messages: how a corpus-wide job says something about every document without gathering the corpus.

Documents are packed: one row is a pack of about ``chunk_bytes`` of text of one
kind, compressed, made where its documents are read and written once to the
shared folder, so a pack is the same each time it is read. A pack asks hash
ranges ("buckets") by shuffled messages of sorted numbers, a bucket answers each
pack in the order of its question, and answers meet the pack again by a
cogroup. Packs and buckets are of bounded size, whatever the keys: what occurs
in a third of all documents is one number per pack.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondera.llm.common import cut, text_batches, tidied

LEVEL = 3  # of compression
_PACK = "chunk long, kind int, ids array<long>, ends array<long>, texts binary"
_ZSTD = pa.Codec("zstd", LEVEL)


def pressed(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + (_ZSTD.compress(raw, asbytes=True) if raw else b"")


def released(body: bytes) -> bytes:
    size = int.from_bytes(body[:8], "little")
    return _ZSTD.decompress(body[8:], size, asbytes=True) if size else b""


def planes(*arrays: np.ndarray) -> bytes:
    """Arrays of unsigned 64-bit numbers of one length, compressed byte plane by byte plane."""
    return pressed(b"".join(np.ascontiguousarray(a, np.uint64).view(np.uint8).reshape(-1, 8).T.tobytes() for a in arrays))


def from_planes(body: bytes, n: int) -> np.ndarray:
    """The arrays again, as rows of n numbers."""
    raw = np.frombuffer(released(body), np.uint8)
    return np.ascontiguousarray(raw.reshape(-1, 8, n).transpose(0, 2, 1)).view(np.uint64)[..., 0] if n else np.zeros((0, 0), np.uint64)


def deltas(sorted_keys: np.ndarray) -> np.ndarray:
    return np.diff(sorted_keys, prepend=np.uint64(0))


def text_bytes(df: DataFrame, text_col: str) -> int:
    return int(df.agg(F.sum(F.octet_length(text_col) + F.lit(64))).first()[0] or 0)


def packs(df: DataFrame, id_col: str, text_col: str, chunk_bytes: int, kind: Column | None = None, name: str = "packs") -> DataFrame:
    """All rows of ``df`` (ids as BIGINT, null texts as empty ones), written as packs of one ``kind`` each."""
    text_batches(df.sparkSession)
    rows = df.select(F.col(id_col).cast("long").alias("id"), (F.lit(0) if kind is None else kind).cast("int").alias("kind"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def pack(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, done = TaskContext.get().partitionId() << 32, 0
        held: dict[int, tuple[list, list, list]] = {}

        def row(kind: int) -> pa.RecordBatch:
            nonlocal done
            ids, ends, texts = held.pop(kind)
            done += 1
            columns = ([base + done], [kind], [ids], [ends], [pressed(b"".join(texts))])
            types = (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [x.split()[0] for x in _PACK.split(", ")])

        for batch in found:
            kinds, own = batch.column(1).to_pylist(), batch.column(0).to_pylist()
            for id_, k, text in zip(own, kinds, batch.column(2).cast(pa.binary()), strict=True):
                ids, ends, texts = held.setdefault(k, ([], [], []))
                texts.append(text.as_py())
                ids.append(id_)
                ends.append((ends[-1] if ends else 0) + len(texts[-1]))
                if ends[-1] >= chunk_bytes:
                    yield row(k)
        for k in list(held):
            yield row(k)

    return cut(rows.mapInArrow(tidied(pack), _PACK), name)


def opened(pack: pa.Table | pa.RecordBatch, at: int = 0) -> tuple[int, int, list[int | None], list[bytes]]:
    """(chunk, kind, ids, texts) of a row of packs."""
    chunk, kind, ids, ends, raw = (pack.column(i)[at].as_py() for i in range(5))
    raw = released(raw)
    return chunk, kind, ids, [raw[lo:hi] for lo, hi in zip([0, *ends], ends, strict=False)]


def n_buckets(n_bytes: int, bucket_bytes: int) -> int:
    """A power of two of hash ranges, each for about ``bucket_bytes`` of text."""
    return 1 << max(0, -(-n_bytes // bucket_bytes) - 1).bit_length()


def dealt(df: DataFrame, key: str, n_bytes: int, task_bytes: int = 64 << 20) -> DataFrame:
    """``df`` by ``key`` in as many tasks as its size takes, where that is more than the session's own number."""
    wanted = n_bytes // task_bytes
    own = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(wanted, key) if wanted > own else df


def word_hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def blocks(texts: list[bytes], most: int = 4 << 20) -> Iterator[list[int]]:
    """Row numbers of texts in runs of about ``most`` bytes."""
    run, size = [], 0
    for i, text in enumerate(texts):
        run.append(i)
        size += len(text)
        if size >= most:
            yield run
            run, size = [], 0
    if run:
        yield run


def mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of a 64-bit hash."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))
