"""Packing token ids into sequences by Karmarkar-Karp multiway differencing.

Each partition reads its documents in order, encodes them and cuts them: whole
windows of ``capacity`` ids, and the rest into pieces of at most ``PIECE`` ids.
Full pieces need no partner. The others are gathered until they fill
``WINDOWS`` windows but for a little slack, and a group is divided by multiway
differencing: every piece starts as a partial partition (its length, then
zeros); the two partial partitions with the largest spread are merged, the
fullest window of one with the emptiest of the other, until one is left. If its
fullest window is above capacity, the group gets one more window and is divided
again. A partition's last, smaller group is divided the same way.

Nothing is shuffled, memory is one group, and a lost task is simply run again:
sequence ids are made of the partition's number and a count, so a rerun over
the same splits gives the same rows.

Encoding looks up every distinct word of a few texts in a worker's cache of id lists and
gives only new words to the tokenizer: this vocabulary drops white space before
it merges, so the ids of a text are those of its words.

Edge cases: a null or empty text is the end id alone; an empty table gives an
empty result; null ids are packed like any other, and equal rows each get their
own pieces. Very long texts become many whole windows.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sondera.llm.common import documents, text_batches, tidied
from sondera.llm.tokens import word_ids

NAME = "op2_packing"
TOKENIZER, END_ID, CAPACITY = "word_bpe_49k.json", 1, 2048
PIECE, WINDOWS, SLACK = 512, 256, 16
PIECES = 8192  # of a group at most: each is a row of window sums while a group is divided
_RESULT = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def divide(lengths: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Multiway differencing of lengths into k windows: (window of each piece, sums of the windows)."""
    n = len(lengths)
    merges: list[tuple[int, int, np.ndarray]] = []
    heap = []
    for i, length in enumerate(lengths.tolist()):
        sums = np.zeros(k, np.int64)
        sums[0] = length
        heap.append((-length if k > 1 else 0, i, sums))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a, x = heapq.heappop(heap)
        _, b, y = heapq.heappop(heap)
        sums = x + y[::-1]
        order = np.argsort(-sums, kind="stable")
        sums = sums[order]
        merges.append((a, b, order))
        heapq.heappush(heap, (int(sums[-1] - sums[0]), n + len(merges) - 1, sums))
    slots: dict[int, np.ndarray] = {heap[0][1]: np.arange(k)}
    for at in range(len(merges) - 1, -1, -1):  # back from the last merge: which window each slot became
        a, b, order = merges[at]
        own = np.empty(k, np.int64)
        own[order] = slots.pop(n + at)
        slots[a], slots[b] = own, own[::-1]
    return np.array([slots[i][0] for i in range(n)], np.int64), heap[0][2]


def pack_group(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, offset) of each piece; the number of windows rises until none is above capacity."""
    k = max(1, -(-int(lengths.sum()) // capacity))
    while True:
        window, sums = divide(lengths, k)
        if sums.max() <= capacity:
            break
        k += 1
    order = np.argsort(window, kind="stable")
    ends = np.cumsum(lengths[order])
    starts = ends - lengths[order]
    first = np.r_[True, np.diff(window[order]) > 0]
    offset = np.empty(len(lengths), np.int64)
    offset[order] = starts - starts[first][np.cumsum(first) - 1]
    return window, offset


def pack(df: DataFrame, encode: Callable[[list[bytes]], Iterator[np.ndarray]], id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece of each document. ``encode`` gives the ids of each text of a batch, end id included.

    ``with_ids`` adds the ids themselves (BINARY, little-endian unsigned 32-bit).
    """
    text_batches(df.sparkSession)
    id_type = df.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, id_type), *T.StructType.fromDDL(_RESULT).fields])
    if with_ids:
        schema = schema.add("ids", T.BinaryType())
    names = schema.names

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 33
        done, waiting, total = 0, [], 0

        def group() -> list[tuple]:
            window, offset = pack_group(np.array([p[2] for p in waiting]), capacity)
            nonlocal done
            rows = [(*p[:5], base + done + int(w), int(o), *p[5:]) for p, w, o in zip(waiting, window, offset, strict=True)]
            done += int(window.max()) + 1
            return rows

        def batch_of(rows: list[tuple], like: pa.DataType) -> pa.RecordBatch:
            types = [like, *[pa.int64()] * 6, *[pa.binary()] * with_ids]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types, strict=True)], names)

        like = None
        for batch in found:
            ids_of = batch.column(batch.schema.get_field_index(id_col))
            like, rows = ids_of.type, []
            texts = batch.column(batch.schema.get_field_index(text_col)).cast(pa.binary())
            for doc, ids in zip(ids_of.to_pylist(), encode([t.as_py() or b"" for t in texts]), strict=True):
                raw, n = ids.tobytes(), len(ids)
                for start in range(0, n - n % capacity, capacity):
                    part = raw[4 * start : 4 * (start + capacity)]
                    rows.append((doc, start, capacity, zlib.crc32(part), n, base + done, 0, *[part] * with_ids))
                    done += 1
                for start in range(n - n % capacity, n, PIECE):
                    part = raw[4 * start : 4 * min(start + PIECE, n)]
                    waiting.append((doc, start, len(part) // 4, zlib.crc32(part), n, *[part] * with_ids))
                    total += len(part) // 4
                    if total >= WINDOWS * (capacity - SLACK) - PIECE or len(waiting) >= PIECES:
                        rows += group()
                        waiting, total = [], 0
            if rows:
                yield batch_of(rows, like)
        if waiting:
            yield batch_of(group(), like)

    return df.select(id_col, text_col).mapInArrow(tidied(batches), schema)


def packed(docs: DataFrame) -> DataFrame:
    return pack(docs, partial(word_ids, tokenizer=TOKENIZER, end=END_ID))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(documents(spark, sf_dir)).select("doc_id", *[F.col(x.split()[0]) for x in _RESULT.split(", ")])


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packed(docs)


ORACLE_SQL = None  # the tokenizer has no SQL form; tests decode every piece and hold the ids against the library
