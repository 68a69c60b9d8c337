"""SimHash near-dedup with a bit-sliced comparison of fingerprints.

Three steps, all on 64-bit fingerprints; texts are read once.

1. Every text becomes a fingerprint (word 3-shingles, XXH64), in Arrow batches.
   Equal fingerprints collapse before anything is compared.
2. Fingerprints within ``RADIUS`` bits agree on at least two of five blocks of
   bits, so each goes to ten buckets, one for every pair of blocks. Buckets of
   one are dropped. A bucket above ``BUCKET`` is split into chunks and every
   pair of chunks is a task's bucket of its own, so nothing is left out and no
   task holds an unbounded group. Inside a partition the bucket-sorted
   fingerprints are stored as 64 vertical bit planes; for a shift d the planes
   are XORed with themselves moved by d, which compares all pairs (i, i + d) at
   once, and carry-save counters (ones, twos, four-or-more) hold the distances.
   A block of ``8 * BLOCK`` pairs is left as soon as all in it exceed the radius. Of the links in
   a bucket only a spanning forest leaves it, never all pairs.
3. Connected components by alternating large-star and small-star rounds, each
   round written to the shared folder.

Edge cases: a null or blank text has fingerprint zero and links like any other;
null ids are never a component's id unless it has no other, and are kept as
their own rows; rows that share an id share its component when their texts
link. An empty table gives an empty result. Very long texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sondera.llm.common import BROADCAST_ROWS, cut, documents, in_few_tasks, small, text_batches, tidied

NAME = "op6_simhash_near_dedup"
SHINGLE, RADIUS, BITS, BLOCKS = 3, 3, 64, 5
BUCKET = 8192
SLICE = 1 << 16  # hashes whose bits are added up at once
STARS = 1 << 18  # links that a task turns into stars at once
BLOCK = 512  # bytes of a bit plane, eight pairs each, that are given up together
_PAIRS = tuple(combinations(range(BLOCKS), BLOCKS - RADIUS))
_EDGES = tuple(round(i * BITS / BLOCKS) for i in range(BLOCKS + 1))


def fingerprint(text: bytes | None, size: int = SHINGLE) -> int:
    """SimHash of a UTF-8 text as an unsigned number."""
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= size:
        return xxhash.xxh64_intdigest(joined, 42)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths)
    spans = map(slice, (ends - lengths)[: 1 - size].tolist(), (ends - 1)[size - 1 :].tolist())
    n = len(words) - size + 1
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, map(joined.__getitem__, spans), repeat(42)), np.uint64, n)
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), SLICE):
        ones += np.unpackbits(hashes[at : at + SLICE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def with_fingerprint(df: DataFrame, text_col: str = "text", out: str = "__fp") -> DataFrame:
    """``df`` and a BIGINT column with each text's fingerprint."""
    text_batches(df.sparkSession)
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.LongType())])

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            texts = batch.column(batch.schema.get_field_index(text_col)).cast(pa.binary())
            prints = np.array([fingerprint(t.as_py()) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prints)], [*batch.schema.names, out])

    return df.mapInArrow(tidied(batches), schema)


# ---------------------------------------------------------------- comparison


def _planes(prints: np.ndarray) -> np.ndarray:
    """Bit planes: row b holds bit b of every fingerprint, packed."""
    bits = np.unpackbits(prints.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(bits.T, axis=1, bitorder="little")


def _shifted(planes: np.ndarray, d: int, n: int) -> np.ndarray:
    """Planes whose column i is column i + d of the given ones; the first n columns."""
    byte, bit = divmod(d, 8)
    width = (n + 7) // 8
    low = planes[:, byte : byte + width]
    if not bit:
        return low
    high = planes[:, byte + 1 : byte + 1 + width]
    out = low >> bit
    out[:, : high.shape[1]] |= high << (8 - bit)
    return out[:, :width]


def within_radius(planes: np.ndarray, d: int, n: int, alive: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Packed mask of the first n pairs (i, i + d) with at most ``radius`` differing bits, of those ``alive``; the radius is a power of two less one."""
    counters = radius.bit_length()
    assert radius + 1 == 1 << counters, "the counters run over at a power of two"
    other, own = _shifted(planes, d, n), planes[:, : (n + 7) // 8]
    near = np.zeros_like(alive)
    for at in range(0, len(alive), BLOCK):
        block = slice(at, at + BLOCK)
        dead = ~alive[block]
        if not (alive[block]).any():
            continue
        sums = np.zeros((counters, len(dead)), np.uint8)  # ones, twos, fours ...
        for b in range(BITS):
            carry = own[b, block] ^ other[b, block]
            for bit in sums:
                over = bit & carry
                bit ^= carry
                carry = over
            dead |= carry
            if b % 8 == 7 and (dead == 255).all():
                break
        near[block] = ~dead
    return near


def bucket_links(keys: np.ndarray, prints: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among fingerprints with equal (sorted) keys."""
    left, right = [], []
    lab = np.arange(len(keys))
    at = np.arange(len(keys))
    d = 0
    while True:
        d += 1
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, int)
        sizes = np.diff(np.r_[starts, len(keys)])
        large = np.repeat(sizes > d, sizes)  # buckets that still have pairs at this distance
        if not large.any():
            break
        if not large.all():
            keys, prints, at = keys[large], prints[large], at[large]
        if d == 1 or not large.all():
            planes = _planes(prints)
        n = len(keys) - d
        alive = np.packbits((keys[:n] == keys[d:]) & (lab[at[:n]] != lab[at[d:]]), bitorder="little")
        near = np.flatnonzero(np.unpackbits(within_radius(planes, d, n, alive, radius), count=n, bitorder="little"))
        i, j = at[near], at[near + d]
        while len(i):  # merge labels; only links between two trees are kept
            a, b = lab[i], lab[j]
            open_ = a != b
            i, j, a, b = i[open_], j[open_], np.minimum(a, b)[open_], np.maximum(a, b)[open_]
            if not len(i):
                break
            _, one = np.unique(b, return_index=True)  # each tree is hung once a round
            left.append(i[one])
            right.append(j[one])
            lab[b[one]] = a[one]
            while (up := lab[lab]).tobytes() != lab.tobytes():
                lab = up
    none = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def links(prints: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Links (u, v) that connect all distinct fingerprints ``__fp`` within the radius, some more than once."""
    keys = []
    for t, pair in enumerate(_PAIRS):
        key = F.lit(t).cast("long")
        for block in pair:
            lo, hi = _EDGES[block], _EDGES[block + 1]
            part = F.shiftrightunsigned("__fp", lo).bitwiseAND((1 << (hi - lo)) - 1)
            key = F.shiftleft(key, hi - lo).bitwiseOR(part)
        keys.append(key)
    rows = prints.select("__fp", F.explode(F.array(*keys)).alias("k"))
    sizes = small(rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    rows = rows.join(sizes, "k").withColumn("c", F.ceil(F.col("n") / bucket).cast("int"))
    own = F.pmod(F.xxhash64("__fp"), F.col("c")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("c") - 1), lambda j: F.least(own, j) * F.col("c") + F.greatest(own, j))
    rows = rows.select("k", F.explode(pairs).alias("p"), "__fp").repartition("k", "p").sortWithinPartitions("k", "p", "__fp")

    def compare(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(batches: list[pa.RecordBatch], last: bool):
            table = pa.Table.from_batches(batches).combine_chunks()
            k, p, fp = (table.column(c).to_numpy() for c in ("k", "p", "__fp"))
            key = np.cumsum(np.r_[0, (k[1:] != k[:-1]) | (p[1:] != p[:-1])])
            n = len(key) if last else int(np.searchsorted(key, key[-1]))  # the last bucket may go on
            rest = [] if last else table.slice(n).to_batches()
            i, j = bucket_links(key[:n], fp[:n].view(np.uint64)) if n else (np.zeros(0, int),) * 2
            return rest, pa.RecordBatch.from_arrays([pa.array(fp[i]), pa.array(fp[j])], ["u", "v"])

        for batch in found:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= 1 << 15:
                held, out = flush(held, False)
                yield out
        if held:
            yield flush(held, True)[1]

    return rows.mapInArrow(tidied(compare), "u long, v long")


def _stars(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (u, v) of each ``STARS`` rows, as links of every node to the smallest node it reaches among them."""

    def collapsed(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        i, j = at[: len(u)], at[len(u) :]
        lab = np.arange(len(nodes))
        while True:  # labels fall to the smaller of both ends until none does
            low = np.minimum(lab[i], lab[j])
            new = lab.copy()
            np.minimum.at(new, lab[i], low)
            np.minimum.at(new, lab[j], low)
            while (up := new[new]).tobytes() != new.tobytes():
                new = up
            if new.tobytes() == lab.tobytes():
                break
            lab = new
        hung = np.flatnonzero(lab != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[hung]), pa.array(nodes[lab[hung]])], ["u", "v"])

    us, vs, n = [], [], 0
    for batch in found:
        us.append(batch.column(0).to_numpy())
        vs.append(batch.column(1).to_numpy())
        n += batch.num_rows
        if n >= STARS:
            yield collapsed(np.concatenate(us), np.concatenate(vs))
            us, vs, n = [], [], 0
    if n:
        yield collapsed(np.concatenate(us), np.concatenate(vs))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of (u, v): one row (node, root) per node, root the smallest node of its component.

    Each task first turns the links it holds into stars; rounds of large and small stars join what is left. While links are few,
    a round's stages have few tasks and least neighbours are broadcast; else both sides of their joins are written, so that a hub's links can be split.
    """
    edges = cut(edges.where("u != v").select("u", "v").mapInArrow(tidied(_stars), "u long, v long").distinct(), "edges")
    before, n = None, edges.count()
    while True:
        few = n <= BROADCAST_ROWS
        hold = (lambda df, name: F.broadcast(in_few_tasks(df))) if few else small
        both = edges.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
        least_of = hold(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
        large_star = both.join(least_of, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large_star = in_few_tasks(large_star) if few else cut(large_star, "large")
        least = hold(large_star.groupBy("u").agg(F.min("v").alias("m")), "least")
        joined = large_star.join(least, "u")
        hung = joined.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u != v")
        edges = cut(in_few_tasks(hung.distinct(), few), "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before, n = now, now[0]


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: its id, __fp and component_id (the smallest id its links reach)."""
    marked = cut(with_fingerprint(df.select(id_col, text_col), text_col).select(id_col, "__fp"), "prints")
    return _classes(marked, id_col)


def _classes(marked: DataFrame, id_col: str) -> DataFrame:
    own = marked.groupBy("__fp").agg(F.min(id_col).alias("__own"))
    found = components(links(own.select("__fp")))
    linked = own.join(found.unionByName(found.select(F.col("root").alias("node"), "root").distinct()), own["__fp"] == F.col("node"))
    linked = cut(linked.select("node", "root", "__own"), "linked")
    smallest = small(in_few_tasks(linked.groupBy("root").agg(F.min("__own").alias("__min")), linked.count() <= BROADCAST_ROWS), "smallest")
    ids = linked.join(smallest, "root").select("node", "__min")
    ids = own.join(ids, own["__fp"] == F.col("node"), "left").select("__fp", F.coalesce("__min", "__own").alias("component_id"))
    return marked.join(cut(ids, "classes"), "__fp")  # both sides are plain shuffles, so a hot fingerprint's rows can be split


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("__fp")), 16, "0").alias("fingerprint"), "component_id")


ORACLE_SQL = None  # XXH64 and the components have no DuckDB form; tests hold the query against brute force
