"""The pipeline's near-duplicate stage: all pairs of texts whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more.

Nothing is estimated; every pair at or above the bound is found.

1. Candidates by prefixes. In any fixed order of all shingles, two sets of
   similarity t share one of the first n - ceil(t n) + 1 shingles of each. The
   order puts rare shingles first: a count of shingles by ``CELLS`` hash cells,
   merged over the partitions, gives each a power of two, and the hash breaks
   ties. The counts decide how many candidates there are, never which pairs are found.
2. Each prefix shingle is a bucket of rows. Buckets of one are dropped, and of
   buckets with the same rows one stays. A bucket above ``BUCKET`` rows or
   ``BUCKET_BYTES`` is split into chunks, and every pair of chunks is a bucket of
   its own. Buckets compare SimHash fingerprints of the shingle sets as op6 does, by
   vertical bit planes and carry-save counters, many buckets at once: pairs with at most
   ``RADIUS`` differing bits are proposed. Bit sketches check them: a shingle toggles one bit of
   about n, so two sketches differ in no more bits than the sets in shingles,
   and a pair whose sketches differ too much is none. SimHash has no bound that
   holds for every pair, so rows of different groups compare sketches, too. Rows that are left in
   one group meet their whole texts, compressed, and exact overlaps of shingle sets decide; of a
   group's links a spanning forest leaves it.
3. Connected components as in op6, on row keys; one row of each stays.

Edge cases: a text of five words or fewer is one shingle; null and blank texts
are one shingle, too, and near copies of each other. Of a component the row
with the smallest id stays, null ids rank last, and ties go to the first row
written. Rows that share an id are rows of their own. An empty table gives an
empty result. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sondera.llm.chunks import pressed, released
from sondera.llm.common import cut, sliced, small, text_batches, tidied
from sondera.llm.simhash import bucket_links, components, majority

SHINGLE = 5
SHARE = (4, 5)  # least similarity, as a fraction of whole numbers
CELLS = 1 << 18
BUCKET, BUCKET_BYTES = 1024, 4 << 20
RADIUS = 15  # differing bits of 64: sets of similarity 0.8 differ in about 10
PLANES = 1 << 13  # rows whose fingerprints are compared at once, besides the last bucket's


def shingle_set(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a UTF-8 text's shingles."""
    import xxhash

    words = (text or b"").lower().split()
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh3_64_intdigest(joined)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths)
    spans = map(slice, (ends - lengths)[: 1 - size].tolist(), (ends - 1)[size - 1 :].tolist())
    return np.unique(np.fromiter(map(xxhash.xxh3_64_intdigest, map(joined.__getitem__, spans), repeat(0)), np.uint64, len(words) - size + 1))


def prefix(hashes: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The first n - ceil(t n) + 1 shingles in the order of (rank of the cell, hash)."""
    n = len(hashes)
    most = n - -(-SHARE[0] * n // SHARE[1]) + 1
    return hashes[np.argsort(ranks[hashes % np.uint64(CELLS)], kind="stable")[:most]]


def forest(sets: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """A spanning forest of the pairs of sets that are similar enough; pairs already in one tree are not compared."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    ends = np.cumsum(sizes)
    mark = np.zeros(ids.max() + 1, np.int64)
    lab, left, right = np.arange(len(sets)), [], []
    for i in range(len(sets) - 1):
        small, large = np.minimum(sizes, sizes[i]), np.maximum(sizes, sizes[i])
        others = np.flatnonzero((lab != lab[i]) & (np.arange(len(sets)) > i) & (SHARE[1] * small >= SHARE[0] * large))
        if not len(others):
            continue
        own = ids[ends[i] - sizes[i] : ends[i]]
        mark[own] = 1
        shared = np.fromiter((mark[ids[ends[j] - sizes[j] : ends[j]]].sum() for j in others.tolist()), np.int64, len(others))
        mark[own] = 0
        for j in others[SHARE[1] * shared >= SHARE[0] * (sizes[i] + sizes[others] - shared)].tolist():
            if lab[i] != lab[j]:
                left.append(i)
                right.append(j)
                lab[lab == lab[j]] = lab[i]
    return left, right


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Parity of the shingles in each of 2**k >= n hash cells, 64 or more, as words; halves XORed give the next smaller sketch."""
    bits = max(64, 1 << (len(hashes) - 1).bit_length())
    odd = np.bincount(((hashes >> np.uint64(24)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.uint64)


def may_be_near(sizes: tuple[int, int], sketches: tuple[np.ndarray, np.ndarray]) -> bool:
    """Whether two sets' sizes and sketches allow the least similarity."""
    small, large = sorted(sketches, key=len)
    if SHARE[1] * min(sizes) < SHARE[0] * max(sizes):
        return False
    if len(large) > len(small):
        large = large[: len(small)] ^ large[len(small) :]
    return (SHARE[1] + SHARE[0]) * int(np.bitwise_count(small ^ large).sum(dtype=np.int64)) <= (SHARE[1] - SHARE[0]) * sum(sizes)


def sketch_groups(sizes: np.ndarray, sketches: list[np.ndarray], pairs: list[tuple[int, int]]) -> np.ndarray:
    """Group labels that hold together all pairs of sets whose sizes and sketches allow the least similarity.

    The pairs of the fingerprints come first; the pairs that they leave in different groups follow.
    """
    lab, words = np.arange(len(sizes)), np.fromiter(map(len, sketches), np.int64, len(sizes))
    for i, j in pairs:
        if lab[i] != lab[j] and may_be_near((int(sizes[i]), int(sizes[j])), (sketches[i], sketches[j])):
            lab[lab == lab[j]] = lab[i]
    for width in np.unique(words).tolist():
        own, twice = np.flatnonzero(words == width), np.flatnonzero(words == 2 * width)
        at = np.r_[own, twice]
        made = np.stack([*(sketches[x] for x in own), *(sketches[x][:width] ^ sketches[x][width:] for x in twice)])
        for x, i in enumerate(own.tolist()):
            rest = at[x + 1 :]
            small, large = np.minimum(sizes[rest], sizes[i]), np.maximum(sizes[rest], sizes[i])
            open_ = np.flatnonzero((lab[rest] != lab[i]) & (SHARE[1] * small >= SHARE[0] * large))
            apart = np.bitwise_count(made[x + 1 + open_] ^ made[x]).sum(axis=1, dtype=np.int64)
            near = (SHARE[1] + SHARE[0]) * apart <= (SHARE[1] - SHARE[0]) * (sizes[i] + sizes[rest[open_]])
            for j in rest[open_[near]].tolist():
                if lab[i] != lab[j]:
                    lab[lab == lab[j]] = lab[i]
    return lab


def _texts(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    texts = batch.column(batch.schema.get_field_index("text")).cast(pa.binary())
    return (shingle_set(t.as_py()) for t in texts)


def _ranks(rows: DataFrame) -> np.ndarray:
    """The power of two of each cell's count of shingles."""

    def of_partition(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for batch in sliced(found):
            cells = np.concatenate(list(_texts(batch))) % np.uint64(CELLS)
            total += np.bincount(cells.astype(np.int64), minlength=CELLS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["cell", "n"])

    counts = rows.select("text").mapInArrow(tidied(of_partition), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    ranks = np.zeros(CELLS, np.uint8)
    ranks[counts.column("cell").to_numpy()] = np.log2(counts.column("n").to_numpy()).astype(np.uint8)
    return ranks


def _by_key(keys: list[str], values: list[str], of_groups, names: list[str], most: int = 1, most_bytes: int = BUCKET_BYTES):
    """A mapInArrow function that hands runs of equal ``keys`` to ``of_groups``, in lists of about ``most`` rows or ``most_bytes``, and yields the int64 columns it gives."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, groups, n, size, out = None, [], 0, 0, [[] for _ in names]
        for batch in sliced(found, values[-1]):
            cols = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in keys + values]
            for at, *rest in zip(zip(*cols[: len(keys)], strict=True), *cols[len(keys) :], strict=True):
                if at != key:
                    if n >= most or size >= most_bytes:
                        of_groups(groups, out)
                        groups, n, size = [], 0, 0
                    key = at
                    groups.append([])
                groups[-1].append(rest)
                n, size = n + 1, size + len(rest[-1])
            if len(out[0]) >= 1 << 16:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names)
                out = [[] for _ in names]
        of_groups(groups, out)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names)

    return run


def _grouped(buckets: list[list[list]], out: list[list]):
    """Rows (__row, g) of the groups of two or more; fingerprints propose pairs, sketches check these and the rest; g names the group's rows."""
    import xxhash

    ends = np.cumsum([0, *map(len, buckets)])
    rows, sizes, prints = (np.array([x[c] for bucket in buckets for x in bucket], np.int64) for c in range(3))
    i, j = bucket_links(np.repeat(np.arange(len(buckets)), np.diff(ends)), prints.view(np.uint64), RADIUS)
    order = np.argsort(i, kind="stable")
    pairs, firsts = np.stack([i, j], axis=1)[order], np.searchsorted(i[order], ends).tolist()
    for at, (bucket, lo, hi) in enumerate(zip(buckets, ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
        if hi - lo < 2:
            continue
        lab = sketch_groups(sizes[lo:hi], [np.frombuffer(x, np.uint64) for *_, x in bucket], (pairs[firsts[at] : firsts[at + 1]] - lo).tolist())
        order = np.argsort(lab, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(lab[order])) + 1):
            if len(part) > 1:
                own = np.sort(rows[lo:hi][part])
                out[0].extend(own.tolist())
                out[1].extend([int(np.uint64(xxhash.xxh3_64_intdigest(own.tobytes())).astype(np.int64))] * len(own))


def _link(groups: list[list[list]], out: list[list]):
    for held in groups:
        if len(held) > 1:
            for to, at in zip(out, forest([shingle_set(released(x)) for _, x in held]), strict=True):
                to.extend(held[x][0] for x in at)


def links(rows: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Links (u, v) of row keys that connect all similar pairs of ``rows`` (__row, text), some more than once."""
    text_batches(rows.sparkSession)
    ranks = rows.sparkSession.sparkContext.broadcast(_ranks(rows))

    def prefixes(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(found):
            sets = list(_texts(batch))
            first = [prefix(s, ranks.value) for s in sets]
            offsets = np.cumsum([0, *map(len, first)]).astype(np.int32)
            flat = np.concatenate(first).view(np.int64) if first else np.zeros(0, np.int64)
            sizes = pa.array(np.fromiter(map(len, sets), np.int64, len(sets)))
            prints = pa.array(np.array([majority(s) for s in sets], np.uint64).view(np.int64))
            bits = pa.array([sketch(s).tobytes() for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("__row")), sizes, prints, bits, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["__row", "size", "fp", "bits", "ks"])

    first = cut(rows.select("__row", "text").mapInArrow(tidied(prefixes), "__row long, size long, fp long, bits binary, ks array<long>"), "prefixes")
    same = Window.partitionBy("k")
    members = first.select("__row", F.col("size").cast("int").alias("size"), F.explode("ks").alias("k"))
    shared = members.select("__row", F.count(F.lit(1)).over(same).alias("n"), F.sum("size").over(same).alias("s"), F.bit_xor(F.xxhash64("__row")).over(same).alias("m")).where("n > 1")
    places = shared.groupBy("__row").agg(F.collect_set(F.struct("n", "s", "m")).alias("at"))
    met = first.select("__row", "size", "fp", "bits").join(places, "__row").select("__row", "size", "fp", "bits", F.explode("at").alias("a")).select("__row", "size", "fp", "bits", "a.*")
    met = met.withColumn("c", F.ceil(F.greatest(F.col("n") / bucket, F.col("s") * 8 / BUCKET_BYTES)).cast("int"))
    own = F.pmod(F.xxhash64("__row"), F.col("c")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("c") - 1), lambda j: F.least(own, j) * F.col("c") + F.greatest(own, j))
    key = ["m", "n", "s", "p"]
    met = met.select("m", "n", "s", F.explode(pairs).alias("p"), "__row", "size", "fp", "bits").repartition(*key).sortWithinPartitions(*key, "__row")
    grouped = met.mapInArrow(tidied(_by_key(key, ["__row", "size", "fp", "bits"], _grouped, ["__row", "g"], PLANES)), "__row long, g long")
    wanted = small(grouped.groupBy("__row").agg(F.collect_set("g").alias("gs")), "groups")

    def packed(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            cols = [batch.column(batch.schema.get_field_index(c)) for c in ("__row", "gs")]
            texts = batch.column(batch.schema.get_field_index("text")).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([*cols, pa.array([pressed(t.as_py() or b"") for t in texts], pa.binary())], ["__row", "gs", "body"])

    whole = rows.select("__row", "text").join(wanted, "__row").select("__row", "gs", "text").mapInArrow(tidied(packed), "__row long, gs array<long>, body binary")
    whole = whole.select(F.explode("gs").alias("g"), "__row", "body").repartition("g").sortWithinPartitions("g", "__row")
    return whole.mapInArrow(tidied(_by_key(["g"], ["__row", "body"], _link, ["u", "v"])), "u long, v long")


def _files_only(df: DataFrame) -> bool:
    """Whether ``df`` is read from files and nothing else, so that its rows have the same numbers each time."""
    plan = df._jdf.queryExecution().optimizedPlan()
    return plan.deterministic() and all(line.lstrip(" :+-").startswith(("Relation ", "Project ")) for line in plan.toString().strip().split("\n"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component stays: that with the smallest id, null ids last, the first row of several.

    Rows of files are numbered as they are read; those of any other plan are written first, since they are read several times.
    """
    rows = docs.withColumn("__row", F.monotonically_increasing_id())
    rows = rows if _files_only(docs) else cut(rows, "rows")
    found = components(links(rows))
    found = found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())
    named = cut(rows.select("__row", "doc_id").join(found, F.col("__row") == F.col("node")).select("root", F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "__row").alias("rank")), "members")
    stays = named.groupBy("root").agg(F.min("rank").alias("stays"))
    gone = small(named.join(stays, "root").where("rank.__row != stays.__row").select("rank.__row"), "gone")
    return rows.join(gone, "__row", "left_anti").select(docs.columns)
