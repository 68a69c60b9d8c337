"""Document fingerprints by a randomised edit embedding, bit-sampled.

A text is cut into pieces of ``PIECE`` code points, and a random walk goes over
each piece: at step j the walk notes where it stands and moves on by one code
point or stays, as a random function of j and the code point says that all walks
share. After an edit two walks soon stand at the same place of what is equal
again, and then stay together, so texts a few edits apart become sequences a
small Hamming distance apart. A walk takes two steps for a code point and a few
more, which is how long it takes to reach the end; there it stays.

A fingerprint samples the embedding at ``SLOTS`` steps. A slot's steps have
random ranks, and it takes the step of least rank that the text's embedding has,
so texts of any length are sampled evenly, and two lengths mostly at the same
steps. The sample is eight bits of a hash of the slot, the step and the code
points found there (that one and the next two, so that unlike texts seldom agree
by chance). Likeness is the share of slots that agree, 0 to 1.

``classes`` finds near copies: bands of ``BAND`` sampled slots, each slot in at
most one, are keys; fingerprints that share a key are compared slot by slot.
Buckets above ``BUCKET`` are divided into pairs of chunks, each bucket's own, so
none is left out and no task holds an unbounded group; a spanning forest of the
links leaves a bucket. A pair of likeness 0.8 shares a key with a probability of
0.998. Fingerprints are told apart by 64 bits there.

``edited_prints`` also needs each document's next one. Rows go to blocks of
descending id by quantiles; rows of a hot id are divided further by a hash of
their texts. Texts move once, compressed, and the first row of a block is also
sent to the block before it.

Edge cases: a null text counts as empty; all empty texts have one fingerprint;
ids are BIGINT; null ids come last in the order and keep their rows; rows that
share an id are ordered by a hash of their texts; of equal rows in one block
each is the next of the other. Whole texts are read, at any length. An empty
table gives an empty result. Only the id and the text are read, so clashing
names do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from hashlib import sha256
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondera.llm.chunks import mixed, pressed, released, text_bytes
from sondera.llm.common import cut, documents, small, text_batches, text_or_empty, tidied
from sondera.llm.simhash import components

NAME = "op12_document_fingerprints"
PIECE, SLOTS, SEED = 4096, 128, 12
BAND, BANDS = 6, 21
LIKENESS = 0.8
BUCKET = 2048
BLOCK_BYTES, BLOCKS = 8 << 20, 1 << 14  # of a range of ids; so many ranges at most
GROUP = 2 << 20  # code points that walk at once, about
STEPS = 64  # of a walk that are kept until the samples among them are taken
_LOWEST = -(1 << 63)


def steps(n: int) -> int:
    """Steps of a walk over ``n`` code points."""
    return 2 * n + 2 * isqrt(n)


_FULL = steps(PIECE)


@cache
def _random() -> tuple[np.ndarray, np.ndarray]:
    """Moves by step and class of code point; by slot the steps (from 1) whose rank is less than that of all steps before them."""
    rng = np.random.default_rng(SEED)
    moves = rng.integers(0, 2, (_FULL + STEPS, 256), dtype=np.uint8)
    ranked = [np.ones(SLOTS)]
    while ranked[-1].min() < 2.0**50:
        ranked.append(np.floor(ranked[-1] / (1 - rng.random(SLOTS))) + 1)
    return moves, np.minimum(np.stack(ranked, axis=1), 2.0**52).astype(np.int64)


def _walk(kinds: np.ndarray, start: np.ndarray, last: np.ndarray, piece: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Where the walks over pieces (start..last) stand at the sampled (piece, step)."""
    moves = _random()[0]
    need = np.full(len(start), -1)
    np.maximum.at(need, piece, step)
    order = np.argsort(-need, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    at, last, need = start[order], last[order], -need[order]
    by_step = np.argsort(step, kind="stable")
    ends = np.searchsorted(step[by_step], np.arange(0, _FULL + STEPS, STEPS))
    out = np.zeros(len(step), np.int64)
    for k in range(len(ends) - 1):
        n = int(np.searchsorted(need, -k * STEPS, "right"))  # walks that go on
        if not n:
            break
        p, end, seen = at[:n], last[:n], np.empty((STEPS, n), np.int64)
        for j in range(STEPS):
            seen[j] = p
            p += moves[k * STEPS + j].take(kinds.take(p))
            np.minimum(p, end, out=p)
        own = by_step[ends[k] : ends[k + 1]]
        out[own] = seen[step[own] - k * STEPS, rank[piece[own]]]
    return out


def prints(texts: list[str]) -> np.ndarray:
    """Fingerprints of texts: a row of ``SLOTS`` bytes each."""
    records = _random()[1]
    sizes = np.array([len(t) for t in texts], np.int64)
    codes = np.frombuffer("".join(t + "\0\0" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = (codes * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.uint8)
    begin = np.cumsum(sizes + 2) - sizes - 2
    full, rest = np.divmod(sizes, PIECE)
    length = full * _FULL + np.array([steps(int(r)) for r in rest], np.int64)
    sampled = np.stack([r[np.maximum(np.searchsorted(r, length, "right") - 1, 0)] - 1 for r in records], axis=1)
    has = np.broadcast_to((sizes > 0)[:, None], sampled.shape)
    text, slot = np.nonzero(has)
    place = sampled[text, slot]
    nth, step = np.divmod(place, _FULL)
    most = int(nth.max(initial=0)) + 1
    pieces, piece = np.unique(text * most + nth, return_inverse=True)
    of, nth = np.divmod(pieces, most)
    start = begin[of] + nth * PIECE
    last = np.minimum(start + PIECE, begin[of] + sizes[of]) - 1
    at = _walk(kinds, start, last, piece, step)
    found, where = np.zeros(sampled.shape, np.uint64), np.full(sampled.shape, -1, np.int64)
    wide = codes.astype(np.uint64)
    found[text, slot] = wide[at] | wide[at + 1] << np.uint64(21) | wide[at + 2] << np.uint64(42)
    where[text, slot] = place
    slots = np.arange(1, SLOTS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed(found ^ mixed(where.view(np.uint64) + slots)) >> np.uint64(56)).astype(np.uint8)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=-1)


# ------------------------------------------------------------ the next document


def _blocks(rows: DataFrame, n_bytes: int) -> np.ndarray:
    """Upper bounds of the keys of all blocks but the last."""
    n = min(BLOCKS, max(1, n_bytes // BLOCK_BYTES))
    if n == 1:
        return np.zeros(0, np.int64)
    found = rows.agg(F.percentile_approx("key", [i / n for i in range(1, n)], 4 * n)).first()[0]
    return np.array(found or [], np.int64)


def block_of(bounds: np.ndarray, key: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """Blocks in the order of (key, mark); where a key bounds several, the mark (0 to 2 ** 63 - 1) tells which of them."""
    lo = np.searchsorted(bounds, key, "left")
    n = np.searchsorted(bounds, key, "right") - lo
    return lo + np.minimum(np.floor(mark / 2.0**63 * n).astype(np.int64), np.maximum(n - 1, 0))


_SENT = "block int, copy int, key long, mark long, id long, body binary"
_PRINTS = "id long, n_chars long, edited_sha256 string, print binary, edited_print binary, near_edited double, near_next double"


def edited_prints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: id, n_chars, its fingerprint, that of its edited text, and their likeness to it and to the next document's.

    The edited text: the last third of the code points (rounded down) replaced by the first as many of the next document, by descending
    id; the last document's next is the first.
    """
    text_batches(df.sparkSession)
    id_, text = F.col(id_col).cast("long"), text_or_empty(text_col)
    mark = F.shiftrightunsigned(F.xxhash64(text), 1)
    rows = df.select(F.coalesce(id_, F.lit(_LOWEST)).alias("key"), mark.alias("mark"), id_.alias("id"), text.alias("text"))
    n_bytes = text_bytes(df, text_col)
    bounds = _blocks(rows, n_bytes)

    def firsts(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            key, mark = (batch.column(i).to_numpy() for i in range(2))
            order = np.lexsort((mark, key))
            block = block_of(bounds, key[order], mark[order])
            top = np.flatnonzero(np.diff(block, append=-1))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (block[top].astype(np.int32), key[order][top], mark[order][top])], ["block", "key", "mark"])

    top = rows.select("key", "mark").mapInArrow(tidied(firsts), "block int, key long, mark long").groupBy("block").agg(F.max(F.struct("key", "mark")).alias("top")).collect()  # of BLOCKS rows at most
    top = sorted((r["block"], r["top"]["key"], r["top"]["mark"]) for r in top)
    before = {t[1:]: top[(i + 1) % len(top)][0] for i, t in enumerate(top)}  # a block's first row -> the block whose last row it follows

    def send(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            key, mark = (batch.column(i).to_numpy() for i in range(2))
            block = block_of(bounds, key, mark).astype(np.int32)
            bodies = [pressed(t.as_py()) for t in batch.column(3).cast(pa.binary())]
            first = [i for i, x in enumerate(zip(key.tolist(), mark.tolist(), strict=True)) if x in before]
            to = pa.array(np.r_[block, np.array([before[int(key[i]), int(mark[i])] for i in first], np.int32)])
            of = np.r_[np.arange(len(key)), np.array(first, np.int64)]
            copy = pa.array((np.arange(len(of)) >= len(key)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([to, copy, pa.array(key[of]), pa.array(mark[of]), batch.column(2).take(pa.array(of)), pa.array(bodies, pa.binary()).take(pa.array(of))], [c.split()[0] for c in _SENT.split(", ")])

    def fingerprints(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: list[tuple] = []

        def table() -> pa.RecordBatch:
            texts, edited = [t for _, t, _ in pairs], [t[: len(t) - len(t) // 3] + next_[: len(t) // 3] for _, t, next_ in pairs]
            last = [t for (_, _, t), (_, own, _) in zip(pairs, [*pairs[1:], (0, None, 0)], strict=True) if t is not own]
            at = np.cumsum([t is not own for (_, _, t), (_, own, _) in zip(pairs, [*pairs[1:], (0, None, 0)], strict=True)])
            made = prints(texts + edited + last)
            own, other = made[: len(pairs)], made[len(pairs) : 2 * len(pairs)]
            follows = np.array([2 * len(pairs) + at[i] - 1 if i + 1 == len(pairs) or pairs[i][2] is not pairs[i + 1][1] else i + 1 for i in range(len(pairs))])
            columns = [[i for i, _, _ in pairs], [len(t) for t in texts], [sha256(t.encode()).hexdigest() for t in edited], list(map(bytes, own)), list(map(bytes, other)), likeness(own, other), likeness(own, made[follows])]
            types = [pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [c.split()[0] for c in _PRINTS.split(", ")])

        held, size, block = None, 0, -1
        for batch in found:
            for own, copy, id_, body in zip(*(batch.column(c).to_pylist() for c in ("block", "copy", "id")), batch.column("body"), strict=True):
                if copy and (held is None or own != block):
                    continue
                text = released(body.as_py()).decode()
                if own == block and held is not None:
                    pairs.append((*held, text))
                    size += len(held[1])
                    if size >= GROUP:
                        yield table()
                        pairs.clear()
                        size = 0
                held, block = None if copy else (id_, text), own
        if pairs:
            yield table()

    own = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = rows.mapInArrow(tidied(send), _SENT).repartition(max(own, n_bytes // (64 << 20)), "block")
    return sent.sortWithinPartitions("block", "copy", F.desc("key"), F.desc("mark")).mapInArrow(tidied(fingerprints), _PRINTS)


# ------------------------------------------------------------------ near copies


def _keys(batch_prints: np.ndarray) -> np.ndarray:
    """By fingerprint the keys of its bands: six sampled slots each."""
    slots = np.random.default_rng(SEED).permutation(SLOTS)[: BAND * BANDS].reshape(BANDS, BAND)
    raw = np.zeros((len(batch_prints), BANDS, 8), np.uint8)
    raw[:, :, :BAND] = batch_prints[:, slots]
    raw[:, :, BAND] = np.arange(BANDS)
    return mixed(raw.view(np.uint64)[..., 0]).view(np.int64)


def bucket_links(keys: np.ndarray, table: np.ndarray, least: int) -> tuple[list[int], list[int]]:
    """A spanning forest of the pairs with equal (sorted) keys that agree in ``least`` slots or more."""
    left, right, tree = [], [], np.arange(len(keys))

    def root(i: int) -> int:
        while tree[i] != i:
            tree[i] = tree[tree[i]]
            i = int(tree[i])
        return i

    i = np.arange(len(keys))
    d = 0
    while len(i):
        d += 1
        i = i[i + d < len(keys)]
        i = i[keys[i] == keys[i + d]]  # who has no partner at this distance has none beyond
        open_ = i[tree[i] != tree[i + d]]
        for at in range(0, len(open_), 1 << 14):
            some = open_[at : at + (1 << 14)]
            for a in some[(table[some] == table[some + d]).sum(axis=1) >= least].tolist():
                x, y = root(a), root(a + d)
                if x != y:
                    tree[max(x, y)] = min(x, y)
                    left.append(a)
                    right.append(a + d)
        while (up := tree[tree]).tobytes() != tree.tobytes():
            tree = up
    return left, right


def links(distinct: DataFrame, likeness: float = LIKENESS, bucket: int = BUCKET) -> DataFrame:
    """Links (u, v) that connect all fingerprints (node, print) that share a band and are alike, some more than once."""
    least = int(np.ceil(likeness * SLOTS))

    def keyed(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            table = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, SLOTS)
            yield pa.RecordBatch.from_arrays([pa.array(_keys(table).ravel()), batch.column(0).take(pa.array(np.repeat(np.arange(len(table)), BANDS)))], ["k", "node"])

    rows = distinct.select("node", "print").mapInArrow(tidied(keyed), "k long, node long")
    sizes = small(rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "bands")
    rows = rows.join(sizes, "k").withColumn("c", F.ceil(F.col("n") / bucket).cast("int")).join(distinct.select("node", "print"), "node")
    own = F.pmod(F.xxhash64("node"), F.col("c")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("c") - 1), lambda j: F.least(own, j) * F.col("c") + F.greatest(own, j))
    rows = rows.select("k", F.explode(pairs).alias("p"), "node", "print").repartition("k", "p").sortWithinPartitions("k", "p", "node")

    def compare(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(last: bool) -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            k, p, node = (table.column(c).to_numpy() for c in ("k", "p", "node"))
            key = np.cumsum(np.r_[0, (k[1:] != k[:-1]) | (p[1:] != p[:-1])])
            n = len(key) if last else int(np.searchsorted(key, key[-1]))  # the last bucket may go on
            held[:] = [] if last else table.slice(n).to_batches()
            made = np.frombuffer(b"".join(table.column("print").slice(0, n).to_pylist()), np.uint8).reshape(-1, SLOTS)
            u, v = bucket_links(key[:n], made, least)
            return pa.RecordBatch.from_arrays([pa.array(node[np.array(x, np.int64)]) for x in (u, v)], ["u", "v"])

        for batch in found:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= 2 * BUCKET * 2:
                yield flush(False)
        if held:
            yield flush(True)

    return rows.mapInArrow(tidied(compare), "u long, v long")


def classes(found: DataFrame, likeness: float = LIKENESS, bucket: int = BUCKET) -> DataFrame:
    """``found`` (id, print, ...; written) with class_id: the smallest id among those that links of at least ``likeness`` reach, itself included."""
    node = F.xxhash64("print").alias("node")
    distinct = cut(found.groupBy(node).agg(F.min("id").alias("own"), F.min("print").alias("print")), "distinct")
    linked = components(links(distinct, likeness, bucket))
    linked = linked.unionByName(linked.select(F.col("root").alias("node"), "root").distinct())
    linked = cut(linked.join(distinct.select("node", "own"), "node"), "linked")
    least = small(linked.groupBy("root").agg(F.min("own").alias("least")), "least")
    own = distinct.select("node", "own").join(linked.join(least, "root").select("node", "least"), "node", "left").select("node", F.coalesce("least", "own").alias("class_id"))
    return found.withColumn("node", F.xxhash64("print")).join(cut(own, "classes"), "node").drop("node")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(cut(edited_prints(documents(spark, sf_dir)), "prints"))
    hexed = lambda c: F.lower(F.hex(c))
    return found.select(F.col("id").alias("doc_id"), "n_chars", "edited_sha256", hexed("print").alias("fingerprint"), hexed("edited_print").alias("edited_fingerprint"), "near_edited", "near_next", "class_id")


ORACLE_SQL = None  # the walks have no SQL form; tests hold them against walks made step by step, and classes against all pairs
