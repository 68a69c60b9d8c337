"""Language-model scores by deleted interpolation of maximum-likelihood n-grams.

The model of a token w after the tokens g, h is
    l3 * c(g, h, w) / c(g, h)  +  l2 * c(h, w) / c(h)  +  l1 * c(w) / N  +  l0 / (V + 1),
with weights for each bucket of contexts, a bucket being a power of two of
c(g, h) and a power of four of c(h). A text's first token has no g: c(h, w) / c(h)
stands in. One part of the training documents is deleted (crc32 remainder 1);
counts of the others give the n-grams from which expectation-maximisation on the
deleted part learns the weights. Scores then use the counts of all training
documents.

All documents count, and the counts are never gathered in one place. Documents
are packed (see ``chunks``). A pack sends each distinct n-gram once, as sorted
hashes cut into hash ranges ("buckets"); a bucket adds up what all packs sent and
answers each with the corpus counts in the same order; the answers meet the pack
again. Packs and buckets are of bounded size, and a very frequent n-gram is one
number per pack. Words are told apart by 64 bits, longer n-grams by ``KEY_BITS``,
so one in 2**52 / (number of n-grams) shares its count with another. EM sees the
deleted part as a histogram over (context bucket, logs of the three ratios),
whose size is fixed by its bins.

Edge cases: a null text is the end token alone; a null id counts as the empty
text for crc32, so it is held out; with no training text at all, n-gram terms
are zero and the uniform term scores; repeated rows are scored, and counted, each
for itself; an empty table gives an empty result. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondera.llm.chunks import dealt, deltas, from_planes, mixed, n_buckets, opened, packs, planes, text_bytes, word_hashes
from sondera.llm.common import cut, documents, tidied

NAME = "op9_lm_scoring"
FOLDS, HELD_OUT, DELETED = 10, 0, 1
KINDS = {"training": 0, "deleted": 1, "held out": 2}  # of packs
ALPHA = 0.1  # of the base score
CHUNK_BYTES, BUCKET_BYTES = 8 << 20, 8 << 20
ORDERS, KEY_BITS = (1, 2, 3), 52
PAIR_CONTEXTS, WORD_CONTEXTS, STEP, ROUNDS = 12, 12, 4, 40  # context buckets; histogram bins per factor of ten; EM rounds
_END, _LEFT, _RIGHT = b" ", np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Grams:
    """Tokens of some texts: keys of each order (sorted, distinct), and each token's place among them."""

    def __init__(self, texts: list[bytes]):
        found = [word_hashes([*text.lower().split(), _END]) for text in texts]
        self.n_tokens = np.fromiter(map(len, found), np.int64, len(found))
        tokens = np.concatenate(found)
        self.doc = np.repeat(np.arange(len(texts)), self.n_tokens)
        self.start = np.r_[True, self.doc[1:] != self.doc[:-1]]
        pairs = mixed(np.roll(tokens, 1) * _LEFT + tokens * _RIGHT)  # the first token of a text follows the end of the one before
        triples = mixed(np.roll(pairs, 1) * _LEFT + tokens * _RIGHT)
        triples[self.start] = 0  # these are never asked for
        short = np.uint64(64 - KEY_BITS)
        self.keys, self.at = zip(*(np.unique(x, return_inverse=True) for x in (tokens, pairs >> short, triples >> short)), strict=True)

    def counts(self, order: int) -> np.ndarray:
        return np.bincount(self.at[order - 1], minlength=len(self.keys[order - 1]))


def _limits(order: int, buckets: int) -> np.ndarray:
    bits = 64 if order == 1 else KEY_BITS
    return np.array([(i << bits) // buckets for i in range(1, buckets)], np.uint64)


_ASKED = "bucket int, chunk long, kind int, n array<int>, body array<binary>"
_TOLD = "chunk long, kind int, bucket int, n array<int>, body array<binary>, total long, v long, n_kept long, v_kept long"
_TYPES = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32()), "array<binary>": pa.list_(pa.binary())}


def _table(columns: list, schema: str) -> pa.Table:
    fields = [x.split() for x in schema.split(", ")]
    columns = columns or [[]] * len(fields)
    return pa.table([pa.array(c, _TYPES[t]) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def _ask(buckets: int):
    def of_packs(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for i in range(batch.num_rows):
                chunk, kind, _, texts = opened(batch, i)
                grams = Grams(texts)
                counts = [grams.counts(o) for o in ORDERS]
                ends = [[0, *np.searchsorted(k, _limits(o, buckets)).tolist(), len(k)] for o, k in zip(ORDERS, grams.keys, strict=True)]
                rows = []
                for b in range(buckets):
                    spans = [slice(e[b], e[b + 1]) for e in ends]
                    n = [s.stop - s.start for s in spans]
                    if any(n):
                        rows.append((b, chunk, kind, n, [planes(deltas(k[s]), c[s]) for k, c, s in zip(grams.keys, counts, spans, strict=True)]))
                yield from _table(list(zip(*rows, strict=True)), _ASKED).to_batches()

    return of_packs


def _tell(asked: pa.Table) -> pa.Table:
    """Corpus counts of a bucket's n-grams: of all training documents, and for deleted packs also of those kept."""
    kinds, chunks, sizes, bodies = (asked.column(c).to_pylist() for c in ("kind", "chunk", "n", "body"))
    kinds_, answers, stats = np.array(kinds), [[] for _ in kinds], [0, 0, 0, 0]
    for at in range(len(ORDERS)):
        n = np.array([s[at] for s in sizes], np.int64)
        if not n.sum():
            for own in answers:
                own.append(planes())
            continue
        parts = [from_planes(b[at], s[at]) for b, s in zip(bodies, sizes, strict=True) if s[at]]
        keys = np.concatenate([np.cumsum(p[0]) for p in parts])
        counts = np.concatenate([p[1] for p in parts]).astype(np.int64)
        kind = np.repeat(kinds_, n)
        found, place = np.unique(keys, return_inverse=True)
        total, kept = (np.bincount(place, weights=np.where(of, counts, 0), minlength=len(found)).astype(np.uint64) for of in (kind != KINDS["held out"], kind == KINDS["training"]))
        if not at:
            stats = [int(total.sum()), int((total > 0).sum()), int(kept.sum()), int((kept > 0).sum())]
        ends = np.cumsum(n).tolist()
        for own, k, size, end in zip(answers, kinds, n.tolist(), ends, strict=True):
            mine = place[end - size : end]
            own.append(planes(total[mine], *[kept[mine]] * (k == KINDS["deleted"])))
    bucket = asked.column("bucket")[0].as_py()
    rows = [(c, k, bucket, n, body, 0, 0, 0, 0) for c, k, n, body in zip(chunks, kinds, sizes, answers, strict=True)]
    return _table(list(zip(*rows, (-1, -1, bucket, [], [], *stats), strict=True)), _TOLD)


def _answers(told: pa.Table, order: int, n: int, kept: bool = False) -> np.ndarray:
    """Counts of a pack's n-grams of one order, in the order of its keys."""
    told = told.sort_by("bucket")
    sizes = [s[order - 1] for s in told.column("n").to_pylist()]
    parts = [from_planes(b[order - 1], s)[int(kept)] for b, s in zip(told.column("body").to_pylist(), sizes, strict=True) if s]
    counts = np.concatenate([np.zeros(0), *parts])
    if len(counts) != n:
        raise ValueError(f"{len(counts)} counts for {n} n-grams")
    return counts.astype(float)


def _terms(grams: Grams, told: pa.Table, n: float, kept: bool) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """For each token: c(w), its context bucket, and the ratios of the three orders."""
    one, two, three = (_answers(told, o, len(k), kept) for o, k in zip(ORDERS, grams.keys, strict=True))
    c, pair = one[grams.at[0]], two[grams.at[1]]
    h, gh = np.roll(c, 1), np.roll(pair, 1)
    f2 = pair / np.maximum(h, 1)
    f3 = np.where(grams.start, f2, three[grams.at[2]] / np.maximum(gh, 1))
    gh = np.where(grams.start, h, gh)
    context = np.minimum(np.log2(gh + 1).astype(np.int64), PAIR_CONTEXTS - 1) * WORD_CONTEXTS + np.minimum(np.log2(h + 1).astype(np.int64) // 2, WORD_CONTEXTS - 1)
    return c, context, [f3, f2, c / max(n, 1)]


def _bin(f: np.ndarray) -> np.ndarray:
    return np.where(f > 0, np.floor(np.log10(np.maximum(f, 1e-15)) * STEP), -99).astype(np.int64)


_SEEN = "b long, q3 long, q2 long, q1 long, n double, f3 double, f2 double, f1 double"


def _histogram(n_kept: int):
    def of_pack(pack: pa.Table, told: pa.Table) -> pa.Table:
        if not len(pack):
            return _table([], _SEEN)
        grams = Grams(opened(pack)[3])
        _, context, f = _terms(grams, told, n_kept, True)
        code = context
        for x in f:
            code = code * 200 + _bin(x) + 100
        cells, at, n = np.unique(code, return_inverse=True, return_counts=True)
        q = [cells // 200**k % 200 - 100 for k in (2, 1, 0)]
        return _table([cells // 200**3, *q, n.astype(float), *(np.bincount(at, weights=x) for x in f)], _SEEN)

    return of_pack


def learn(seen: list[tuple], v: int) -> np.ndarray:
    """Weights (three, two, one token, uniform) of each context bucket by EM on the histogram of the deleted part."""
    contexts = PAIR_CONTEXTS * WORD_CONTEXTS
    weights = np.tile([0.3, 0.3, 0.3, 0.1], (contexts, 1))
    if not seen:
        return weights
    b, n, *f = (np.array([r[i] for r in seen], float) for i in (0, 4, 5, 6, 7))
    b = b.astype(int)
    f = np.stack([*(x / n for x in f), np.full(len(n), 1 / (v + 1))], axis=1)
    for _ in range(ROUNDS):
        share = weights[b] * f
        share *= (n / share.sum(axis=1))[:, None]
        total = np.stack([np.bincount(b, weights=share[:, k], minlength=contexts) for k in range(4)], axis=1) + 1e-3
        weights = total / total.sum(axis=1, keepdims=True)
    return weights


_SCORES = "id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _score(weights: np.ndarray, n: int, v: int):
    def of_pack(pack: pa.Table, told: pa.Table) -> pa.Table:
        if not len(pack):
            return _table([], _SCORES)
        _, kind, ids, texts = opened(pack)
        grams = Grams(texts)
        c, context, f = _terms(grams, told, n, False)
        lam = weights[context]
        p = sum(lam[:, i] * x for i, x in enumerate(f)) + lam[:, 3] / (v + 1)
        by_doc = lambda x: np.bincount(grams.doc, weights=x, minlength=len(ids))
        base = by_doc(np.log10((c + ALPHA) / (n + ALPHA * (v + 1))))
        return _table([ids, [kind == KINDS["held out"]] * len(ids), grams.n_tokens, by_doc(c > 0).astype(np.int64), base, by_doc(np.log10(p))], _SCORES)

    return of_pack


def lm_scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    size = text_bytes(df, text_col)
    buckets = n_buckets(size, BUCKET_BYTES)
    fold = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % FOLDS
    kind = F.when(fold == HELD_OUT, KINDS["held out"]).when(fold == DELETED, KINDS["deleted"]).otherwise(KINDS["training"])
    packed = packs(df, id_col, text_col, CHUNK_BYTES, kind)
    asked = dealt(packed.mapInArrow(tidied(_ask(buckets)), _ASKED), "bucket", size)
    told = cut(asked.groupBy("bucket").applyInArrow(_tell, _TOLD), "counts")
    n, v, n_kept, v_kept = told.where("kind = -1").agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("total", "v", "n_kept", "v_kept")]).first()
    is_deleted = F.col("kind") == KINDS["deleted"]
    deleted = dealt(packed.where(is_deleted), "chunk", size).groupBy("chunk").cogroup(dealt(told.where(is_deleted), "chunk", size).groupBy("chunk"))
    seen = deleted.applyInArrow(_histogram(n_kept), _SEEN).groupBy("b", "q3", "q2", "q1").agg(*[F.sum(c) for c in ("n", "f3", "f2", "f1")]).collect()
    weights = learn(sorted(tuple(r) for r in seen), v_kept)
    scored = dealt(packed, "chunk", size).groupBy("chunk").cogroup(dealt(told.where("kind >= 0"), "chunk", size).groupBy("chunk")).applyInArrow(_score(weights, n, v), _SCORES)
    return scored.withColumn("train_tokens", F.lit(n).cast("long")).withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lm_scores(documents(spark, sf_dir))
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


ORACLE_SQL = None  # EM has no SQL form; tests hold the base score and the model against brute force
