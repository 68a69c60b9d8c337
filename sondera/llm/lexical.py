"""Ranked lexical search: Block-Max MaxScore over an index in shards.

The index is made in one pass over the texts and written to the shared folder:
one row is a shard of about ``SHARD_BYTES`` of text, with its terms, and for each
term a list of postings (document, occurrences) in blocks of ``BLOCK``, as
variable-length bytes. A block has its first document, its place, and what
bounds its scores: the most occurrences and the least document length in it.
These do not depend on the rest of the corpus, so shards stay valid as others
are added.

A search takes a block of queries at a time, of bounded size. One pass over the
shards' term tables adds up document frequencies; a second ranks. A task goes
through its shards and keeps one heap per query. In a shard a query's lists are
ordered by their bounds; lists are added up from the largest on, until the rest
together can not lift a document over the heap's last score: those are the
non-essential lists. Only documents found so far are looked up in them, and a
document is given up where its score so far, the bound of the one block that can
hold it and the bounds of the lists still to come stay below that score; blocks
that no document is left for are never decompressed. What ties with the last
score is kept, since ties are broken by document id. Heaps of all tasks are
merged by a window, which keeps the top of each task before it shuffles.

Edge cases: a null or blank text has no terms and is not in the index; ids are
BIGINT, null ids rank last among equal scores; rows that share an id rank one by
one; queries without terms, and empty tables, give no rows; very long texts are
read whole. Only the named columns are read, so clashing names do no harm.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sondera.llm.chunks import pressed, released
from sondera.llm.common import cut, documents, sliced, text_batches, text_or_empty, tidied

NAME = "op13_lexical_search"
TOP = 20
SHARD_BYTES = 8 << 20
BLOCK = 128
QUERY_BYTES, QUERIES = 4 << 20, 4096  # of a block of queries
DECODED = 1 << 21  # postings that a task keeps decompressed

#: Bytes as they count: letters in lower case, whatever separates terms as blanks.
_FOLD = bytes(x + 32 if 65 <= x <= 90 else x if x >= 128 or 48 <= x <= 57 or 97 <= x <= 122 else 32 for x in range(256))
_NUMBERS = ("df", "first", "most", "least", "at", "lengths")
_SHARD = f"n_docs long, n_terms long, ids array<long>, terms binary, {', '.join(f'{c} binary' for c in _NUMBERS)}, body binary"


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def to_varints(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers as bytes of seven bits, the last without the high bit, and where each number ends."""
    size = np.ones(len(x), np.int64)
    for k in range(1, 9):
        size += x >= np.int64(1) << (7 * k)
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(x) else 0, np.uint8)
    starts = ends - size
    for k in range(int(size.max(initial=0))):
        has = size > k
        out[starts[has] + k] = (x[has] >> (7 * k)) & 127 | ((size[has] > k + 1) << 7)
    return out, ends


def from_varints(raw: np.ndarray) -> np.ndarray:
    if not len(raw):
        return np.zeros(0, np.int64)
    starts = np.r_[0, np.flatnonzero(raw < 128)[:-1] + 1]
    place = np.arange(len(raw)) - np.repeat(starts, np.diff(np.r_[starts, len(raw)]))
    return np.add.reduceat((raw & 127).astype(np.int64) << (7 * place), starts)


class Builder:
    """The postings of one shard, document by document."""

    def __init__(self):
        self.vocabulary: dict[bytes, int] = {}
        self.ids, self.lengths, self.sizes, self.terms, self.occurrences = [], [], [], [], []
        self.n_bytes = 0

    def add(self, id_: int | None, text: bytes) -> None:
        found = Counter(terms_of(text))
        self.n_bytes += len(text) + 64
        if found:
            known = self.vocabulary
            self.terms.append(np.array([known.setdefault(t, len(known)) for t in found], np.int32))
            self.occurrences.append(np.array(list(found.values()), np.int32))
            self.ids.append(id_)
            self.sizes.append(len(found))
            self.lengths.append(int(self.occurrences[-1].sum(dtype=np.int64)))

    def row(self) -> pa.RecordBatch:
        names = sorted(self.vocabulary)
        rank = np.empty(len(names), np.int64)
        rank[[self.vocabulary[t] for t in names]] = np.arange(len(names))
        term, tf = rank[np.concatenate(self.terms)], np.concatenate(self.occurrences).astype(np.int64)
        lengths = np.array(self.lengths, np.int64)
        order = np.argsort(term, kind="stable")
        doc, tf = np.repeat(np.arange(len(lengths)), self.sizes)[order], tf[order]
        df = np.bincount(term, minlength=len(names))
        starts = np.cumsum(df) - df
        gaps = np.diff(doc, prepend=0)
        gaps[starts] = doc[starts] + 1
        place = np.arange(len(doc)) - np.repeat(starts, df)
        blocks = np.flatnonzero(place % BLOCK == 0)
        body, ends = to_varints(np.stack([gaps, tf], axis=1).ravel())
        numbers = (df, doc[blocks], np.maximum.reduceat(tf, blocks), np.minimum.reduceat(lengths[doc], blocks), np.r_[0, ends][2 * blocks], lengths)
        columns = [len(lengths), int(lengths.sum()), self.ids, pressed(b" ".join(names)), *(pressed(x.astype(np.int64).tobytes()) for x in numbers), body.tobytes()]
        types = [pa.int64(), pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * (len(columns) - 3)]
        return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(columns, types, strict=True)], [c.split()[0] for c in _SHARD.split(", ")])


def index(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The shards of an index of all rows of ``df``, written to the shared folder."""
    text_batches(df.sparkSession)
    rows = df.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))

    def build(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Builder()
        for batch in sliced(found):
            for id_, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                shard.add(id_, text.as_py())
                if shard.n_bytes >= shard_bytes and shard.ids:
                    yield shard.row()
                    shard = Builder()
        if shard.ids:
            yield shard.row()

    return cut(rows.mapInArrow(tidied(build), _SHARD), "index")


class Lists:
    """A shard's lists for searching: bounds of all blocks, postings on demand."""

    def __init__(self, row: dict, n_docs: int, n_terms: int):
        self.ids = pa.array(row["ids"], pa.int64())
        self.number = {t: i for i, t in enumerate(released(row["terms"]).split(b" "))}
        self.df, first, most, least, at, lengths = (np.frombuffer(released(row[c]), np.int64) for c in _NUMBERS)
        self.first, self.body = first, np.frombuffer(row["body"], np.uint8)
        self.at = np.r_[at, len(self.body)]
        self.blocks = np.r_[0, np.cumsum(-(-self.df // BLOCK))]
        self.m = self._m(lengths, n_docs, n_terms)
        self.bounds = impact(most, self._m(least, n_docs, n_terms))
        self.kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.n_kept = self.n_read = 0

    @staticmethod
    def _m(lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
        return 75 + 25 * lengths * n_docs // n_terms

    def postings(self, t: int, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts of some (ascending) blocks of list ``t``."""
        own = self.blocks[t] + blocks
        self.n_read += len(own)
        values = from_varints(np.concatenate([self.body[a:b] for a, b in zip(self.at[own], self.at[own + 1], strict=True)]))
        sizes = np.minimum(BLOCK, self.df[t] - BLOCK * blocks)
        starts = np.cumsum(sizes) - sizes
        docs = np.cumsum(values[0::2])
        docs += np.repeat(self.first[own] - docs[starts], sizes)
        return docs, impact(values[1::2], self.m[docs])

    def whole(self, t: int) -> tuple[np.ndarray, np.ndarray]:
        if t not in self.kept:
            if self.n_kept > DECODED:
                self.kept.clear()
                self.n_kept = 0
            self.kept[t] = self.postings(t, np.arange(self.blocks[t + 1] - self.blocks[t]))
            self.n_kept += int(self.df[t])
        return self.kept[t]


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


class Heap:
    """The best documents of one query so far."""

    def __init__(self, top: int):
        self.top, self.scores, self.ids = top, np.zeros(0, np.int64), pa.array([], pa.int64())

    @property
    def least(self) -> int:
        """What a document has to score to come in, or to tie with the last."""
        return int(self.scores[-1]) if len(self.scores) == self.top else 1

    def push(self, scores: np.ndarray, ids: pa.Array) -> None:
        scores, ids = np.concatenate([self.scores, scores]), pa.concat_arrays([self.ids, ids])
        null = np.asarray(ids.is_null())
        order = np.lexsort((np.asarray(ids.fill_null(0)), null, -scores))[: self.top]
        self.scores, self.ids = scores[order], ids.take(pa.array(order))


def search(lists: Lists, query: list[tuple[bytes, int]], heap: Heap) -> None:
    """Add a shard's best documents for ``query`` (terms and weights) to ``heap``."""
    own = [(t, w) for name, w in query if w > 0 and (t := lists.number.get(name)) is not None]
    if not own:
        return
    bound = lambda t: lists.bounds[lists.blocks[t] : lists.blocks[t + 1]]
    own = sorted(((w * int(bound(t).max()), t, w) for t, w in own), reverse=True)
    left = np.cumsum([b for b, _, _ in own][::-1])[::-1].tolist() + [0]  # bounds of a list and all after it
    score, theta, at = np.zeros(len(lists.m), np.int64), heap.least, 0
    while at < len(own) and left[at] >= theta:  # essential lists
        docs, x = lists.whole(own[at][1])
        score[docs] += own[at][2] * x
        at += 1
        if len(score) > heap.top:
            theta = max(theta, int(np.partition(score, -heap.top)[-heap.top]))
    found = np.flatnonzero((score > 0) & (score + left[at] >= theta))
    for k in range(at, len(own)):  # the others, for documents already found
        if not len(found):
            return
        _, t, w = own[k]
        first, bounds = lists.first[lists.blocks[t] : lists.blocks[t + 1]], bound(t)
        block = np.searchsorted(first, found, "right") - 1
        keep = score[found] + np.where(block >= 0, w * bounds[block], 0) + left[k + 1] >= theta
        found, block = found[keep], block[keep]
        wanted = np.unique(block[block >= 0])
        if len(wanted):
            docs, x = lists.postings(t, wanted)
            place = np.minimum(np.searchsorted(docs, found), len(docs) - 1)
            score[found] += np.where(docs[place] == found, w * x[place], 0)
    found = found[score[found] >= theta]
    heap.push(score[found], lists.ids.take(pa.array(found)))


def _blocks(queries: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int | None, Counter]]]:
    block, size = [], 0
    for id_, text in queries.select(F.col(id_col).cast("long"), text_or_empty(text_col)).toLocalIterator():
        block.append((id_, Counter(terms_of(text.encode()))))
        size += len(text)
        if size >= QUERY_BYTES or len(block) >= QUERIES:
            yield block
            block, size = [], 0
    if block:
        yield block


def _frequencies(shards: DataFrame, names: list[bytes]) -> np.ndarray:
    """Documents that hold each of the terms, over all shards."""
    number = {t: i for i, t in enumerate(names)}

    def count(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(names), np.int64)
        for batch in found:
            for terms, own in zip(*(batch.column(c) for c in range(2)), strict=True):
                own = np.frombuffer(released(own.as_py()), np.int64)
                for i, t in enumerate(released(terms.as_py()).split(b" ")):
                    if t in number:
                        df[number[t]] += own[i]
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(df[held])], ["t", "df"])

    out = np.zeros(len(names), np.int64)
    for t, df in shards.select("terms", "df").mapInArrow(tidied(count), "t long, df long").groupBy("t").agg(F.sum("df")).collect():  # of a block's terms
        out[t] = df
    return out


def ranked(shards: DataFrame, queries: DataFrame, id_col: str = "item_id", text_col: str = "text", top: int = TOP) -> DataFrame:
    """The ``top`` documents of each row of ``queries``: its id, rank, doc_id, score."""
    n_docs, n_terms = (int(x or 0) for x in shards.agg(F.sum("n_docs"), F.sum("n_terms")).first())
    schema = "query int, item long, doc_id long, score long"
    names = [id_col, "rank", "doc_id", "score"]
    out = shards.sparkSession.createDataFrame([], f"`{id_col}` long, rank int, doc_id long, score long")
    if not n_docs:
        return out
    for block in _blocks(queries, id_col, text_col):
        terms = sorted({t for _, q in block for t in q})
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for t, df in zip(terms, _frequencies(shards, terms).tolist(), strict=True)}
        items = [(id_, [(t, k * weight[t]) for t, k in q.items()]) for id_, q in block]

        def best(found: Iterator[pa.RecordBatch], items: list = items) -> Iterator[pa.RecordBatch]:
            heaps = [Heap(top) for _ in items]
            for batch in found:
                for i in range(batch.num_rows):
                    lists = Lists({c: batch.column(c)[i].as_py() for c in batch.schema.names}, n_docs, n_terms)
                    for heap, (_, query) in zip(heaps, items, strict=True):
                        search(lists, query, heap)
            sizes = [len(h.scores) for h in heaps]
            of = np.repeat(np.arange(len(items), dtype=np.int32), sizes)
            columns = (pa.array(of), pa.array([items[i][0] for i in of], pa.int64()), pa.concat_arrays([h.ids for h in heaps]), pa.array(np.concatenate([h.scores for h in heaps])))
            yield pa.RecordBatch.from_arrays(list(columns), [c.split()[0] for c in schema.split(", ")])

        order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        found = shards.drop("n_docs", "n_terms").mapInArrow(tidied(best), schema).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        out = out.unionByName(found.withColumnRenamed("item", id_col).select(names))
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(index(documents(spark, sf_dir)), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERMS = r"unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"
ORACLE_SQL = f"""
WITH tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, {_TERMS} AS term FROM documents) GROUP BY ALL),
     lengths AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
     corpus AS (SELECT count(*) AS nd, sum(n)::BIGINT AS l FROM lengths),
     weights AS (SELECT term, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w
                 FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), corpus),
     items AS (SELECT item_id, term, count(*) AS k FROM (SELECT item_id, {_TERMS} AS term FROM benchmark) GROUP BY ALL),
     scores AS (SELECT item_id, doc_id, sum(k * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nd) // l))))::BIGINT AS score
                FROM items JOIN tf USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id), corpus GROUP BY ALL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0) WHERE rank <= 20
"""
