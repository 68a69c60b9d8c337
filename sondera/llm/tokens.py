"""Token ids and token counts through worker-local caches of a public tokenizer.

Token counts (op3) use two tiers. Texts fall into pre-tokens that never merge
across their borders: an optional space with the word behind it, or the white
space between. Tier one is a broadcast hash table from frequent pre-tokens to
their number of tokens, bounded by ``FREQUENT``; it comes from a pass over the
whole table in which every partition sums up its own pre-tokens and makes one
small table of its ``LOCAL`` most frequent ones. These tables are merged as
they are, so no pre-token is ever shuffled by its value. Tier two is a cache in
each Python worker, filled by encoding what tier one misses. Both only save
work: the counts are the tokenizer's own whatever the tables hold.

Texts that hold a special string of the vocabulary, or white space other than
the six ASCII characters, are encoded whole.

Edge cases: null counts as empty, with no bytes and no tokens; an empty table
gives an empty result; texts are never cut. Input columns named like a result
column are replaced.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sondera.llm.chunks import blocks
from sondera.llm.common import documents, text_batches, tidied

NAME = "op3_token_counts"
TOKENIZER, LIMIT = "byte_bpe_50k.json", 512
FREQUENT, LOCAL, FAN = 1 << 15, 1 << 12, 256
#: Entries of each of a worker's caches before it starts anew.
CACHE, WORDS, PIECES = 1 << 19, 1 << 18, 1 << 17
BLOCK = 1 << 21  # bytes of text whose words are found at once
_PIECE = re.compile(rb" ?[^ \t-\r]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+")
#: White space outside ASCII, and separators that some libraries take for white space, as UTF-8.
_ODD = re.compile("[\x1c-\x1f\x85\xa0 ᠎ -​    　﻿]")


@cache
def tokenizer(path: str):
    """The tokenizer of a file, one per worker."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def place(name: str) -> str:
    """A vocabulary's path: a path as it is, or a name in the package of public tokenizers."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class _Ids(dict):
    """Key -> number of its entry in growing arrays of ids; ``find`` gives the ids of new keys, as (sizes, all ids)."""

    def __init__(self, find: Callable[[list], tuple[np.ndarray, np.ndarray]], most: int):
        self.find, self.most = find, most
        self.clear()

    def clear(self) -> None:
        super().clear()
        self.pool, self.at, self.n = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.uint32)
        self.used = 0

    def add(self, keys: list) -> None:
        sizes, flat = self.find(keys)
        first, last, used = len(self), len(self) + len(keys), self.used + len(flat)
        while used > len(self.pool):
            self.pool = np.resize(self.pool, 2 * len(self.pool))
        while last > len(self.n):
            self.at, self.n = np.resize(self.at, 2 * len(self.at)), np.resize(self.n, 2 * len(self.n))
        self.pool[self.used : used] = flat
        self.at[first:last] = self.used + np.cumsum(sizes) - sizes
        self.n[first:last] = sizes
        self.used = used
        self.update(zip(keys, range(first, last), strict=True))

    def ids(self, keys: list) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each key, and all ids."""
        if len(self) > self.most:
            self.clear()
        which = np.fromiter(map(self.get, keys, repeat(-1)), np.int64, len(keys))
        missing = np.flatnonzero(which < 0).tolist()
        if missing:
            new = [keys[i] for i in missing]
            self.add(list(dict.fromkeys(new)))
            which[missing] = np.fromiter(map(self.__getitem__, new), np.int64, len(new))
        n = self.n[which].astype(np.int64)
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        return n, self.pool[np.repeat(self.at[which] - (ends - n), n) + np.arange(total)]


class _Words:
    """Ids of words by a vocabulary that drops white space: known words at once, new ones by the pieces that the model merges for itself."""

    def __init__(self, name: str):
        import regex

        self.whole = tokenizer(place(name))
        self.words, self.pieces = _Ids(self.of_words, WORDS), _Ids(self.of_pieces, PIECES)
        self.split = regex.compile(r" |'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+").findall
        self.plain = re.compile(r"[\x00-\u02ff]*").fullmatch  # no marks that compose, and lower case is letter by letter
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # byte-level vocabularies show other bytes from 256 on
        self.bytes = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in shown)}

    def of_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        encode, shown = self.whole.model.tokenize, self.bytes
        found = [[t.id for t in encode(p if p.isascii() else p.encode().decode("latin-1").translate(shown))] if p != " " else () for p in pieces]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return sizes, np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum()))

    def of_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        joined = b" ".join(words).decode()
        if "<|" in joined or not self.plain(joined) or not joined.isprintable():  # may hold a special string, or need the library's own normal form
            if len(words) > 1:
                parts = [self.of_words(words[: len(words) // 2]), self.of_words(words[len(words) // 2 :])]
                return tuple(map(np.concatenate, zip(*parts, strict=True)))
            found = np.array(self.whole.encode(joined, add_special_tokens=False).ids, np.uint32)
            return np.array([len(found)]), found
        pieces = self.split(joined.lower())
        n, flat = self.pieces.ids(pieces)
        word = np.cumsum(np.fromiter(map(" ".__eq__, pieces), bool, len(pieces)))
        return np.bincount(word, weights=n, minlength=len(words)).astype(np.int64), flat


_caches: dict[str, _Words] = {}


def word_ids(texts: list[bytes], tokenizer: str, end: int | None = None) -> Iterator[np.ndarray]:
    """The ids of each text by a vocabulary that drops white space, each followed by ``end``."""
    known = _caches.get(tokenizer)
    if known is None:
        known = _caches[tokenizer] = _Words(tokenizer)
    tail = np.array([] if end is None else [end], np.uint32)
    for run in blocks(texts, BLOCK):
        odd = {}
        for i in run:
            if not texts[i].isascii() and _ODD.search(text := texts[i].decode()):
                odd[i] = np.array(known.whole.encode(text, add_special_tokens=False).ids, np.uint32)
        words = pc.ascii_split_whitespace(pa.array([b"" if i in odd else texts[i] for i in run], pa.large_binary()).cast(pa.large_string()))
        used = pc.dictionary_encode(words.flatten())  # so each distinct word of a block is looked up once
        sizes, flat = known.words.ids(used.dictionary.cast(pa.large_binary()).to_pylist())
        which = used.indices.to_numpy()
        starts, n = (np.cumsum(sizes) - sizes)[which], sizes[which]
        last = np.cumsum(n)
        flat = flat[np.repeat(starts - (last - n), n) + np.arange(last[-1] if len(last) else 0)]
        ends = np.r_[0, last][words.offsets.to_numpy()]
        for i, lo, hi in zip(run, ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            yield np.concatenate([odd.get(i, flat[lo:hi]), tail]).astype(np.uint32, copy=False)


# --------------------------------------------------------------------- counts


class _Lengths(dict):
    """Pre-token -> number of tokens; what is missing is encoded."""

    def __init__(self, name: str, frequent: tuple[bytes, bytes, bytes]):
        self.frequent, self.tokenizer = frequent, tokenizer(place(name))
        self.special = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or r"(?!)")
        self.restart()

    def restart(self) -> None:
        self.clear()
        joined, sizes, tokens = self.frequent
        ends = np.cumsum(np.frombuffer(sizes, np.uint16), dtype=np.int64).tolist()
        self.update(zip(map(joined.__getitem__, map(slice, [0, *ends], ends)), np.frombuffer(tokens, np.uint16).tolist()))

    def count(self, texts: list[bytes]) -> np.ndarray:
        if len(self) > FREQUENT + CACHE:
            self.restart()
        out = np.zeros(len(texts), np.int64)
        for i, raw in enumerate(texts):
            text = raw.decode()
            if _ODD.search(text) or self.special.search(text):
                out[i] = len(self.tokenizer.encode(text, add_special_tokens=False))
                continue
            pieces = _PIECE.findall(raw)
            try:
                out[i] = sum(map(self.__getitem__, pieces))
            except KeyError:
                new = [p for p in dict.fromkeys(pieces) if p not in self]
                found = self.tokenizer.encode_batch_fast([p.decode() for p in new], add_special_tokens=False)
                self.update(zip(new, map(len, found), strict=True))
                out[i] = sum(map(self.__getitem__, pieces))
        return out


_lengths: dict[str, _Lengths] = {}


def _table(g: int, seen: Counter, most: int) -> pa.RecordBatch:
    top = seen.most_common(most)
    columns = ([g], [[p for p, _ in top]], [[n for _, n in top]])
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.list_(pa.binary()), pa.list_(pa.int64())), strict=True)], ["g", "p", "n"])


def _sum(ps: list[list[bytes]], ns: list[list[int]]) -> Counter:
    total: Counter[bytes] = Counter()
    for p, n in zip(ps, ns, strict=True):
        total.update(dict(zip(p, n, strict=True)))
    return total


def frequent_pre_tokens(df: DataFrame, text_col: str, name: str = TOKENIZER) -> tuple[bytes, bytes, bytes]:
    """A table of up to FREQUENT pre-tokens with their numbers of tokens: joined bytes, sizes and counts as unsigned 16-bit numbers.

    Each partition of the whole of ``df`` makes one table of its most frequent pre-tokens. Tables, not pre-tokens, are merged,
    FAN at a time over two levels, so no task and not the driver holds more than a few hundred tables of fixed size.
    """

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        seen: Counter[bytes] = Counter()
        for batch in found:
            for text in batch.column(0).cast(pa.binary()):
                seen.update(_PIECE.findall(text.as_py() or b""))
                if len(seen) > CACHE:  # as in lossy counting, the rare ones go
                    seen = Counter(dict(seen.most_common(CACHE // 4)))
        yield _table(TaskContext.get().partitionId() // FAN, seen, LOCAL)

    def merge(tables: pa.Table) -> pa.Table:
        total = _sum(tables.column("p").to_pylist(), tables.column("n").to_pylist())
        return pa.Table.from_batches([_table(tables.column("g")[0].as_py() // FAN, total, FREQUENT)])

    schema = "g int, p array<binary>, n array<long>"
    found = df.select(text_col).mapInArrow(tidied(batches), schema)
    for _ in range(2):
        found = found.groupBy("g").applyInArrow(merge, schema)
    rows = found.collect()
    total = _sum([list(map(bytes, r["p"])) for r in rows], [r["n"] for r in rows])
    top = [p for p in sorted(total, key=lambda p: (-total[p], p))[:FREQUENT] if len(p) < 1 << 16]
    sizes = list(map(len, tokenizer(place(name)).encode_batch_fast([p.decode() for p in top], add_special_tokens=False)))
    return b"".join(top), np.array(list(map(len, top)), np.uint16).tobytes(), np.array(sizes, np.uint16).tobytes()


def token_counts(df: DataFrame, text_col: str = "text", name: str = TOKENIZER, limit: int = LIMIT) -> DataFrame:
    """``df`` with n_bytes, n_tokens and over_limit."""
    text_batches(df.sparkSession)
    df = df.drop(*[c for c in ("n_bytes", "n_tokens", "over_limit") if c != text_col])
    frequent = df.sparkSession.sparkContext.broadcast(frequent_pre_tokens(df, text_col, name))
    key = f"{name}:{uuid.uuid4().hex}"
    schema = T.StructType([*df.schema.fields, T.StructField("n_tokens", T.LongType())])

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _lengths:
            _lengths.clear()
            _lengths[key] = _Lengths(name, frequent.value)
        for batch in found:
            texts = batch.column(batch.schema.get_field_index(text_col)).cast(pa.binary())
            sizes = _lengths[key].count([t.as_py() or b"" for t in texts])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes)], [*batch.schema.names, "n_tokens"])

    counted = df.mapInArrow(tidied(batches), schema)
    size = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long")
    return counted.withColumns({"n_bytes": size, "over_limit": F.col("n_tokens") > limit})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_counts(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_tokens", "over_limit")


ORACLE_SQL = None  # the tokenizer has no SQL form; tests hold every count against the library
