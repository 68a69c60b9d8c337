"""Spelling variants by asymmetric q-chunks.

Runs of letters are counted where the texts are read; tables of counts, not
runs, are shuffled. Of two words one edit apart the shorter one (of equal
length: the smaller one) gives two disjoint chunks, its halves. The other one
gives its positional grams: an edit leaves at least one half whole, the first
where it stands, the second moved by the difference in length (no more than
one), so of all grams of a chunk's length only those are made that stand there.
Chunks and grams join on (length, half, letters), and ``levenshtein`` verifies.

A chunk that very many words share is told apart before it joins: its words'
other half is halved on, down to one code point, so that all of it but the
edited code point is in the key. Such a group has as many words as there are
letters at most, nothing is left out, and no hot chunk makes all its pairs.

A word's form is its near word of largest count, if that is at least ``RATIO``
times its own. Counts grow along forms by that factor, so chains are short, and
a few rounds of pointer doubling, each written to the shared folder, find roots.

Edge cases: a null text has no words; a null id counts as an empty one; rows
that share an id are all counted; very long texts and words are read whole. An
empty table gives an empty result. Input columns but the id and the text are
not read, so clashing names do no harm.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sondera.llm.common import cut, documents, small, sliced, text_batches, text_or_empty, tidied

NAME = "op11_spelling_variants"
SLIP = 199  # of so many runs of a document one loses a code point
MIN_LETTERS, MIN_COUNT, RATIO = 6, 5, 5
HELD = 1 << 17  # distinct words that a task counts at once
HOT = 1 << 16  # pairs of one chunk above which its words are told apart first

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_RUN = re.compile(f"[a-zÀ-ÿ]{{{MIN_LETTERS},}}")


def written(run: str, start: int) -> str:
    """The run, or the run without one code point where the checksum of id and run says so; ``start``: the checksum of the id and its colon."""
    h = crc32(run.encode(), start)
    if h % SLIP:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Words of at least ``MIN_LETTERS`` code points and ``MIN_COUNT`` occurrences over all texts: word, n."""
    text_batches(df.sparkSession)
    rows = df.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), text_or_empty(text_col).alias("text"))

    def count(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def table() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

        for batch in sliced(found):
            for id_, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                start = crc32(f"{id_}:".encode())
                for run, n in Counter(_RUN.findall(text.as_py().translate(_LOWER).decode())).items():
                    total[written(run, start)] += n
            if len(total) >= HELD:
                yield table()
                total.clear()
        yield table()

    counted = rows.mapInArrow(tidied(count), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where((F.col("n") >= MIN_COUNT) & (F.length("word") >= MIN_LETTERS))


def _chunks(words: DataFrame) -> DataFrame:
    """Two disjoint chunks of each word, its halves: key (len, half, letters), word, n and the rest of the word."""
    size, half = F.length("word"), F.floor(F.length("word") / 2).cast("int")
    halves = [F.struct(F.lit(i).alias("half"), a.alias("letters"), b.alias("rest")) for i, (a, b) in enumerate(_cut(half))]
    return words.select(size.alias("len"), "word", "n", F.explode(F.array(*halves)).alias("c")).select("len", "c.*", "word", "n")


def _cut(at: Column) -> list[tuple[Column, Column]]:
    first, second = F.substring("word", F.lit(1), at), F.substring("word", at + 1, F.length("word") - at)
    return [(first, second), (second, first)]


def _grams(words: DataFrame) -> DataFrame:
    """Positional grams of each word that can be a chunk of a word of its length or of one letter less, by the same key."""
    size = F.length("word")
    out = []
    for less in (0, 1):
        half = F.floor((size - less) / 2).cast("int")
        for i, (letters, rest) in enumerate((_cut(half)[0], _cut(half + less)[1])):
            out.append(F.struct((size - less).alias("len"), F.lit(i).alias("half"), letters.alias("letters"), rest.alias("rest"), F.lit(less).alias("less")))
    return words.select("word", "n", F.explode(F.array(*out)).alias("c")).select("c.*", "word", "n")


_KEY = ["len", "half", "letters"]


def _without_one() -> Column:
    """The rest of a word without each of its code points: (place, what is left)."""
    left = lambda i: F.concat(F.substring("rest", F.lit(1), i - 1), F.substring("rest", i + 1, F.length("rest") - i))
    return F.transform(F.sequence(F.lit(1), F.length("rest")), lambda i: F.struct(i.cast("int").alias("place"), left(i).alias("left")))


def near_pairs(words: DataFrame, hot: int = HOT) -> DataFrame:
    """Each pair of words exactly one edit apart, once: a, an, b, bn (words and counts)."""
    chunks, grams = cut(_chunks(words), "chunks"), cut(_grams(words), "grams")
    many = chunks.groupBy(_KEY).agg(F.count(F.lit(1)).alias("c")).join(grams.groupBy(_KEY).agg(F.count(F.lit(1)).alias("g")), _KEY)
    many = small(many.where(F.col("c") * F.col("g") > hot).select(*_KEY, F.lit(True).alias("many")), "hot-chunks")
    chunks, grams = (d.join(many, _KEY, "left") for d in (chunks, grams))
    whole = F.array(F.struct(F.lit(0).alias("place"), F.lit("").alias("left")))
    same, longer = _without_one(), F.array_distinct(F.transform(_without_one(), lambda x: F.struct(F.lit(-1).alias("place"), x["left"].alias("left"))))
    own = F.concat(same, F.array(F.struct(F.lit(-1).alias("place"), F.col("rest").alias("left"))))
    a = chunks.select(*_KEY, F.col("word").alias("a"), F.col("n").alias("an"), F.explode(F.when(F.col("many"), own).otherwise(whole)).alias("at"))
    b = grams.select(*_KEY, F.col("word").alias("b"), F.col("n").alias("bn"), "less", F.explode(F.when(F.col("many"), F.when(F.col("less") == 0, same).otherwise(longer)).otherwise(whole)).alias("at"))
    half = F.floor(F.col("len") / 2).cast("int")
    start = lambda c: F.substring(F.col(c), F.lit(1), half)
    once = (F.col("half") == 0) | (start("a") != start("b"))  # both halves of a pair can be whole
    apart = (F.col("less") == 1) | (F.col("a") < F.col("b"))
    return a.join(b, [*_KEY, "at"]).where(apart & once & (F.levenshtein("a", "b", 1) == 1)).select("a", "an", "b", "bn")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of each word with a form: where the chain of forms ends."""
    found = cut(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        onward = found.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = cut(found.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        found = joined.select("word", "root")
        if joined.where("moved").isEmpty():
            return found


def spelling_variants(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ratio: int = RATIO, hot: int = HOT) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n."""
    words = cut(word_counts(df, id_col, text_col), "words")
    pairs = near_pairs(words, hot)
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("an").alias("n"), F.col("b").alias("near"), F.col("bn").alias("m")), F.struct(F.col("b").alias("word"), F.col("bn").alias("n"), F.col("a").alias("near"), F.col("an").alias("m")))).alias("p")).select("p.*")
    best = F.min(F.when(F.col("m") >= ratio * F.col("n"), F.struct((-F.col("m")).alias("m"), "near")))
    found = cut(both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best")), "near").select("word", "n_near", F.col("best.near").alias("form"), (-F.col("best.m")).alias("form_n"))
    ends = roots(found.where("form IS NOT NULL"))
    joined = words.join(found, "word", "left").join(ends, "word", "left")
    return joined.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(documents(spark, sf_dir))


ORACLE_SQL = None  # crc32 has no DuckDB form; tests hold the query against brute force
