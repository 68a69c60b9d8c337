"""Exact dedup by two-pass Bloom filtering, in DataFrame functions only.

Pass one hashes every text to one 64-bit word of a blocked Bloom filter and to
two bits of that word. A partition's filter is sparse: the cells (word, bits) it
has set, each with whether it set them once or more often. Partition filters are
merged cell by cell, and the cells set twice or more are ORed into the filter of
repeated hashes: rows of ``LANES`` words, a dense bit array in pieces.

Pass two tests every row against the broadcast filter. A row whose bits are not
all set has a text that no other row has and passes straight through, without a
shuffle. Only the rest, the suspects, are written and shuffle, as SHA-256
digests, and are grouped exactly; false positives come out as groups of one. No
repeated text is missed, since equal texts share a cell.

The filter has a word for four repeated cells. Where that is above
``broadcast_bytes``, hashes fall into as many ranges as it takes, each range has
its own filter, and pass two reads the table once for every range: texts that
are not suspects are never shuffled at any size.

Suspects and the groups' results are written to the shared folder before they
meet, so what is compared does not change when a task is run again, both sides
of the join are plain shuffles, and a hot group's rows can be split.

Edge cases: a null text counts as empty. Of equal texts the row with the
largest id stays; null ids rank below all others; of rows that share text and
id one stays (the last as written). An empty table gives an empty result.
Result columns replace input columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sondera.llm.common import cut, documents, text_or_empty

NAME = "op7_exact_dedup"
CELLS_PER_WORD = 4  # repeated cells to a word of 64 bits: about one row in 70 is a false suspect
LANES = 16
LANE_BYTES = 12  # of a broadcast word, its share of the row it lies in included
BROADCAST_BYTES = 128 << 20
_RESULT = ("keep_id", "group_size", "kept", "text_sha256")


def _bits() -> Column:
    """Two bits of a word, by twelve bits of the hash that choose nothing else."""
    bit = lambda at: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned("__h", at).bitwiseAND(63).cast("int"))
    return bit(52).bitwiseOR(bit(58))


def repeated_cells(hashed: DataFrame) -> DataFrame:
    """Cells (__cell, __mask) that occur twice or more in ``__h``: 40 bits of the hash name the word, long before its number is known."""
    cells = hashed.select(F.col("__h").bitwiseAND((1 << 40) - 1).alias("__cell"), _bits().alias("__mask"))
    return cells.groupBy("__cell", "__mask").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("__cell", "__mask")


def filter_of(cells: DataFrame, words: int) -> DataFrame:
    """The Bloom filter of ``words`` words (a power of two): rows __piece and __words, an array of LANES words."""
    word = F.col("__cell").bitwiseAND(words - 1)
    lane = word.bitwiseAND(LANES - 1)
    zero = F.lit(0).cast("long")
    lanes = [F.coalesce(F.bit_or(F.when(lane == i, F.col("__mask"))), zero) for i in range(LANES)]
    return cells.groupBy(F.shiftrightunsigned(word, LANES.bit_length() - 1).alias("__piece")).agg(F.array(*lanes).alias("__words"))


def suspects(hashed: DataFrame, filter_: DataFrame, words: int) -> DataFrame:
    """``hashed`` with __suspect: whether the filter holds a row's bits."""
    word = F.col("__h").bitwiseAND(words - 1)
    piece = F.shiftrightunsigned(word, LANES.bit_length() - 1)
    joined = hashed.withColumn("__piece", piece).join(F.broadcast(filter_), "__piece", "left")
    own = F.get("__words", word.bitwiseAND(LANES - 1).cast("int"))
    return joined.withColumn("__suspect", F.coalesce(own.bitwiseAND(_bits()) == _bits(), F.lit(False))).drop("__piece", "__words")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES, with_text: bool = True) -> DataFrame:
    """All rows and columns of ``df`` (but for its text, if so asked) with keep_id, group_size, kept and text_sha256."""
    df = df.drop(*[c for c in _RESULT if c not in (id_col, text_col)])
    hashed = df.withColumn("text_sha256", F.sha2(text_or_empty(text_col), 256)).withColumn("__h", F.xxhash64("text_sha256"))
    cells = cut(repeated_cells(hashed), "cells")
    columns = [c for c in df.columns if with_text or c != text_col]
    hashed = hashed.select(*columns, "text_sha256", "__h")
    words = 1 << max(4, (cells.count() // CELLS_PER_WORD).bit_length())
    ranges = 1
    while words * LANE_BYTES > broadcast_bytes and words > LANES:
        words, ranges = words // 2, ranges * 2

    def marked(rows: DataFrame, at: str) -> DataFrame:
        """``rows`` of each range, tested against the range's own filter; a range is chosen by bits 40 and up of the hash or cell."""
        parts = []
        for r in range(ranges):
            own = lambda c: F.shiftrightunsigned(c, 41 - ranges.bit_length()).bitwiseAND(ranges - 1) == r  # noqa: B023, E731
            parts.append(suspects(rows.where(own(at)), filter_of(cells.where(own("__cell")), words), words))
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    tested = marked(hashed, "__h")
    some = cut(tested.where("__suspect").drop("__suspect", "__h").withColumn("__row", F.monotonically_increasing_id()), "suspects")
    by_id = some.groupBy("text_sha256", id_col).agg(F.count(F.lit(1)).alias("n"), F.max("__row").alias("row"))
    groups = by_id.groupBy("text_sha256").agg(F.max(F.struct(F.col(id_col).alias("id"), "n", "row")).alias("__keep"), F.sum("n").alias("group_size"))
    stays = F.col(id_col).eqNullSafe(F.col("__keep.id")) & ((F.col("__keep.n") == 1) | (F.col("__row") == F.col("__keep.row")))
    out = [*columns, "keep_id", "group_size", "kept", "text_sha256"]
    members = some.join(cut(groups, "groups"), "text_sha256").withColumns({"keep_id": F.col("__keep.id"), "kept": stays})
    alone = tested.where("NOT __suspect").withColumns({"keep_id": F.col(id_col), "group_size": F.lit(1).cast("long"), "kept": F.lit(True)})
    return alone.select(out).unionByName(members.select(out))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup(documents(spark, sf_dir).select("doc_id", "text"), with_text=False)
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup(docs).where("kept").select(docs.columns)


ORACLE_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
