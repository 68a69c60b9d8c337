"""Line dedup: lines spread over many sites are boilerplate; DataFrame functions only.

Every line of ``MIN_WORDS`` words or more is hashed, and a HyperLogLog sketch of
the sites it occurs on is built per line hash. Sketches merge by aggregation, so
a line on every page of the largest site costs each task one small sketch. Lines
whose estimate is clearly above the threshold (``BAND`` times it) are
boilerplate, those clearly below are not; only lines in between are counted
exactly, and nothing else is shuffled for that. Boilerplate lines are then taken
out of all documents.

Lines are compared without the ASCII white space around them, by XXH64. Other
lines keep their place and text.

Edge cases: a null text has no lines and stays null; a null site is no site, but
its lines are removed like others; repeated rows add no site; an empty table
gives an empty result. Texts are read whole, and a document's removals are keyed
by its text's hash, so null or repeated ids do no harm. Input columns named like
a result column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sondera.llm.common import WORD, cut, documents

NAME = "op1_line_dedup"
MIN_WORDS, MIN_SITES, BAND, LG_K = 3, 5, 2.0, 12
_SPACE = " \t\n\x0b\f\r"


def _hash(line: Column) -> Column:
    """The hash of a line, null if it is too short to judge."""
    bare = F.btrim(line, F.lit(_SPACE))
    return F.when(F.regexp_like(bare, F.lit(rf"^{WORD}([\x20\x09-\x0D]+{WORD}){{{MIN_WORDS - 1}}}")), F.xxhash64(bare))


def _lines(df: DataFrame, text_col: str) -> Column:
    return F.split(F.col(text_col), "\n")


def boilerplate(df: DataFrame, site_col: str = "source", text_col: str = "text", min_sites: int = MIN_SITES) -> DataFrame:
    """Hashes (h) of the lines that occur on ``min_sites`` sites or more."""
    lines = df.select(F.col(site_col).alias("site"), F.explode(_lines(df, text_col)).alias("line"))
    lines = lines.select("site", _hash(F.col("line")).alias("h")).where("h is not null and site is not null")
    spread = lines.groupBy("h").agg(F.hll_sketch_estimate(F.hll_sketch_agg(F.col("site").cast("string"), LG_K)).alias("sites"))
    spread = cut(spread.where(F.col("sites") >= min_sites / BAND), "spread")
    clear = spread.where(F.col("sites") > min_sites * BAND).select("h")
    near = spread.where(F.col("sites") <= min_sites * BAND).select("h")
    exact = lines.join(near, "h", "left_semi").groupBy("h").agg(F.countDistinct("site").alias("n")).where(F.col("n") >= min_sites)
    return clear.unionByName(exact.select("h"))


def line_dedup(df: DataFrame, site_col: str = "source", text_col: str = "text", min_sites: int = MIN_SITES) -> DataFrame:
    """``df`` with kept_text, n_lines and n_removed."""
    df = df.drop(*[c for c in ("kept_text", "n_lines", "n_removed") if c not in (site_col, text_col)])
    common = cut(boilerplate(df, site_col, text_col, min_sites), "boilerplate")  # a hot line's rows can then be split in the join
    keyed = df.withColumn("__key", F.xxhash64(text_col))
    hashes = F.array_distinct(F.filter(F.transform(_lines(df, text_col), _hash), lambda h: h.isNotNull()))
    found = keyed.select("__key", F.explode(hashes).alias("h")).join(common, "h", "left_semi")
    gone = cut(found.groupBy(F.col("__key").alias("__of")).agg(F.collect_set("h").alias("__gone")), "removals")  # and so can a hot text's rows
    joined = keyed.join(gone.hint("merge"), F.col("__key") == F.col("__of"), "left")  # the same plan at every size
    kept = F.filter(_lines(df, text_col), lambda line: ~F.coalesce(F.array_contains("__gone", _hash(line)), F.lit(False)))
    kept = F.when(F.col("__gone").isNull(), _lines(df, text_col)).otherwise(kept)
    counted = {"n_lines": F.coalesce(F.size(F.split(F.col(text_col), "\n")), F.lit(0)).cast("long"), "__kept": kept}
    out = joined.withColumns(counted).withColumn("n_removed", F.col("n_lines") - F.when(F.col(text_col).isNull(), 0).otherwise(F.size("__kept")))
    out = out.withColumns({"kept_text": F.array_join("__kept", "\n"), "n_removed": F.col("n_removed").cast("long")})
    return out.withColumn("n_lines", F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(F.col("n_lines")).cast("long")).drop("__key", "__of", "__gone", "__kept")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup(documents(spark, sf_dir).select("doc_id", "source", "text"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


_TRIM = r"[\x20\x09-\x0D]"
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, source, row_number() OVER () AS r, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT r, source, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i FROM d),
b AS (SELECT *, regexp_replace(regexp_replace(line, '^{_TRIM}+', ''), '{_TRIM}+$', '') AS bare FROM l),
w AS (SELECT *, len(regexp_extract_all(bare, '{WORD}')) >= {MIN_WORDS} AS judged FROM b),
c AS (SELECT bare FROM w WHERE judged GROUP BY bare HAVING count(DISTINCT source) >= {MIN_SITES}),
k AS (SELECT r, count(*) AS kept, string_agg(line, chr(10) ORDER BY i) AS txt FROM w WHERE NOT (judged AND bare IN (SELECT bare FROM c)) GROUP BY r)
SELECT doc_id, CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(ls), 0) - coalesce(kept, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(txt, '')) AS kept_sha256
FROM d LEFT JOIN k USING (r)
"""
