"""Mixing sources to target weights: equal-token blocks apportioned by Sainte-Lague.

Sources, in code-point order with null last, weigh ``weights`` in turn and
share ``share`` of all words; no target passes ``most`` times its source's
words, and what is above is shared again by weight (water filling, solved with
two running sums instead of rounds). The targets are apportioned into blocks of
``block_words`` by highest Sainte-Lague quotients: first blocks to sources,
then each source's blocks to groups of ``GROUP`` of its shards, and a group's
blocks to its shards, so no window is longer than a group or a source's groups. A shard is a seeded hash class of a
source's documents of about ``shard_words``, so a source that holds a third of
all rows is many shards. Inside a shard, documents lie in seeded order; the
mix takes whole passes over the shard, then a cyclic run of blocks from a
seeded start. Only documents at the two ends of a run are cut.

Quotients are ranked for the few seats that the divisor method leaves open
(at most 3.5 candidates per source on average), never for all blocks.

Edge cases: null text has no words and is never taken; null sources form one
source; rows that share an id are ordered by size; an empty table gives an
empty result. Input columns named like a result column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sondera.llm.common import WORD, cut, documents

NAME = "op8_source_mixing"
WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2
BLOCK_WORDS, SHARD_WORDS, SEED = 64, 1 << 18, "mix-1"
GROUP = 4096  # shards that are ranked together


def n_words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def _seeded(*parts: Column) -> Column:
    """A 60-bit number of the seed and the parts."""
    joined = F.concat_ws(":", F.lit(SEED), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(joined), 1, 15), 16, 10).cast("long")


def targets(sized: DataFrame, source: str, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row per source: __s (source), __rank, source_size, target. Windows here run over sources, not rows."""
    every = Window.orderBy("__ratio", "__rank")
    table = sized.groupBy(F.col(source).alias("__s")).agg(F.sum("size").alias("source_size"))
    table = table.withColumn("__rank", F.row_number().over(Window.orderBy(F.col("__s").asc_nulls_last())))
    table = table.withColumn("__w", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("__rank") - 1) % len(weights) + 1))
    table = table.withColumn("__cap", most * F.col("source_size")).withColumn("__ratio", F.col("__cap") / F.col("__w"))
    before = F.sum("__cap").over(every.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__cap")
    rest = F.sum("__w").over(every.rowsBetween(0, Window.unboundedFollowing))
    total = share * F.sum("source_size").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    table = table.withColumn("__level", (total - before) / rest)
    whole = every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = F.min(F.when(F.col("__ratio") > F.col("__level"), F.struct("__ratio", "__rank", "__level"))).over(whole)
    table = table.withColumn("__at", level["__level"])
    target = F.when(F.col("__ratio") > F.col("__level"), F.col("__at") * F.col("__w")).otherwise(F.col("__cap")).cast("double")
    return table.select("__s", "__rank", "source_size", target.alias("target"))


def sainte_lague(table: DataFrame, parts: list[str], item: str, votes: str, seats: str, out: str) -> DataFrame:
    """``table`` with integer ``out``: ``seats`` (one number per part) apportioned to ``votes`` by highest quotients votes / (2k - 1).

    With the divisor votes / seats, rounding gives all but a few seats; an item's true seats differ from that by at most
    1.5 n times its share, plus one, so only these candidates are ranked.
    """
    part = Window.partitionBy(*parts) if parts else Window.partitionBy(F.lit(0))
    table = table.withColumn("__all", F.sum(votes).over(part)).withColumn("__n", F.count(F.lit(1)).over(part))
    share = F.when(F.col("__all") > 0, F.col(votes) / F.col("__all")).otherwise(F.lit(0.0))
    table = table.withColumn("__share", share).withColumn("__near", F.floor(F.col("__share") * F.col(seats) + 0.5))
    table = table.withColumn("__off", F.ceil(1.5 * F.col("__n") * F.col("__share")) + 1)
    table = table.withColumn("__low", F.greatest(F.lit(0), F.col("__near") - F.col("__off")).cast("long"))
    table = table.withColumn("__open", F.col(seats) - F.sum("__low").over(part))
    seat = table.select(*parts, item, votes, "__open", F.explode(F.sequence(F.col("__low") + 1, (F.col("__near") + F.col("__off")).cast("long"))).alias("__k"))
    seat = seat.where(F.col(votes) > 0).withColumn("__q", F.col(votes) / (2 * F.col("__k") - 1))
    won = seat.withColumn("__at", F.row_number().over(part.orderBy(F.desc("__q"), item, "__k"))).where("__at <= __open")
    keys = [*parts, item]
    won = won.groupBy(*[F.col(k).alias(f"__g{i}") for i, k in enumerate(keys)]).agg(F.count(F.lit(1)).alias("__won"))
    same = [F.col(k).eqNullSafe(F.col(f"__g{i}")) for i, k in enumerate(keys)]
    joined = table.join(won, same, "left").withColumn(out, F.col("__low") + F.coalesce("__won", F.lit(0)))
    return joined.drop("__all", "__n", "__share", "__near", "__off", "__low", "__open", "__won", *[f"__g{i}" for i in range(len(keys))])


def mix(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", sized: DataFrame | None = None) -> DataFrame:
    """All rows of ``df`` with size, source_size, target, taken and __cuts.

    __cuts: [from, to) word ranges of the document in the mix's last, partial pass; whole passes are in __passes.
    ``sized``: the id, source and size columns, where they are at hand already.
    """
    df = df.drop(*[c for c in ("size", "source_size", "target", "taken") if c not in (id_col, source_col, text_col)])
    df = df.withColumn("size", n_words(text_col))
    return _mix(df, cut(df.select(id_col, source_col, "size"), "sizes") if sized is None else sized, id_col, source_col)


def _mix(df: DataFrame, sized: DataFrame, id_col: str, source_col: str) -> DataFrame:
    b = BLOCK_WORDS
    sources = targets(sized, source_col)
    sources = sources.withColumn("__seats", F.floor(F.sum("target").over(Window.partitionBy(F.lit(0))) / b + 0.5))
    sources = sainte_lague(sources, [], "__rank", "target", "__seats", "__blocks")
    sources = cut(sources.withColumn("__shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / SHARD_WORDS))), "targets")

    def sharded(rows: DataFrame) -> DataFrame:
        rows = rows.join(sources, F.col(source_col).eqNullSafe(F.col("__s"))).withColumn("__h", _seeded(F.col(id_col)))
        return rows.withColumn("__shard", F.col("__h") % F.col("__shards"))

    shards = sharded(sized).groupBy("__rank", "__shard").agg(F.sum("size").alias("__words"), F.first("__blocks").alias("__seats"), F.first("__s").alias("__name"))
    shards = cut(shards.withColumn("__group", F.floor(F.col("__shard") / GROUP)), "shards")
    groups = shards.groupBy("__rank", "__group").agg(F.sum("__words").alias("__words"), F.first("__seats").alias("__seats"))
    groups = sainte_lague(groups, ["__rank"], "__group", "__words", "__seats", "__own").select(F.col("__rank").alias("__r"), F.col("__group").alias("__g"), "__own")
    shards = shards.join(groups, (F.col("__rank") == F.col("__r")) & (F.col("__group") == F.col("__g"))).withColumn("__seats", F.col("__own"))
    shards = sainte_lague(shards.drop("__r", "__g", "__own"), ["__rank", "__group"], "__shard", "__words", "__seats", "__quota")
    shards = shards.withColumn("__n", F.ceil(F.col("__words") / b)).where("__n > 0")
    shards = shards.withColumn("__quota", F.least("__quota", 2 * F.col("__n")))
    shards = shards.withColumns({"__passes": F.floor(F.col("__quota") / F.col("__n")), "__run": F.col("__quota") % F.col("__n"), "__from": _seeded(F.col("__name"), F.col("__shard")) % F.col("__n")})
    shards = shards.select(F.col("__rank").alias("__r2"), F.col("__shard").alias("__s2"), "__words", "__n", "__passes", "__run", "__from")

    laid = sharded(df).join(shards, (F.col("__rank") == F.col("__r2")) & (F.col("__shard") == F.col("__s2")), "left")
    line = Window.partitionBy("__rank", "__shard").orderBy("__h", F.col(id_col), "size")
    laid = laid.withColumn("__a", F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    first, wrapped = F.col("__from"), F.greatest(F.lit(0), F.col("__from") + F.col("__run") - F.col("__n"))

    def clip(lo: Column, hi: Column) -> Column:
        inside = lambda x: F.least(F.greatest(x * b - F.col("__a"), F.lit(0)), F.col("size"))
        return F.struct(inside(lo).cast("long").alias("lo"), F.greatest(inside(lo), inside(hi)).cast("long").alias("hi"))

    cuts = F.array(clip(F.lit(0), wrapped), clip(first, F.least(first + F.col("__run"), F.col("__n"))))
    laid = laid.withColumn("__cuts", F.filter(cuts, lambda c: c["hi"] > c["lo"]))
    partial = F.aggregate("__cuts", F.lit(0).cast("long"), lambda s, c: s + c["hi"] - c["lo"])
    return laid.withColumn("taken", F.coalesce(F.col("__passes") * F.col("size") + partial, F.lit(0)).cast("long"))


def mixed_documents(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The mix itself, with the columns of ``df``: documents once for each time they are taken, cut at the ends of a run."""
    laid = mix(df, id_col, source_col, text_col)
    whole = F.array_repeat(F.struct(F.lit(0).cast("long").alias("lo"), F.col("size").alias("hi")), F.coalesce("__passes", F.lit(0)).cast("int"))
    taken = laid.withColumn("__cut", F.explode(F.concat(whole, F.coalesce("__cuts", F.array().cast("array<struct<lo:bigint,hi:bigint>>"))))).where("size > 0")
    words = F.regexp_extract_all(F.col(text_col), F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    part = F.trim(F.array_join(F.slice(words, (F.col("__cut.lo") + 1).cast("int"), (F.col("__cut.hi") - F.col("__cut.lo")).cast("int")), ""))
    text = F.when((F.col("__cut.lo") == 0) & (F.col("__cut.hi") == F.col("size")), F.col(text_col)).otherwise(part)
    return taken.withColumn(text_col, text).select(df.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    sized = cut(docs.select("doc_id", "source", n_words("text").alias("size")), "sizes")
    return _mix(sized, sized, "doc_id", "source").select("doc_id", "size", "source_size", "target", "taken")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


def _seat_sql(table: str, parts: str, item: str, votes: str, out: str) -> str:
    by = f"PARTITION BY {parts}" if parts else ""
    on = " AND ".join(f"a.{k} = w.{k}" for k in [*filter(None, [parts]), item])
    keys = ", ".join([*filter(None, [parts]), item])
    return f"""
{out}_a AS (SELECT *, CASE WHEN sum({votes}) OVER p > 0 THEN {votes} / sum({votes}) OVER p ELSE 0.0 END AS share_, count(*) OVER p AS n_ FROM {table} WINDOW p AS ({by})),
{out}_b AS (SELECT *, CAST(floor(share_ * seats + 0.5) AS BIGINT) AS near_, CAST(ceil(1.5 * n_ * share_) + 1 AS BIGINT) AS off_ FROM {out}_a),
{out}_c AS (SELECT *, seats - sum(greatest(0, near_ - off_)) OVER ({by}) AS open_ FROM {out}_b),
{out}_d AS (SELECT {keys}, open_, {votes} AS v_, unnest(range(greatest(0, near_ - off_) + 1, near_ + off_ + 1)) AS k_ FROM {out}_c WHERE {votes} > 0),
{out}_e AS (SELECT *, row_number() OVER ({by} ORDER BY v_ / (2 * k_ - 1) DESC, {item}, k_) AS at_ FROM {out}_d),
{out}_w AS (SELECT {keys}, count(*) AS won_ FROM {out}_e WHERE at_ <= open_ GROUP BY ALL),
{out} AS (SELECT a.* EXCLUDE (share_, n_, near_, off_, open_), greatest(0, near_ - off_) + coalesce(won_, 0) AS got_ FROM {out}_c a LEFT JOIN {out}_w w ON {on})"""


ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS size,
  CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h FROM documents),
s1 AS (SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rk FROM d GROUP BY source),
s2 AS (SELECT *, CASE rk % 3 WHEN 1 THEN 5 WHEN 2 THEN 2 ELSE 1 END AS w, 2 * source_size AS cap FROM s1),
s3 AS (SELECT *, cap / w AS ratio, (1.5 * sum(source_size) OVER () - (sum(cap) OVER (ORDER BY cap / w, rk ROWS UNBOUNDED PRECEDING) - cap))::DOUBLE
  / sum(w) OVER (ORDER BY cap / w, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM s2),
s4 AS (SELECT *, CASE WHEN ratio > lv THEN (SELECT arg_min(lv, rk + 1e9 * ratio) FROM s3 WHERE ratio > lv) * w ELSE cap END::DOUBLE AS target FROM s3),
s5 AS (SELECT *, CAST(floor(sum(target) OVER () / {BLOCK_WORDS} + 0.5) AS BIGINT) AS seats FROM s4),
{_seat_sql("s5", "", "rk", "target", "src")},
e AS (SELECT d.doc_id, d.size, d.h, s.source, s.rk, s.source_size, s.target, s.got_ AS seats, d.h % greatest(1, CAST(ceil(s.source_size / {SHARD_WORDS}) AS BIGINT)) AS shard
  FROM d JOIN src s ON d.source IS NOT DISTINCT FROM s.source),
h1 AS (SELECT rk, shard, CAST(sum(size) AS BIGINT) AS words, any_value(seats) AS seats, any_value(source) AS source FROM e GROUP BY rk, shard),
g1 AS (SELECT rk, shard // {GROUP} AS grp, CAST(sum(words) AS BIGINT) AS words, any_value(seats) AS seats FROM h1 GROUP BY ALL),
{_seat_sql("g1", "rk", "grp", "words", "gr")},
i1 AS (SELECT h1.* EXCLUDE (seats), gr.got_ AS seats, h1.rk * 1000000000 + gr.grp AS pt FROM h1 JOIN gr ON h1.rk = gr.rk AND h1.shard // {GROUP} = gr.grp),
{_seat_sql("i1", "pt", "shard", "words", "sh")},
h2 AS (SELECT *, CAST(ceil(words / {BLOCK_WORDS}) AS BIGINT) AS n FROM sh WHERE words > 0),
h3 AS (SELECT *, CAST(least(got_, 2 * n) AS BIGINT) // n AS passes, CAST(least(got_, 2 * n) AS BIGINT) % n AS run,
  CAST('0x' || substr(md5('{SEED}:' || coalesce(source, '') || ':' || shard), 1, 15) AS BIGINT) % n AS frm FROM h2),
f AS (SELECT e.*, n, passes, run, frm, sum(size) OVER (PARTITION BY e.rk, e.shard ORDER BY e.h, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS a
  FROM e LEFT JOIN h3 ON e.rk = h3.rk AND e.shard = h3.shard)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target, CAST(coalesce(passes * size
  + greatest(0, least(a + size, greatest(0, frm + run - n) * {BLOCK_WORDS}) - a)
  + greatest(0, least(a + size, least(frm + run, n) * {BLOCK_WORDS}) - greatest(a, frm * {BLOCK_WORDS})), 0) AS BIGINT) AS taken FROM f
"""
