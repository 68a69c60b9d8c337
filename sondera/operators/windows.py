"""Time windows: hops, centred frames, runs of detections, merging."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sondera.functions.circular import circular_std
from sondera.operators import blocks


def hop_windows(df: DataFrame, at: str, first: Column | str, length: float, step: float, last: Column | str | None = None) -> DataFrame:
    """One row per (row, window that holds it): adds win_start. Windows start at first, first + step, ...; both ends are inside.

    With ``last``, windows that end after it are dropped.
    """
    t, t0 = F.col(at), F.col(first) if isinstance(first, str) else first
    lo = F.greatest(F.ceil((t - length - t0) / step), F.lit(0))
    hi = F.floor((t - t0) / step)
    starts = F.when(hi >= lo, F.transform(F.sequence(lo, hi), lambda k: t0 + k * step)).otherwise(F.array().cast("array<double>"))
    if last is not None:
        end = F.col(last) if isinstance(last, str) else last
        starts = F.filter(starts, lambda s: s + length <= end)
    return df.withColumn("win_start", F.explode(starts))


def window_label(start: Column, length: float) -> Column:
    """The label of a window: its middle, cut to whole seconds."""
    return F.floor(start + length / 2)


def centred_stat(df: DataFrame, keys: list[str], at: str, length: float, agg: Column, out: str) -> DataFrame:
    """``agg`` over the rows within length / 2 of each row, in a range frame."""
    half = int(length / 2)
    frame = Window.partitionBy(*keys).orderBy(F.col(at).cast("long")).rangeBetween(-half, half)
    return df.withColumn(out, agg.over(frame))


def clamped_bounds(at: Column, first: Column, last: Column, length: float) -> tuple[Column, Column]:
    """A window of ``length`` centred on ``at``, moved as little as needed to lie within first..last."""
    lo = F.when(at - length / 2 < first, first).when(at + length / 2 > last, last - length).otherwise(at - length / 2)
    return F.greatest(lo, first), F.least(lo + length, last)


def clamped_stat(df: DataFrame, keys: list[str], at: str, length: float, aggs: dict[str, Column]) -> DataFrame:
    """Aggregates over each row's clamped window (both ends inside), as a bucketed band join of rows with their group's rows."""
    from sondera.operators.relational import band_join

    ends = Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    lo, hi = clamped_bounds(F.col(at), F.min(at).over(ends), F.max(at).over(ends), length)
    spans = df.withColumns({"__lo": lo, "__hi": hi}).select(*keys, F.col(at).alias("__at"), "__lo", "__hi").distinct()
    joined = band_join(df, spans, keys, at, "__lo", "__hi", length)
    return joined.groupBy(*keys, F.col("__at").alias(at)).agg(*[c.alias(k) for k, c in aggs.items()])


def runs(df: DataFrame, keys: list[str], at: str, flag: str, min_length: int, include_last: bool = False, block: float = blocks.DAY) -> DataFrame:
    """Maximal runs of rows with a true flag, of min_length rows or more: adds run (its number within the keys) to the rows in them.

    The last row of each key never belongs to a run unless ``include_last``. Runs are found within blocks of ``block`` (of ``at``); the
    pieces at a block's ends get their numbers and sizes from summaries of the blocks, so a key's rows are never in one task.
    """
    columns = df.columns
    df = blocks.blocked(df, at, block).withColumn("__m", F.coalesce(F.col(flag), F.lit(False)))
    own = Window.partitionBy(*keys, blocks.BLOCK)
    order = own.orderBy(at)
    turn = F.col("__m") & ~F.coalesce(F.lag("__m").over(order), F.lit(False))
    df = df.withColumns({"__i": F.row_number().over(order), "__turn": turn}).withColumn("__run", F.sum(F.col("__turn").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    df = df.withColumns({"__n": F.count(F.lit(1)).over(own), "__size": F.sum(F.col("__m").cast("long")).over(Window.partitionBy(*keys, blocks.BLOCK, "__run"))})

    # a block: whether it begins and ends inside a run, how long its first and its last piece are, and how many runs begin in it
    first, last = (F.col("__i") == 1) & F.col("__m"), (F.col("__i") == F.col("__n")) & F.col("__m")
    ends = df.groupBy(*keys, blocks.BLOCK).agg(F.max(first).alias("head"), F.max(last).alias("tail"), F.coalesce(F.max(F.when(first, F.col("__size"))), F.lit(0)).alias("n_head"), F.coalesce(F.max(F.when(last, F.col("__size"))), F.lit(0)).alias("n_tail"), F.max("__run").alias("turns"))
    line = Window.partitionBy(*keys).orderBy(blocks.BLOCK)
    joins = F.col("head") & F.coalesce(F.lag("tail").over(line), F.lit(False))
    ends = ends.withColumns({"final": F.lead(F.lit(1)).over(line).isNull(), "joins": joins}).withColumn("whole", F.col("head") & F.col("tail") & (F.col("turns") == 1))
    ends = ends.withColumn("offset", F.coalesce(F.sum(F.col("turns") - F.col("joins").cast("long")).over(blocks.before(keys)), F.lit(0)) - F.col("joins").cast("long"))
    if not include_last:  # a key's last row only makes the last run shorter
        short = lambda c: F.when(F.col("final") & F.col("tail") & (F.lit(c == "n_tail") | F.col("whole")), F.col(c) - 1).otherwise(F.col(c))
        ends = ends.withColumns({c: short(c) for c in ("n_head", "n_tail")})
    number = lambda c: F.col("offset") + (F.lit(1) if c == "head" else F.col("turns"))
    piece = lambda c: F.struct(F.lit(c).alias("end"), F.when(F.col(c), number(c)).alias("run"), F.when(F.lit(c == "head") | ~F.col("whole"), F.col(f"n_{c}")).otherwise(0).alias("n"))
    pieces = ends.select(*keys, blocks.BLOCK, "offset", "final", F.inline(F.array(piece("head"), piece("tail"))))
    pieces = pieces.withColumn("all", F.sum("n").over(Window.partitionBy(*keys, "run")))
    ends = pieces.groupBy(*keys, blocks.BLOCK).agg(*[F.max(c).alias(f"__{c}") for c in ("offset", "final")], *[F.max(F.when(F.col("end") == e, F.col(c))).alias(f"__{c}_{e}") for e in ("head", "tail") for c in ("run", "all")])

    df = df.where("__m").drop("run").join(ends, [*keys, blocks.BLOCK]).withColumn("run", F.col("__offset") + F.col("__run"))
    size = F.when(F.col("run") == F.col("__run_head"), F.col("__all_head")).when(F.col("run") == F.col("__run_tail"), F.col("__all_tail")).otherwise(F.col("__size"))
    inside = F.lit(True) if include_last else ~(F.col("__final") & (F.col("__i") == F.col("__n")))
    return df.where(inside & (size >= min_length)).select(*[c for c in columns if c != "run"], "run")


def detections(in_runs: DataFrame, keys: list[str], at: str, value: str, az: str, spread_limit: float, payload: list[str]) -> DataFrame:
    """One row per run whose back azimuths spread (two circular standard deviations) less than the limit: its peak row and ends."""
    best = F.max_by(F.struct(at, value, az, *payload), F.struct(F.col(value), -F.col(at)))
    found = in_runs.groupBy(*keys, "run").agg(best.alias("p"), F.min(at).alias("first"), F.max(at).alias("last"), F.count(F.lit(1)).alias("n_rows"), (2 * circular_std(az)).alias("spread"))
    found = found.where(F.col("spread") < spread_limit)
    ends = {"start": F.floor(F.col("first") - F.col("p")[at]), "end": F.floor(F.col("last") - F.col("p")[at])}
    return found.withColumns(ends).select(*keys, "run", *[F.col("p")[c].alias(c) for c in (at, value, az, *payload)], "start", "end", "n_rows", "spread")


def merge_detections(df: DataFrame, keys: list[str], at: str, value: str, az: str, az_limit: float, block: float = 30 * blocks.DAY) -> DataFrame:
    """Neighbouring detections of one key with near azimuths and a gap below the longer duration become one, until none are left to merge.

    Merging is in order of time and to a fixpoint. Detections that could ever
    meet lie in one group: a detection may grow to the whole time since its
    group began, so a group ends where the next detection starts later than that
    time, or the longest detection of the key, behind all before it. Groups are
    found by running maxima and counts over blocks of ``block`` seconds.
    """
    schema = df.schema
    lo, hi = F.col(at) + F.col("start"), F.col(at) + F.col("end")
    longest = df.groupBy(*keys).agg(F.max(hi - lo).alias("__longest"))
    df = blocks.running(blocks.blocked(df, at, block), keys, [at, "start"], {"__reach": ("max", hi, False)}).join(longest, keys)
    gap = lo - F.col("__reach")
    df = blocks.running(df, keys, [at, "start"], {"__near": ("sum", (gap.isNull() | (gap >= F.col("__longest"))).cast("long"), True)})
    ends = df.groupBy(*keys, "__near").agg(F.min(lo).alias("__from"), F.max(hi).alias("__to"))
    ends = blocks.blocked(ends.withColumn("__span", F.col("__to") - F.col("__from")), "__from", block)  # merged detections can reach as far as they span
    ends = blocks.running(ends, keys, ["__near"], {"__last": ("max", F.col("__to"), False), "__widest": ("max", F.col("__span"), False)})
    apart = (F.col("__from") - F.col("__last")) >= F.greatest("__span", "__widest")
    ends = blocks.running(ends, keys, ["__near"], {"__group": ("sum", F.coalesce(apart, F.lit(True)).cast("long"), True)}).select(*keys, "__near", "__group")
    df = df.join(ends, [*keys, "__near"]).drop("__reach", "__longest", "__near", blocks.BLOCK)

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.drop(columns="__group").sort_values(at, kind="stable").to_dict("records")
        changed = True
        while changed:
            changed, out = False, []
            for row in rows:
                if out:
                    a = out[-1]
                    d = (row[az] - a[az] + 180) % 360 - 180
                    gap = row[at] + row["start"] - (a[at] + a["end"])
                    if abs(d) < az_limit and gap < max(a["end"] - a["start"], row["end"] - row["start"]):
                        lo, hi = min(a[at] + a["start"], row[at] + row["start"]), max(a[at] + a["end"], row[at] + row["end"])
                        best = dict(row if row[value] > a[value] else a)
                        best["start"], best["end"] = lo - best[at], hi - best[at]
                        out[-1], changed = best, True
                        continue
                out.append(row)
            rows = out
        kept = pdf.drop(columns="__group")
        return pd.DataFrame(rows, columns=kept.columns).astype(kept.dtypes.to_dict())

    return df.groupBy(*keys, "__group").applyInPandas(merged, schema)


def blend_weights(start: Column, at: Column, length: float, step: float) -> Column:
    """Logistic up and down ramp of a window, for overlap-add."""
    s = step / 20
    up = 1 / (1 + F.exp(-(at - start - step / 2) / s))
    down = 1 / (1 + F.exp((at - start - length + step / 2) / s))
    return up * down


def local_maxima(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Rows that are not below either neighbour in order; a group's first and last rows are left out."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumns({"__a": F.lag(value).over(w), "__b": F.lead(value).over(w)}).where((F.col(value) >= F.col("__a")) & (F.col(value) >= F.col("__b"))).drop("__a", "__b")


