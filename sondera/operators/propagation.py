"""Path geometry and loss models from ray predictions: azimuth sectors, range bins, mixture moments, with carry-forward where rays are few."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sondera.catalog import durable
from sondera.functions import geodesy, numeric, physics


def bounces(rays: DataFrame, most: int, rng_max: float, loss_db: float) -> DataFrame:
    """Every ray's 1..most surface bounces: ranges and losses scale with the number, travel time per kilometre stays. Rays beyond rng_max go."""
    k = F.explode(F.sequence(F.lit(1), F.lit(most))).alias("bounce")
    x = rays.select("*", k).withColumns({"rng": F.col("rng") * F.col("bounce"), "loss": F.col("loss") * F.col("bounce") + loss_db * (F.col("bounce") - 1)})
    return x.where(F.col("rng") <= rng_max)


def sectors(rays: DataFrame, width: float = 60.0, count: int = 8) -> DataFrame:
    """Rays with every azimuth sector (``count`` of them, ``width`` wide, overlapping) that holds them: adds az_bin."""
    step = 360.0 / count
    inside = [F.when(F.abs(geodesy.azdiff(F.lit(b * step - 180.0), F.col("az"))) <= width / 2, b) for b in range(count)]
    return rays.withColumn("az_bin", F.explode(F.array(*inside))).where("az_bin is not null")


def path_geometry(rays: DataFrame, rng_max: float = 1000.0, step: float = 10.0, width: float = 40.0, least: int = 100, decay: float = 0.9) -> DataFrame:
    """az_bin, rng, comp, n, wt, mn, sd, az_mn, az_sd of rays (az_bin, rng, rcel, az_dev).

    Components are slow, middle and fast reciprocal celerities, split half-way
    between the canonical means. A range bin with fewer than ``least`` rays of a
    component takes the last bin's values, faded towards the canonical ones: a
    fold along the ranges of a sector, in order. Rays that fall into the same range
    bins are one cell; bins pool the moments of their cells, so a ray is added up once.
    """
    mid = [(a + b) / 2 for a, b in zip(physics.RCEL_MEANS, physics.RCEL_MEANS[1:], strict=False)]
    comp = F.when(F.col("rcel") < mid[0], 0).when(F.col("rcel") < mid[1], 1).otherwise(2)
    lo, hi = F.floor((F.col("rng") - width / 2) / step), F.ceil((F.col("rng") + width / 2) / step)
    last = next(k for k in range(int(rng_max / step) + 1, -1, -1) if k * step <= rng_max)
    first_of = lambda *ks: F.coalesce(*[F.when(F.abs(k * step - F.col("rng")) <= width / 2, k) for k in ks])
    x = rays.select("az_bin", "rcel", "az_dev", comp.alias("comp"), F.greatest(first_of(lo, lo + 1, lo + 2), F.lit(1)).alias("k0"), F.least(first_of(hi, hi - 1, hi - 2), F.lit(last)).alias("k1"))
    moments = [f(c).alias(f"{n}_{c}") for c in ("rcel", "az_dev") for n, f in (("c", F.count), ("m", F.avg), ("v", F.var_pop))]
    cells = durable(x.groupBy("az_bin", "comp", "k0", "k1").agg(F.count(F.lit(1)).alias("n"), *moments))

    def pooled(c: str, mean: str, sd: str) -> list[Column]:
        """Mean and deviation of all rays of some cells."""
        own = F.filter(F.collect_list(F.struct(F.col(f"c_{c}").alias("n"), F.col(f"m_{c}").alias("m"), F.col(f"v_{c}").alias("v"))), lambda y: y["n"] > 0)
        total = lambda f: F.aggregate(own, F.lit(0.0), lambda s, y: s + y["n"] * f(y))
        rows = F.nullif(total(lambda y: F.lit(1.0)), F.lit(0.0))
        middle = total(lambda y: y["m"]) / rows
        return [middle.alias(mean), F.sqrt(total(lambda y: y["v"] + (y["m"] - middle) * (y["m"] - middle)) / rows).alias(sd)]

    spread = cells.where("k0 <= k1").withColumn("k", F.explode(F.sequence("k0", "k1")))
    stats = spread.groupBy("az_bin", "k", "comp").agg(F.sum("n").alias("n"), *pooled("rcel", "mn", "sd"))
    az = spread.groupBy("az_bin", "k").agg(F.sum("n").alias("total"), *pooled("az_dev", "az_mn", "az_sd"))
    grid = cells.select("az_bin").distinct().withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(int(rng_max / step))))).withColumn("comp", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    grid = grid.join(stats, ["az_bin", "k", "comp"], "left").join(az, ["az_bin", "k"], "left")
    seq = grid.groupBy("az_bin", "comp").agg(F.sort_array(F.collect_list(F.struct("k", "n", "total", "mn", "sd", "az_mn", "az_sd"))).alias("a"))
    canon = [F.element_at(F.array(*[F.lit(v) for v in vs]), F.col("comp") + 1) for vs in (physics.RCEL_WEIGHTS, physics.RCEL_MEANS, physics.RCEL_SDS)]
    seq = seq.withColumns({"cw": canon[0], "cm": canon[1], "cs": canon[2]})
    kind = "array<struct<k:bigint,n:bigint,wt:double,mn:double,sd:double,az_mn:double,az_sd:double>>"

    def step_on(acc, r):
        last = F.element_at(acc, -1)
        has = F.size(acc) > 0
        fade = lambda name, canonical: F.when(has, canonical + decay * (last[name] - canonical)).otherwise(canonical)
        enough = F.coalesce(r["n"], F.lit(0)) >= least
        row = F.struct(
            r["k"].cast("long").alias("k"),
            F.coalesce(r["n"], F.lit(0)).cast("long").alias("n"),
            F.when(enough, r["n"] / r["total"]).otherwise(fade("wt", F.col("cw"))).alias("wt"),
            F.when(enough, r["mn"]).otherwise(fade("mn", F.col("cm"))).alias("mn"),
            F.when(enough, F.greatest(r["sd"], F.lit(1e-3))).otherwise(fade("sd", F.col("cs"))).alias("sd"),
            F.when(F.coalesce(r["total"], F.lit(0)) >= least, r["az_mn"]).otherwise(fade("az_mn", F.lit(0.0))).alias("az_mn"),
            F.when(F.coalesce(r["total"], F.lit(0)) >= least, F.greatest(r["az_sd"], F.lit(1e-3))).otherwise(fade("az_sd", F.lit(4.0))).alias("az_sd"),
        )
        return F.concat(acc, F.array(row)).cast(kind)

    folded = seq.select("az_bin", "comp", F.explode(F.aggregate("a", F.array().cast(kind), step_on)).alias("r")).select("az_bin", "comp", "r.*")
    share = F.col("wt") / F.sum("wt").over(Window.partitionBy("az_bin", "k"))
    return folded.withColumn("wt", share).withColumn("rng", F.col("k") * step).drop("k")


_CURVES = ("wt", "mn", "sd", "az_mn", "az_sd")


def model_splines(model: DataFrame, smooth: bool = False) -> DataFrame:
    """Cubic curves along the ranges of a path geometry model: az_bin, lo, hi, and for each component its five curves' coefficients.

    ``smooth`` takes local polynomials (nine points, third order) of the tables first. A group is one sector's table.
    """
    names = [f"{c}{k}" for c in _CURVES for k in range(3)]

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rng")
        x = np.sort(pdf["rng"].unique())
        parts = [pdf[pdf["comp"] == k] for k in range(3)]
        y = np.stack([p[c].to_numpy(float) for c in _CURVES for p in parts], axis=1)
        y = np.stack([numeric.smoothed(v, 9, 3) for v in y.T], axis=1) if smooth else y
        c = numeric.spline(x, y)
        out = {"az_bin": pdf["az_bin"].iloc[0], "lo": x[:-1], "hi": x[1:], "last": x[1:] == x[-1]}
        return pd.DataFrame({**out, **{n: list(c[:, :, i].T) for i, n in enumerate(names)}})

    kind = model.schema["az_bin"].dataType.simpleString()
    rows = model.select("az_bin", F.col("rng").cast("double").alias("rng"), "comp", *_CURVES)
    return rows.groupBy("az_bin").applyInPandas(fit, f"az_bin {kind}, lo double, hi double, last boolean, {', '.join(f'{n} array<double>' for n in names)}")


def evaluate(points: DataFrame, model: DataFrame, step: float = 10.0, smooth: bool = False) -> DataFrame:
    """``points`` (az, rng, rcel) with pdf, az_mn and az_sd: the density of a reciprocal celerity, and mean and deviation of azimuth
    deviations, under a path geometry model. Its tables are cubic splines along the range; the first and last ranges hold beyond them.

    Each point meets the one piece of its sector's curves that holds it, by an interval join on buckets of ``step``, so a point is
    read once and needs no number.
    """
    pieces = model_splines(model, smooth)
    span = model.agg(F.min("rng").cast("double").alias("a"), F.max("rng").cast("double").alias("b")).first()
    own = [c for c in points.columns if c not in ("pdf", "az_mn", "az_sd")]
    p = points.select(own).withColumns({"__az": geodesy.azimuth_bin("az"), "__r": F.least(F.greatest(F.col("rng").cast("double"), F.lit(span["a"])), F.lit(span["b"]))})
    bucket = lambda c: F.floor(F.col(c) / step).cast("long")
    pieces = pieces.withColumn("__b", F.explode(F.sequence(bucket("lo"), bucket("hi")))).withColumnRenamed("az_bin", "__az")
    held = (F.col("__r") >= F.col("lo")) & ((F.col("__r") < F.col("hi")) | F.col("last"))
    x = p.withColumn("__b", bucket("__r")).join(pieces, ["__az", "__b"]).where(held).withColumn("__d", F.col("__r") - F.col("lo"))
    d = F.col("__d")
    at = lambda n: F.col(n)[0] + d * (F.col(n)[1] + d * (F.col(n)[2] + d * F.col(n)[3]))
    pdf = sum((at(f"wt{k}") * physics.normal_pdf("rcel", at(f"mn{k}"), at(f"sd{k}")) for k in range(3)), F.lit(0.0))
    return x.select(*own, pdf.alias("pdf"), at("az_mn0").alias("az_mn"), at("az_sd0").alias("az_sd"))


def loss_surfaces(losses: DataFrame) -> DataFrame:
    """Bicubic surfaces of a loss model (az_bin, rng, loss, p on a full grid): az_bin, the piece's lower corner i, j and its sixteen
    coefficients of powers of range and loss. A group is one sector's table."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        grid = pdf.pivot_table(index="rng", columns="loss", values="p", aggfunc="first").fillna(0.0)
        along = numeric.spline(grid.index.to_numpy(), grid.to_numpy())  # [power of range, piece of range, loss]
        both = numeric.spline(grid.columns.to_numpy(), along.transpose(2, 0, 1))  # [power of loss, piece of loss, power of range, piece of range]
        c = both.transpose(3, 1, 2, 0).reshape(-1, 16)
        i, j = np.divmod(np.arange(len(c)), len(grid.columns) - 1)
        return pd.DataFrame({"az_bin": pdf["az_bin"].iloc[0], "i": i, "j": j, "c": list(c)})

    kind = losses.schema["az_bin"].dataType.simpleString()
    return losses.select("az_bin", F.col("rng").cast("double").alias("rng"), F.col("loss").cast("double").alias("loss"), "p").groupBy("az_bin").applyInPandas(fit, f"az_bin {kind}, i int, j int, c array<double>")


def evaluate_loss(points: DataFrame, losses: DataFrame, step: float = 10.0, db: float = 1.0) -> DataFrame:
    """``points`` (az, rng, loss) with pdf: the loss density by the bicubic surface of the point's sector; ends held. The model's ranges
    are ``step`` apart, its losses ``db``, so a point's piece is found by arithmetic and joined by number."""
    span = losses.agg(*[f(c).cast("double").alias(f"{c}{n}") for c in ("rng", "loss") for n, f in (("0", F.min), ("1", F.max))]).first()
    inside = lambda c: F.least(F.greatest(F.col(c).cast("double"), F.lit(span[f"{c}0"])), F.lit(span[f"{c}1"]))
    place = lambda c, w: F.least(F.floor((inside(c) - span[f"{c}0"]) / w + 1e-9), F.lit(round((span[f"{c}1"] - span[f"{c}0"]) / w) - 1)).cast("int")
    own = [c for c in points.columns if c != "pdf"]
    x = points.select(*own, geodesy.azimuth_bin("az").alias("__az"), place("rng", step).alias("__i"), place("loss", db).alias("__j"))
    x = x.withColumns({"__u": inside("rng") - span["rng0"] - F.col("__i") * step, "__v": inside("loss") - span["loss0"] - F.col("__j") * db})
    pieces = loss_surfaces(losses).select(F.col("az_bin").alias("__az"), F.col("i").alias("__i"), F.col("j").alias("__j"), F.col("c").alias("__c"))

    def power(x: str, terms: list[Column]) -> Column:
        return terms[0] + F.col(x) * (terms[1] + F.col(x) * (terms[2] + F.col(x) * terms[3]))

    pdf = power("__u", [power("__v", [F.col("__c")[4 * a + b] for b in range(4)]) for a in range(4)])
    return x.join(pieces, ["__az", "__i", "__j"], "left").select(*own, F.coalesce(pdf, F.lit(0.0)).alias("pdf"))


def loss_histogram(rays: DataFrame, step: float = 10.0, db: float = 1.0) -> DataFrame:
    """Loss density per sector and range: az_bin, rng, loss, p. A histogram smoothed by its neighbours (1, 2, 1) stands for a kernel density."""
    x = rays.select("az_bin", (F.floor(F.col("rng") / step) * step).alias("rng"), F.explode(F.array(*[F.struct((F.floor(F.col("loss") / db) + o).alias("b"), F.lit(w).alias("w")) for o, w in ((-1, 0.25), (0, 0.5), (1, 0.25))])).alias("c"))
    g = x.groupBy("az_bin", "rng", F.col("c.b").alias("b")).agg(F.sum("c.w").alias("w"))
    total = F.sum("w").over(Window.partitionBy("az_bin", "rng"))
    return g.select("az_bin", "rng", ((F.col("b") + 0.5) * db).alias("loss"), (F.col("w") / total / db).alias("p"))


def density_rows(df: DataFrame, keys: list[str], x: str, lo: float, hi: float, points: int = 200, cells: int = 2048) -> DataFrame:
    """Gaussian kernel density (Scott's bandwidth) of each group on a grid: keys, x, p. A deviation below 0.01 counts as 0.01.

    A group travels as counts in ``cells`` cells between its ends, so its size is bounded whatever it holds.
    """
    stats = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.stddev_samp(x).alias("__sd"), F.min(x).alias("__lo"), F.max(x).alias("__hi"))
    width = F.greatest((F.col("__hi") - F.col("__lo")) / cells, F.lit(1e-300))
    counts = df.join(stats, keys).groupBy(*keys, "__n", "__sd", "__lo", "__hi", F.least(F.floor((F.col(x) - F.col("__lo")) / width), F.lit(cells - 1)).alias("b")).agg(F.count(F.lit(1)).alias("w"))
    packed = counts.groupBy(*keys, "__n", "__sd", "__lo", "__hi").agg(F.sort_array(F.collect_list(F.struct("b", "w"))).alias("c"))
    grid, names = np.linspace(lo, hi, points), [*keys, "x", "p"]

    def batches(found: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in found:
            for row in pdf.to_dict("records"):
                step = (row["__hi"] - row["__lo"]) / cells
                at = row["__lo"] + (np.array([c["b"] for c in row["c"]]) + 0.5) * step
                w = np.array([c["w"] for c in row["c"]], float) / row["__n"]
                sd = row["__sd"] if row["__sd"] == row["__sd"] and row["__sd"] is not None else 0.0
                band = max(sd, 0.01) * (row["__n"] ** -0.2 if sd >= 0.01 else 1.0)
                p = (w * np.exp(-0.5 * ((grid[:, None] - at) / band) ** 2)).sum(axis=1) / (band * np.sqrt(2 * np.pi))
                yield pd.DataFrame({**{k: row[k] for k in keys}, "x": grid, "p": p})[names]

    return packed.mapInPandas(batches, df.select(*keys).withColumns({"x": F.lit(0.0), "p": F.lit(0.0)}).schema)


def loss_density(rays: DataFrame, lo: float = -120.0, hi: float = 0.0, points: int = 121, step: float = 10.0, width: float = 40.0) -> DataFrame:
    """Kernel density of the loss per sector and overlapping range bin: az_bin, rng, loss, p."""
    first, last = F.floor((F.col("rng") - width / 2) / step), F.ceil((F.col("rng") + width / 2) / step)
    near = F.filter(F.sequence(first, last), lambda k: (F.abs(k * step - F.col("rng")) <= width / 2) & (k >= 1))
    x = rays.select("az_bin", F.explode(near).alias("k"), "loss").select("az_bin", (F.col("k") * step).alias("rng"), "loss")
    return density_rows(x, ["az_bin", "rng"], "loss", lo, hi, points).withColumnRenamed("x", "loss")


def fit_celerity(rays: DataFrame, celerity: str = "cel", loss: str | None = None, least_loss: float | None = None) -> DataFrame:
    """One row: weights, means and deviations (arrays of three, to three digits) of a mixture fitted to the density of reciprocal celerities.

    The density is taken at 200 celerities from 0.38 to 0.18 km/s; the fit starts from the canonical mixture.
    """
    x = rays if loss is None or least_loss is None else rays.where(F.col(loss) > least_loss)
    x = x.select(F.lit(0).alias("g"), (1 / F.col(celerity)).alias("rc"))
    counts = density_at(x, ["g"], "rc", 1 / np.linspace(0.38, 0.18, 200))

    def mixture(v, *p):
        return sum(p[i] / p[6 + i] * np.exp(-0.5 * ((v - p[3 + i]) / p[6 + i]) ** 2) / np.sqrt(2 * np.pi) for i in range(3))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        start = np.array([*physics.RCEL_WEIGHTS, *physics.RCEL_MEANS, *physics.RCEL_SDS])
        found = numeric.fitted(mixture, pdf["x"].to_numpy(), pdf["p"].to_numpy(), start, rounds=1000)
        p = np.round(start if found is None else found, 3)
        return pd.DataFrame({"weights": [p[:3].tolist()], "means": [p[3:6].tolist()], "deviations": [p[6:].tolist()], "settled": [found is not None]})

    return counts.groupBy("g").applyInPandas(fit, "weights array<double>, means array<double>, deviations array<double>, settled boolean")


def density_at(df: DataFrame, keys: list[str], x: str, at: np.ndarray, cells: int = 2048) -> DataFrame:
    """Kernel density of each group at given points, by linear interpolation of a fine grid: keys, x, p."""
    grid = density_rows(df, keys, x, float(at.min()), float(at.max()), 1000, cells)

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("x")
        return pd.DataFrame({**{k: pdf[k].iloc[0] for k in keys}, "x": at, "p": np.interp(at, pdf["x"], pdf["p"])})[[*keys, "x", "p"]]

    return grid.groupBy(*keys).applyInPandas(pick, grid.schema)


def skew_normal_mixture(x: Column, parts: list[tuple[float, float, float, float]]) -> Column:
    """Density of a mixture of skew normals, given as (weight, skew, location, scale)."""
    return sum((weight * physics.skew_normal_pdf(x, at, scale, skew) for weight, skew, at, scale in parts), F.lit(0.0))
